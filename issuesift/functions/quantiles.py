"""Exact linear-interpolated quantiles that scale past one reducer.

Spark's exact ``percentile`` merges a value->count map of the whole column
in one final task; for a continuous column over billions of rows that map is
the column. The exact search here keeps every buffer bounded:

1. one aggregate: ``count``, ``min``, ``max`` and ``percentile_approx`` at
   ``p +- delta`` for every inner probability: a proposed band per rank;
2. narrowing: one aggregate per round counts the rows below and up to every
   proposed bound. A bound that would cut the rank off is not taken (the last
   proven one stays); each band that still holds more than ``BAND_ROWS`` rows is
   proposed a narrower one, from a sketch of its rows or, without progress,
   its middle. A band of one value needs no rows at all;
3. the rows of the remaining bands, at most ``BAND_ROWS`` each, grouped by
   value, go to the driver, which reads the order statistics off.

They are interpolated as ``lo + (h - floor h) (hi - lo)`` around ``h = (n-1) p``.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000
BAND_ROWS = 20_000


def _lit_array(values: list[float] | None) -> Column:
    if values is None:
        return F.lit(None).cast("array<double>")
    return F.array(*[F.lit(float(v)).cast("double") for v in values])


def quantile_edges(df: DataFrame, cols: list[str], probs: list[float], method: str = "exact",
                   accuracy: int = DEFAULT_ACCURACY) -> dict[str, Column]:
    """Quantile edges of each column as an ``array<double>`` column expression.

    ``exact`` (default): bounded distributed search, result as literals.
    ``percentile``: Spark's exact aggregate as a lazy scalar subquery.
    ``approx``: ``percentile_approx`` as a lazy scalar subquery.
    """
    if method in ("percentile", "approx"):
        arr = F.array(*[F.lit(float(p)) for p in probs])

        def agg(c: str) -> Column:
            v = F.col(c).cast("double")
            q = F.percentile(v, arr) if method == "percentile" else F.percentile_approx(v, arr, accuracy)
            return q.cast("array<double>").alias(c)

        row = df.select(F.struct(*[agg(c) for c in cols]).alias("q")).scalar()
        return {c: row[c] for c in cols}
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    values = exact_quantiles(df, cols, probs, accuracy)
    return {c: _lit_array(values[c]) for c in cols}


def _interp(lo: float, hi: float, frac: float) -> float:
    return lo if frac == 0 or lo == hi else lo + frac * (hi - lo)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    accuracy: int = DEFAULT_ACCURACY) -> dict[str, list[float] | None]:
    """Exact quantiles (linear interpolation) per column; None for an all-null column."""
    # the passes read only these columns; keep them (spillable, recomputable
    # from lineage if an executor is lost) instead of re-running the input plan
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _exact_quantiles(d, cols, probs, accuracy)
    finally:
        d.unpersist()


def _exact_quantiles(d: DataFrame, cols: list[str], probs: list[float],
                     accuracy: int) -> dict[str, list[float] | None]:
    inner = sorted({float(p) for p in probs if 0.0 < p < 1.0})
    delta = 3.0 / accuracy

    # pass 1: counts, extremes, sketch bands
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}")]
        if inner:
            ps = [max(0.0, p - delta) for p in inner] + [min(1.0, p + delta) for p in inner]
            aggs.append(F.percentile_approx(c, F.array(*[F.lit(p) for p in ps]), accuracy).alias(f"pa{i}"))
    r1 = d.agg(*aggs).first()

    bands: dict[tuple[int, int], _Band] = {}
    for i in range(len(cols)):
        for j, p in enumerate(inner if r1[f"n{i}"] else []):
            pa = r1[f"pa{i}"]
            for rank in _ranks(r1[f"n{i}"], p):
                bands.setdefault((i, rank), _Band(i, rank, r1[f"mn{i}"], r1[f"mx{i}"], r1[f"n{i}"], (pa[j], pa[len(inner) + j])))
    while todo := [b for b in bands.values() if b.proposed]:
        counts = d.agg(*[x for k, b in enumerate(todo) for x in b.counts(cols[b.col], k)]).first()
        for k, b in enumerate(todo):
            b.take(*counts[f"b{k}"])
        wide = [b for b in todo if b.rows > BAND_ROWS and b.lo < b.hi]
        sketches = d.agg(*[b.sketch(cols[b.col]).alias(f"s{k}") for k, b in enumerate(wide)]).first() if wide else ()
        for b, got in zip(wide, sketches, strict=True):
            b.propose(*got)
    found = {key: b.lo for key, b in bands.items()}
    if left := [key for key, b in bands.items() if b.lo < b.hi]:
        tagged = d.select(F.explode(F.array_compact(F.array(*[
            F.when(F.col(cols[key[0]]).between(bands[key].lo, bands[key].hi),
                   F.struct(F.lit(k).alias("k"), F.col(cols[key[0]]).alias("v"))) for k, key in enumerate(left)]))).alias("e"))
        at = [bands[key].below for key in left]
        rows = tagged.groupBy("e.k", "e.v").agg(F.count(F.lit(1)).alias("n")).collect()  # at most BAND_ROWS a band
        for k, v, n in sorted(map(tuple, rows)):
            if at[k] <= left[k][1] < at[k] + n:
                found[left[k]] = v
            at[k] += n

    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(cols):
        n = r1[f"n{i}"]
        if not n:
            out[c] = None
            continue
        out[c] = []
        for p in probs:
            first, last = _ranks(n, p)
            out[c].append(float(r1[f"mn{i}"]) if p <= 0.0 else float(r1[f"mx{i}"]) if p >= 1.0
                          else _interp(float(found[(i, first)]), float(found[(i, last)]), (n - 1) * p - first))
    return out


def _ranks(n: int, p: float) -> tuple[int, int]:
    return math.floor((n - 1) * p), math.ceil((n - 1) * p)


class _Band:
    """Values ``lo..hi`` of a column that hold ``rank``; ``below`` rows are less
    than ``lo``, ``rows`` lie in it."""

    def __init__(self, col: int, rank: int, lo: float, hi: float, n: int, proposed: tuple[float, float]):
        self.col, self.rank, self.lo, self.hi, self.below, self.rows = col, rank, lo, hi, 0, n
        self.proposed: tuple[float, float] | None = proposed
        self.halve = False

    def counts(self, c: str, k: int) -> list[Column]:
        a, b = self.proposed
        return [F.array(F.count_if(F.col(c) < F.lit(a)), F.count_if(F.col(c) <= F.lit(a)),
                        F.count_if(F.col(c) < F.lit(b)), F.count_if(F.col(c) <= F.lit(b))).alias(f"b{k}")]

    def take(self, below_a: int, upto_a: int, below_b: int, upto_b: int) -> None:
        """Move to the proposed bounds as far as the rank stays inside."""
        before, upto = self.rows, self.below + self.rows
        for v, less, most in ((self.proposed[0], below_a, upto_a), (self.proposed[1], below_b, upto_b)):
            if v > self.lo and less <= self.rank:
                self.lo, self.below = v, less
            if v < self.hi and self.rank < most:
                self.hi, upto = v, most
        self.rows = upto - self.below
        self.halve = self.rows > before // 2
        self.proposed = None

    def sketch(self, c: str) -> Column:
        inside = F.when(F.col(c).between(self.lo, self.hi), F.col(c))
        at = (self.rank - self.below) / self.rows
        return F.percentile_approx(inside, F.array(F.lit(max(0.0, at - 0.01)), F.lit(min(1.0, at + 0.01))), 1000)

    def propose(self, a: float, b: float) -> None:
        if self.halve:  # a half always moves one bound
            a = b = self.lo + (self.hi - self.lo) / 2
            if not self.lo < a < self.hi:  # neighbours among doubles
                a, b = self.hi, self.lo
        self.proposed = (a, b)
