"""Exact k nearest neighbours by packed blocks: every block of vectors meets every
other, and no vector is shuffled.

Where no bound separates the vectors, all pairs have to be looked at, and sending
each vector to every place that needs it takes many times the collection on disk.
Here the collection is written once, ``BLOCK_ROWS`` vectors to a row (their bytes
compressed), and the rows of that table are joined with each other by a Cartesian
product, whose tasks read both sides from the shared folder. What is shuffled is
what is found: k rows of three numbers for a vector, as often as its block was
dealt to a task.

Distances are screened in single precision: only pairs that may be among the k
least, by a bound of the rounding error, are computed in double precision. A task
holds one read partition of the table, two blocks, one matrix of distances and the
neighbours found for at most ``HELD_BLOCKS`` blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

BLOCK_ROWS = 2048
#: Numbers of a block at most, and of candidate pairs computed at once.
BLOCK_VALUES, PAIR_VALUES = 2_000_000, 2_000_000
#: Candidates of a row from which on the whole row is computed by one product.
MANY = 64
#: Values of which the least stands for all when a first bound is looked for.
GROUP = 16
#: Blocks whose neighbours a task holds.
HELD_BLOCKS = 256
#: Tasks a slot.
TASKS_A_SLOT = 4
#: Distances are rounded to so many places, so that equal vectors tie whatever block computed them.
PLACES = 12
#: Beyond this norm single precision may overflow.
LARGE = 1e15
_FOUND = "q long, c long, distance double"


class Rows:
    """Vectors by ascending id, of length 1 for ``cosine`` (or 0), with what the screening needs."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, metric: str):
        order = np.argsort(ids, kind="stable")
        self.ids, v = ids[order], np.asarray(v, dtype=np.float64)[order]
        if metric == "cosine":
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        self.v, self.sq = v, np.einsum("ij,ij->i", v, v)
        self.norm = np.sqrt(self.sq)
        large = len(v) and self.norm.max(initial=0) > LARGE
        self.screened = v if large else v.astype(np.float32)

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, start: int, stop: int) -> Rows:
        out = object.__new__(Rows)
        for name in ("ids", "v", "sq", "norm", "screened"):
            setattr(out, name, getattr(self, name)[start:stop])
        return out


class Best:
    """The k nearest so far of each row: distances (infinite where there are fewer) and ids."""

    def __init__(self, n: int, k: int):
        self.d, self.c = np.full((n, k), np.inf), np.zeros((n, k), np.int64)

    def part(self, start: int, stop: int) -> Best:
        """Some rows; what is added there is added here."""
        out = object.__new__(Best)
        out.d, out.c = self.d[start:stop], self.c[start:stop]
        return out

    def add(self, q: np.ndarray, d: np.ndarray, c: np.ndarray) -> None:
        """Candidates of rows ``q``; of equal distances the least id stays."""
        if not len(q):
            return
        k = self.d.shape[1]
        at, of = np.unique(q, return_inverse=True)
        held = np.isfinite(self.d[at])
        row = np.concatenate([np.repeat(np.arange(len(at)), held.sum(axis=1)), of])
        d, c = np.concatenate([self.d[at][held], d]), np.concatenate([self.c[at][held], c])
        order = np.lexsort((c, d, row))
        row, d, c = row[order], d[order], c[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        self.d[at[row[keep]], place[keep]], self.c[at[row[keep]], place[keep]] = d[keep], c[keep]

    def found(self, ids: np.ndarray) -> list[np.ndarray]:
        ok = np.isfinite(self.d)
        return [np.repeat(ids, ok.sum(axis=1)), self.c[ok], self.d[ok]]


def screen(q: Rows, c: Rows, metric: str) -> np.ndarray:
    """A matrix that orders, for each row of ``q``, the rows of ``c`` by distance, but for rounding."""
    low = q.screened @ -c.screened.T
    if metric != "cosine":
        low += (c.sq / 2).astype(low.dtype)
    return low


def _distance(dot: np.ndarray, a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """From products and squared lengths. What rounding alone may leave of equal vectors is 0."""
    if metric == "cosine":
        return np.round(1.0 - dot, PLACES) + 0.0
    sq = a + b - 2.0 * dot
    return np.round(np.sqrt(np.where(sq > 1e-14 * (a + b), sq, 0.0)), PLACES) + 0.0


def _bound(low: np.ndarray, k: int, axis: int) -> np.ndarray:
    """What at least k + 1 values along ``axis`` do not exceed (one may be of the row
    itself): the least of some groups of values are partitioned instead of all."""
    n = low.shape[axis]
    g = n // GROUP
    if g > k:
        some = low[:g * GROUP] if axis == 0 else low[:, :g * GROUP]
        low = some.reshape(GROUP, g, -1).min(axis=0) if axis == 0 else some.reshape(-1, GROUP, g).min(axis=1)
    elif n <= k:
        return np.full(low.shape[1 - axis], np.inf)
    least = np.partition(low.T if axis == 0 else low, k, axis=1)[:, k].astype(np.float64)
    return np.where(np.isnan(least), np.inf, least)


def search(best: Best, q: Rows, c: Rows, metric: str, low: np.ndarray, back: bool = False) -> None:
    """Bring ``best`` of the rows of ``q`` up to date with those of ``c``; ``low`` is
    ``screen(q, c)``, or with ``back`` what the other direction used, ``screen(c, q)``.
    A row is no neighbour of one with its id."""
    k, n = best.d.shape[1], len(c)
    if not len(q) or not n:
        return
    # twice the most that rounding may move a value of ``low``
    eps = 2.0 ** -52 if low.dtype == np.float64 else 2.0 ** -23
    most = q.norm * c.norm.max() + (0.0 if metric == "cosine" else (q.sq if back else 0.0) + c.sq.max())
    slack = 2.0 * (q.v.shape[1] + 8) * eps * np.maximum(most, 1e-30)
    if back and metric != "cosine":  # from |q|²/2 - qc to |c|²/2 - qc
        low = low + ((c.sq / 2)[:, None] - (q.sq / 2)[None, :]).astype(low.dtype)
    kth = best.d[:, -1].copy()
    cut = (kth - 1.0 if metric == "cosine" else (kth * kth - q.sq) / 2) + slack
    new = np.flatnonzero(~np.isfinite(kth))
    if len(new):
        cut[new] = (_bound(low[:, new], k, 0) if back else _bound(low[new], k, 1)) + 2 * slack[new]
    cut = np.nextafter(cut.astype(low.dtype), low.dtype.type(np.inf))
    if back:
        col, row = np.divmod(np.flatnonzero(low <= cut[None, :]), len(q))
    else:
        row, col = np.divmod(np.flatnonzero(low <= cut[:, None]), n)
    many = np.bincount(row, minlength=len(q)) > MANY
    few = ~many[row]
    row, col = row[few], col[few]
    other = q.ids[row] != c.ids[col]
    row, col = row[other], col[other]
    step = max(1, PAIR_VALUES // max(1, q.v.shape[1]))
    d = np.empty(len(row))
    for at in range(0, len(row), step):
        i, j = row[at:at + step], col[at:at + step]
        d[at:at + step] = _distance(np.einsum("ij,ij->i", q.v[i], c.v[j]), q.sq[i], c.sq[j], metric)
    near = d <= kth[row]  # not of vectors that hold no numbers
    best.add(row[near], d[near], c.ids[col[near]])
    many = np.flatnonzero(many)
    step = max(1, PAIR_VALUES // n)
    for at in range(0, len(many), step):
        i = many[at:at + step]
        d = _distance(q.v[i] @ c.v.T, q.sq[i][:, None], c.sq[None, :], metric)
        d[(q.ids[i][:, None] == c.ids[None, :]) | ~(d <= kth[i][:, None])] = np.inf
        part = np.argsort(d, axis=1, kind="stable")[:, :k]  # equal ones by ascending id
        d = np.take_along_axis(d, part, axis=1)
        ok = np.isfinite(d)
        best.add(np.repeat(i, ok.sum(axis=1)), d[ok], c.ids[part[ok]])


# ---------------------------------------------------------------- the table of blocks
def _packed(rows: DataFrame, single: bool) -> DataFrame:
    """``id``, ``v`` -> ``block``, ``n`` and the bytes of ids and vectors, compressed."""
    kind = np.float32 if single else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                dims = len(batch.column(1)[start])
                some = batch.slice(start, max(1, min(BLOCK_ROWS, BLOCK_VALUES // dims)))
                lists = some.column(1)
                if (np.diff(lists.offsets.to_numpy()) != dims).any():
                    raise ValueError("vectors must have equal lengths")
                v = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
                raw = some.column(0).to_numpy().astype(np.int64).tobytes() + v.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([some.num_rows], pa.int32()), pa.array([dims], pa.int32()),
                                                  pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], ["n", "dims", "data"])
                start += some.num_rows

    return rows.mapInArrow(pack, "n int, dims int, data binary").select(F.monotonically_increasing_id().alias("block"), "n", "dims", "data")


def _unpacked(n: int, dims: int, data: bytes, single: bool, metric: str) -> Rows:
    kind = np.dtype(np.float32 if single else np.float64)
    raw = pa.decompress(data, decompressed_size=n * (8 + dims * kind.itemsize), codec="zstd", asbytes=True)
    return Rows(np.frombuffer(raw, np.int64, n), np.frombuffer(raw, kind, n * dims, 8 * n).reshape(n, dims), metric)


def _meet(k: int, metric: str, single: bool):
    """Pairs of blocks -> the k nearest of the first block's rows among all it met in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Best]] = {}
        left, at = None, None

        def told() -> Iterator[pa.RecordBatch]:
            for ids, best in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found(ids)], ["q", "c", "distance"])
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                a, an, adims, adata, bn, bdims, bdata = (batch.column(j)[i].as_py() for j in range(7))
                if adims != bdims:
                    raise ValueError("vectors must have equal lengths")
                if a != at:
                    left, at = _unpacked(an, adims, adata, single, metric), a
                    if a not in held and len(held) >= HELD_BLOCKS:
                        yield from told()
                best = held.setdefault(a, (left.ids, Best(an, k)))[1]
                right = _unpacked(bn, bdims, bdata, single, metric)
                search(best, left, right, metric, screen(left, right, metric))
        yield from told()
    return run


def separable(rows: DataFrame, metric: str, sample: int = 2048, pivots: int = 64) -> float:
    """About which share of the pairs pivot cells would look at, from a sample of
    ``id``, ``v``: each row's own cell bounds its nearest neighbour in the sample."""
    from .knn_cells import Cells, _euclid

    got = rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample).collect()
    if len({len(r["v"]) for r in got}) > 1:
        raise ValueError("vectors must have equal lengths")
    r = Rows(np.arange(len(got)), np.array([x["v"] for x in got], float).reshape(len(got), -1), metric)
    v = r.v[r.norm > 0]
    if len(v) <= pivots:
        return 1.0
    d = _euclid(v, v[:pivots])
    own = d.argmin(axis=1)
    there = d[np.arange(len(v)), own]
    inside = [there[own == p] for p in range(pivots)]
    cells = Cells(v[:pivots], np.array([len(x) for x in inside]), np.array([x.min(initial=np.inf) for x in inside]),
                  np.array([x.max(initial=0) for x in inside]))
    apart = _euclid(v, v)
    np.fill_diagonal(apart, np.inf)
    apart[own[:, None] != own[None, :]] = np.inf
    visit = cells.bounds(v, own) <= apart.min(axis=1)[:, None]
    return float((visit * cells.size[None, :]).sum() / len(v) ** 2)


def knn_blocks(rows: DataFrame, k: int, metric: str) -> DataFrame:
    """``(q, c, distance, rank)`` of every row of ``rows`` (``id``, ``v``)."""
    spark = rows.sparkSession
    single = dict(rows.dtypes)["v"] == "array<float>"
    path = scratch_path(spark, f"knn-blocks-{uuid.uuid4().hex}")
    packed = _packed(rows, single)
    packed.write.option("compression", "none").parquet(path)  # its bytes are compressed
    blocks = spark.read.schema(packed.schema).parquet(path)
    names = [F.col(c).alias(f"b_{c}") for c in ("n", "dims", "data")]
    pairs = blocks.select("block", "n", "dims", "data").crossJoin(blocks.select(*names).hint("shuffle_replicate_nl"))
    # the product numbers its partitions row by row, so a task of consecutive ones sees few left blocks
    parts, slots = blocks.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    pairs = pairs.coalesce(min(parts * parts, max(parts, TASKS_A_SLOT * slots)))
    found = pairs.mapInArrow(_meet(k, metric, single), _FOUND)
    w = Window.partitionBy("q").orderBy("distance", "c")
    near = found.repartition("q").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out, size = scratch_path(spark, f"knn-found-{uuid.uuid4().hex}"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "4")  # pairs of blocks, not rows of numbers
    try:
        near.write.parquet(out)
    finally:
        spark.conf.set(size, before)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(near.schema).parquet(out)
