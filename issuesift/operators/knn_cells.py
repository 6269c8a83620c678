"""Exact k nearest neighbours by pivot cells (K1, K3, J7): a k-NN join that
leaves out what the triangle inequality proves too far away.

1. Pivots are rows taken in hash order; every vector belongs to the cell of its
   nearest pivot. Cells are measured, those above twice the wanted size get
   pivots of their own, and what no pivot can divide (copies) is dealt into
   tiles by id, so no task holds more than about ``CELL_ROWS`` vectors.
2. Wave 1 searches each vector's own tile: its k-th distance there bounds what
   may still be a neighbour.
3. Wave 2 visits the one other cell of least lower bound, which tightens that
   distance; wave 3 all remaining cells whose lower bound does not exceed it.

The lower bound of a query ``q`` and a cell with pivot ``p`` and member
distances ``[lo, hi]`` is the greatest of ``d(q,p) - hi``, ``lo - d(q,p)`` and
``(d(q,p) - d(q,own pivot)) / 2``. Cosine runs on unit vectors, whose Euclidean
distance is ``sqrt(2 * (1 - cosine))``; vectors of norm 0 are at distance 1 from
all others and are kept apart. Cells visited in vain cost time, never rows.

Vectors that no bound separates (random ones in many dimensions) visit all
cells: the work is then that of the block grid, split the same way. The driver
holds the pivots (``MAX_PIVOTS`` rows, ``PIVOT_VALUES`` numbers at most) and one
row a cell; visitors of a much visited cell are dealt into parts of about
``VISITORS``. Cells, tiles and parts grow with the collection once there would be
more than about ``SPREAD`` of them, so a vector is sent no more often for it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

CELL_ROWS, VISITORS = 2048, 4096
MAX_PIVOTS, PIVOT_VALUES = 4096, 4_000_000
#: A vector is sent to about so many cells and parts at most, however many vectors there are.
SPREAD = 32
#: Rounds in which oversized cells get pivots of their own.
REFINE = 3
#: Distances are rounded to so many places, so that equal vectors tie whatever block computed them.
PLACES = 12
#: Bounds are widened by this for the rounding of distances.
SLACK = 1e-6
_FOUND = "q long, c long, distance double"


def _stage(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"knn-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and (len(flat) % n or (np.diff(column.offsets.to_numpy()) != len(flat) // n).any()):
        raise ValueError("vectors must have equal lengths")
    return flat.reshape(n, -1)


def _euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def _between(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    d = 1.0 - a @ b.T if metric == "cosine" else _euclid(a, b)
    return np.round(d, PLACES) + 0.0


def _nearest(d: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int, most: np.ndarray | None = None) -> pd.DataFrame:
    """Per row of ``d`` the k least (distance, id), at most ``most``; ``cid``
    ascends, so a stable order resolves ties. A row is no neighbour of itself."""
    d[qid[:, None] == cid[None, :]] = np.inf
    if most is not None:
        d[d > most[:, None]] = np.inf
    kk = min(k, d.shape[1])
    part = np.argpartition(d, kk - 1, axis=1)[:, :kk]
    cut = np.take_along_axis(d, part, axis=1).max(axis=1)
    ties = np.flatnonzero((d <= cut[:, None]).sum(axis=1) > kk)
    if len(ties):
        part[ties] = np.argsort(d[ties], axis=1, kind="stable")[:, :kk]
    r, c = np.repeat(np.arange(len(d)), kk), part.ravel()
    found = d[r, c]
    ok = np.isfinite(found)
    return pd.DataFrame({"q": qid[r[ok]], "c": cid[c[ok]], "distance": found[ok]})


@dataclass
class Cells:
    """The cells: pivots, and per cell its size, least and greatest member
    distance from the pivot (the driver's and the tasks' copy)."""

    pivots: np.ndarray
    size: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def bounds(self, v: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances from rows of ``v`` to every cell."""
        d = _euclid(v, self.pivots)
        low = np.maximum(np.maximum(d - self.hi[None, :], self.lo[None, :] - d), (d - d[np.arange(len(d)), own][:, None]) / 2)
        low[np.arange(len(d)), own] = 0.0
        low[:, self.size == 0] = np.inf
        return np.maximum(low - SLACK * (1.0 + np.abs(d)), 0.0)


def _placed(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id``, ``v``, ``cell`` (of the nearest pivot), ``d`` (its distance)."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PIVOT_VALUES // max(1, len(pivots)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                d = _euclid(_matrix(part.column(1)), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "d"])

    return points.mapInArrow(place, "id long, v array<double>, cell int, d double")


def _cells(points: DataFrame, n: int, dims: int, wanted: int, cell_rows: int) -> tuple[Cells, DataFrame]:
    """Pivots by hash order, refined where measured cells are too large."""
    most = max(1, min(MAX_PIVOTS, PIVOT_VALUES // max(1, dims)))
    order = F.xxhash64("id", F.lit(11))
    pivots = np.array([r["v"] for r in points.orderBy(order, "id").limit(min(wanted, most)).select("v").collect()], float)
    pivots = np.unique(pivots, axis=0)
    target = max(1, min(cell_rows, math.ceil(n / len(pivots))))
    for round_ in range(REFINE + 1):
        placed = _stage(_placed(points, pivots), "placed")
        got = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
        large = {r["cell"]: math.ceil(r["n"] / target) for r in got if r["n"] > 2 * target and r["hi"] > SLACK}
        room = most - len(pivots)
        if round_ == REFINE or not large or room <= 0:
            break
        w = Window.partitionBy("cell").orderBy(order, "id")
        take = F.element_at(F.create_map(*[F.lit(x) for kv in large.items() for x in kv]), F.col("cell"))
        more = (placed.where(F.col("cell").isin(list(large))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= min(64, max(large.values())))
                .where(F.col("r") <= take).orderBy("r", "cell").limit(room).select("v").collect())
        grown = np.unique(np.vstack([pivots, np.array([r["v"] for r in more], float)]), axis=0)
        if len(grown) == len(pivots):
            break
        pivots = grown
    size, lo, hi = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in got:
        size[r["cell"]], lo[r["cell"]], hi[r["cell"]] = r["n"], r["lo"], r["hi"]
    return Cells(pivots, size, lo, hi), placed


def _search_own(k: int, metric: str):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        ids, v = g["id"].to_numpy(np.int64), np.vstack(g["v"].to_numpy())
        step = max(1, PIVOT_VALUES // len(v))
        return pd.concat([_nearest(_between(v[at:at + step], v, metric), ids[at:at + step], ids, k) for at in range(0, len(v), step)])
    return run


def _search_visited(k: int, metric: str):
    def run(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "distance": np.zeros(0)})]
        if len(visitors) and len(residents):
            residents = residents.sort_values("id", kind="stable")
            cid, c = residents["id"].to_numpy(np.int64), np.vstack(residents["v"].to_numpy())
            qid, q, most = visitors["q"].to_numpy(np.int64), np.vstack(visitors["qv"].to_numpy()), visitors["most"].to_numpy()
            step = max(1, PIVOT_VALUES // len(c))
            for at in range(0, len(q), step):
                part = slice(at, at + step)
                out.append(_nearest(_between(q[part], c, metric), qid[part], cid, k, most[part]))
        return pd.concat(out)
    return run


def _asks(queries: DataFrame, cells: Cells, tiled: np.ndarray, wave: int, metric: str, count: bool) -> DataFrame:
    """Visits of wave 2 or 3 from rows ``id``, ``v``, ``cell``, ``first``,
    ``most`` (the k-th distances after wave 1 and so far): ``cell``, ``q``,
    ``qv``, ``most``; with ``count`` only how many visit each ``cell``. ``tiled``
    tells which cells wave 1 searched by tiles."""
    def radius(most: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 * np.maximum(most, 0.0)) if metric == "cosine" else most

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, n = max(1, PIVOT_VALUES // max(1, len(cells.size))), np.zeros(len(cells.size), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own = part.column(2).to_numpy()
                rows = np.arange(len(own))
                first, most = (part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (3, 4))
                low = cells.bounds(_matrix(part.column(1)), own)
                low[rows[~tiled[own]], own[~tiled[own]]] = np.inf  # wave 1 saw the whole cell
                nearest = low.argmin(axis=1)
                visit = np.zeros(low.shape, bool)
                visit[rows, nearest] = low[rows, nearest] <= radius(first)
                if wave == 3:
                    visit = (low <= radius(most)[:, None]) & ~visit
                q, cell = np.nonzero(visit)
                if count:
                    n += np.bincount(cell, minlength=len(n))
                    continue
                for s in range(0, len(q), 10_000):
                    i = pa.array(q[s:s + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[s:s + 10_000], pa.int32()), part.column(0).take(i), part.column(1).take(i),
                                                      pa.array(most).take(i)], ["cell", "q", "qv", "most"])
        if count:
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["cell", "visits"])

    rows = queries.select("id", "v", "cell", "first", "most")
    return rows.mapInArrow(ask, "cell int, visits long" if count else "cell int, q long, qv array<double>, most double")


def knn_cells(df: DataFrame, k: int = 4, metric: str = "cosine", id_col: str = "number", vec_col: str = "embedding",
              cells: int | None = None, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, dict]:
    """``(q, c, distance, rank)`` of every embedded row, and what was done:
    ``rows``, ``cells``, ``compared`` (pairs whose distance was computed)."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError("metric must be cosine or euclidean")
    v = F.transform(vec_col, lambda x: x.cast("double"))
    rows = df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("norm", norm if metric == "cosine" else F.lit(1.0))
    unit = F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")) if metric == "cosine" else F.col("v")
    rows = _stage(rows.select("id", unit.alias("v"), (F.col("norm") == 0).alias("zero")), "points")
    points = rows.where("not zero").select("id", "v")
    n, dims = points.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    found, did = [], {"rows": n, "cells": 0, "compared": 0}
    if n:
        share = math.ceil(n / SPREAD)
        cell_rows = max(cell_rows, share)
        wanted = cells or max(math.ceil(n / cell_rows), min(SPREAD, math.isqrt(n)))
        made, placed = _cells(points, n, dims, wanted, cell_rows)
        tiles = np.maximum(1, -(-made.size // max(CELL_ROWS, 2 * share if share > CELL_ROWS else 0)))
        did["cells"] = len(made.pivots)
        table = df.sparkSession.createDataFrame(pd.DataFrame({"cell": np.arange(len(tiles), dtype=np.int32), "tiles": tiles}), "cell int, tiles long")
        table = F.broadcast(table)  # at most MAX_PIVOTS rows
        home = placed.join(table, "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
        found.append(_stage(home.groupBy("cell", "tile").applyInPandas(_search_own(k, metric), _FOUND), "own"))
        did["compared"] += int(sum(s * -(-s // t) for s, t in zip(made.size.tolist(), tiles.tolist())))
        reach = None
        for wave in (2, 3):
            most = _merged(found, k).groupBy("q").agg(F.max("distance").alias("most"), F.count("*").alias("n"))
            far = F.when(F.col("n") >= k, F.col("most")).otherwise(F.lit(float("inf")))
            queries = placed.join(most.select(F.col("q").alias("id"), far.alias("most")), "id", "left").withColumn(
                "most", F.coalesce("most", F.lit(float("inf"))))
            if reach is None:
                queries = queries.withColumn("first", F.col("most"))
            else:
                queries = queries.join(reach, "id")
            queries = _stage(queries, "bounds")
            reach = queries.select("id", "first")
            visits = {r["cell"]: r["n"] for r in _asks(queries, made, tiles > 1, wave, metric, True).groupBy("cell").agg(F.sum("visits").alias("n")).collect()}
            if not visits:
                continue
            did["compared"] += sum(m * int(made.size[c]) for c, m in visits.items())
            parts = pd.DataFrame({"cell": np.array(list(visits), np.int32), "parts": [-(-m // max(VISITORS, share)) for m in visits.values()]})
            parts = F.broadcast(df.sparkSession.createDataFrame(parts, "cell int, parts long"))
            zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
            left = (_asks(queries, made, tiles > 1, wave, metric, False).join(parts, "cell").join(table, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")))
                    .withColumn("tile", F.explode(F.sequence(zero, F.col("tiles") - one))))
            right = home.join(parts, "cell").withColumn("part", F.explode(F.sequence(zero, F.col("parts") - one)))
            right = right.select(F.col("cell").alias("rcell"), F.col("tile").alias("rtile"), F.col("part").alias("rpart"), "id", "v")
            met = left.groupBy("cell", "tile", "part").cogroup(right.groupBy("rcell", "rtile", "rpart")).applyInPandas(_search_visited(k, metric), _FOUND)
            found.append(_stage(met, f"wave{wave}"))
    if metric == "cosine":
        found += _with_zeros(rows, points, k)
    if not found:
        found = [df.sparkSession.createDataFrame([], _FOUND)]
    w = Window.partitionBy("q").orderBy("distance", "c")
    return _merged(found, k).withColumn("rank", F.row_number().over(w)).select("q", "c", "distance", "rank"), did


def _merged(found: list[DataFrame], k: int) -> DataFrame:
    """The k least of what the waves found; a pair may come twice."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    w = Window.partitionBy("q").orderBy("distance", "c")
    return every.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _with_zeros(rows: DataFrame, points: DataFrame, k: int) -> list[DataFrame]:
    """Pairs with vectors of norm 0, at distance 1: the least ids will do, for
    they tie. At most k + 1 of them are literals of the plan."""
    zeros = [r["id"] for r in rows.where("zero").orderBy("id").limit(k + 1).collect()]
    if not zeros:
        return []
    least = [r["id"] for r in rows.orderBy("id").limit(k + 1).collect()]

    def pairs(q: DataFrame, ids: list[int]) -> DataFrame:
        return q.select(F.col("id").alias("q"), F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("c"), F.lit(1.0).alias("distance")).where("q <> c")
    return [pairs(points, zeros), pairs(rows.where("zero"), least)]
