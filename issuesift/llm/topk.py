"""Exact top-k search by an impact-ordered index, score at a time.

Vectors become integer vectors, ``floor(scale * x)``. They are dealt over
shards of bounded size; a shard indexes every dimension as posting segments
ordered by value. For a query, segments are processed by descending quantised
impact (query component times the segment's extreme value), adding their
postings to accumulators. What a vector can still gain is bounded by the
impact of the next segment of each dimension it was not met in. The vectors
with the best partial scores are scored exactly, which proves a threshold;
the search stops only when few vectors can still reach it, and those are
scored exactly. Without such a proof further segments are processed, at last
all of them, so results are exact in every case.

Defined cases: null vectors, vectors that hold null or non-finite components
and rows without an id take no part; shorter vectors count as padded with
zeros; repeated rows are separate candidates, but rows that share the query's
id never are, and they ask once, with the least vector; ties go to the smaller id; an empty table gives no rows; other
columns are not read. Inner products must fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARD = 4096
QUERIES = 1024
SEGMENT = 128
IMPACT_BITS = 6  # impacts are compared in steps of 2**6


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id``, ``v``: the integer form of every vector that takes part."""
    v = F.col(f"`{vec_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return (rows.where(v.isNotNull() & ~bad & F.col(f"`{id_col}`").isNotNull())
            .select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v")))


def _stack(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


class Index:
    """Posting segments of a shard, per dimension in both directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        up = np.argsort(vectors, axis=0, kind="stable").T  # postings by dimension, smallest value first
        self.order = {1: np.ascontiguousarray(up[:, ::-1]), -1: np.ascontiguousarray(up)}
        self.value = {s: np.take_along_axis(vectors.T, o, axis=1) for s, o in self.order.items()}

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the shard's best ``k`` candidates."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        mine = self.ids == query_id
        signs = np.sign(q).astype(int)
        heads = np.stack([q[d] * self.value[signs[d]][d, ::SEGMENT] for d in dims]) if len(dims) else np.zeros((0, 1), np.int64)
        n_seg = heads.shape[1]
        by_impact = np.argsort(-(heads.ravel() >> IMPACT_BITS), kind="stable")
        for share in (0.45, 0.7, 1.0):
            # impacts fall within a dimension, so what is processed is a prefix of each
            done = np.bincount(by_impact[:int(np.ceil(share * len(by_impact)))] // n_seg, minlength=len(dims))
            gained = np.zeros(n, np.int64)
            bound = 0
            for j, d in enumerate(dims):
                most = min(n, done[j] * SEGMENT)
                ahead = heads[j, done[j]] if done[j] < n_seg else 0  # no posting left can add more
                bound += ahead
                gained[self.order[signs[d]][d, :most]] += q[d] * self.value[signs[d]][d, :most] - ahead
            gained[mine] = np.iinfo(np.int64).min // 2
            free = n - int(mine.sum())
            if free <= 4 * k:
                possible = np.flatnonzero(~mine)
                break
            seeds = np.argpartition(-gained, 4 * k)[:4 * k]
            exact = np.where(mine[seeds], np.iinfo(np.int64).min // 2, self.vectors[seeds] @ q)
            proven = np.partition(exact, len(exact) - k)[len(exact) - k]
            possible = np.flatnonzero((gained + bound >= proven) & ~mine)
            if len(possible) <= max(8 * k, n // 16):
                break
        score = self.vectors[possible] @ q
        best = np.lexsort((self.ids[possible], -score))[:k]
        return possible[best], score[best]


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
                scale: int = 1024) -> DataFrame:
    """The ``k`` rows of highest inner product for every row where ``is_query``
    (an expression over ``id``): ``query_id``, ``rank``, ``vec_id``, ``score``."""
    whole = stage(integer_vectors(rows, id_col, vec_col, scale), "topk-vectors")
    n, asked, width = whole.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    shards, blocks, width = max(1, -(-n // SHARD)), max(1, -(-asked // QUERIES)), width or 0
    base = whole.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    data = base.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asked_once = whole.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    ask = (asked_once.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
           .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))

    def search(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(ask):
            index = Index(data["id"].to_numpy(np.int64), _stack(data["v"], width))
            for query_id, q in zip(ask["id"].to_numpy(np.int64), _stack(ask["v"], width), strict=True):
                at, score = index.search(query_id, q, k)
                out["query_id"] += [query_id] * len(at)
                out["vec_id"] += index.ids[at].tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out).astype("int64")

    key = ("shard", "block")
    found = data.groupBy(*key).cogroup(ask.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
