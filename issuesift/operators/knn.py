"""Vector operators: cosine (K4), similar-to-one (K2), exact k-NN (K1, K3),
approximate k-NN (K5) and a 2-D layout (K6).

Exact all-pairs k-NN is O(n^2 d) work; the plan makes it embarrassingly
parallel and skew-free:

* every embedded issue gets a block ``pmod(xxhash64(id), B)``; ids are unique,
  so blocks are even (no hot block even when one value repeats a lot);
* each row is replicated to the B unordered block pairs that contain its
  block; a pair ``(lo, hi)`` is one task with one dense matrix product in
  NumPy that answers both directions -- B(B+1)/2 independent tasks;
* a task computes its distances in tiles of ``TILE_ROWS`` x ``TILE_ROWS`` and
  keeps, per query row, the k smallest ``(distance, id)`` candidates (ties at
  the cut resolved by id, so duplicates cannot blow up the output); its memory
  is its rows and one tile, however few blocks there are;
* the B*k candidates per query are reduced by ``row_number() <= k``, which
  Spark plans as a partial ``WindowGroupLimit`` before the shuffle.

Output per query is bounded by k. B defaults to ``ceil(n / block_rows)``, or
more where that would leave task slots idle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn_blocks import Best, Rows, knn_blocks, search, separable
from .knn_blocks import screen as _distances
from .knn_cells import SPREAD, knn_cells

KEY = ["repo", "number"]
DEFAULT_BLOCK_ROWS = 2048
#: From so many vectors on the pivot cells of ``knn_cells`` or the blocks of ``knn_blocks`` search instead of the grid.
CELLS_FROM = 50_000
#: Cells pay where they leave out all but such a share of the pairs.
CELLS_SHARE = 0.1
MIN_BLOCK_ROWS = 128
#: Distances a task holds at once: so many rows by so many.
TILE_ROWS = 2048
#: Blocks of one bucket of the hash search at most.
BUCKET_BLOCKS = 8


# ---------------------------------------------------------------- K4 / K2
def cosine(a: Column, b: Column) -> Column:
    """K4: cosine similarity of two arrays; 0 when either norm is 0, null when
    the lengths differ (the reference would silently use the common prefix)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return (F.when(F.size(a) != F.size(b), F.lit(None).cast("double"))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(dot / (na * nb)))


def has_embedding(col: str = "embedding") -> Column:
    """P10: non-null, non-empty embedding."""
    return F.col(col).isNotNull() & (F.size(F.col(col)) > 0)


def similar_issues(df: DataFrame, number: int, threshold: float = 0.8, limit: int = 10,
                   status: str | None = None) -> DataFrame:
    """K2: issues whose cosine similarity to issue ``number`` is >= threshold,
    most similar first (ties: storage order), the target excluded. Empty when
    the target is missing or has no embedding. The target vector is read first
    and enters the plan as a literal with its norm, so the scan of all other
    issues stays a narrow filter."""
    from ..functions.predicates import status_predicate

    if limit < 0:
        raise ValueError("limit must be a non-negative integer")
    # one vector of the target: a bounded lookup, inlined as a literal so the
    # similarity of every other row is a JVM-side expression
    row = (df.where(F.col("number") == F.lit(number)).orderBy("pos").limit(1)
           .select(F.col("embedding")).first())
    cols = [c for c in ("number", "title", "summary", "url", "state") if c in df.columns]
    if row is None or not row[0]:
        return df.where(F.lit(False)).select(*cols, F.lit(None).cast("double").alias("similarity"))
    vec = [float(x) for x in row[0]]
    norm = math.sqrt(sum(x * x for x in vec))
    dot = F.aggregate(F.zip_with(F.lit(vec), F.col("embedding"), lambda x, y: x * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    other = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    sim = (F.when(F.size("embedding") != len(vec), F.lit(None).cast("double"))
           .when((other == 0) | F.lit(norm == 0), F.lit(0.0)).otherwise(dot / (F.lit(norm) * other)))
    cand = (df.where((F.col("number") != F.lit(number)) & has_embedding() & status_predicate(status))
            .select("pos", *cols, sim.alias("similarity"))
            .where(F.col("similarity") >= F.lit(threshold)))
    return cand.orderBy(F.col("similarity").desc(), F.col("pos").asc()).limit(limit).drop("pos")


# ---------------------------------------------------------------- K1 / K3 exact
def _pair_topk(k: int, metric: str):
    """One (lo, hi) block pair, tile by tile: one matrix serves both directions, and
    only pairs that it does not prove too far are computed exactly (``knn_blocks``)."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(g["lo"].iloc[0]), int(g["hi"].iloc[0])

        def rows(part: pd.DataFrame) -> Rows:
            return Rows(part["id"].to_numpy(np.int64), np.vstack(part["v"].to_numpy()), metric)

        a, b = g[g["blk"] == lo], g[g["blk"] == hi]
        if a.empty or b.empty:
            return pd.DataFrame({"q": pd.Series([], dtype="int64"), "c": pd.Series([], dtype="int64"),
                                 "distance": pd.Series([], dtype="float64")})
        a = rows(a)
        b = a if lo == hi else rows(b)
        best, back = Best(len(a), k), Best(len(b), k)
        for i in range(0, len(a), TILE_ROWS):
            for j in range(0, len(b), TILE_ROWS):
                q, c = a.part(i, i + TILE_ROWS), b.part(j, j + TILE_ROWS)
                low = _distances(q, c, metric)
                search(best.part(i, i + TILE_ROWS), q, c, metric, low)
                if lo != hi:
                    search(back.part(j, j + TILE_ROWS), c, q, metric, low, back=True)
        found = [best.found(a.ids), *([] if lo == hi else [back.found(b.ids)])]
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("q", "c", "distance"), zip(*found))})
    return run


def knn_pairs(df: DataFrame, k: int = 4, metric: str = "cosine", id_col: str = "number",
              vec_col: str = "embedding", num_blocks: int | None = None,
              block_rows: int = DEFAULT_BLOCK_ROWS, method: str = "auto") -> DataFrame:
    """Exact k nearest neighbours of every embedded row: ``(q, c, distance, rank)``.

    Rows are hashed into B blocks; every unordered block pair (lo <= hi) is one
    task holding both blocks, and one distance matrix answers both directions,
    so each vector is shipped B times and each distance computed once
    (B(B+1)/2 tasks). ``df`` holds one collection (ids unique); ``metric`` is
    ``cosine`` (1 - cosine similarity) or ``euclidean``.

    ``method`` is ``grid`` (the above), ``cells`` (``knn_cells``: pivot cells and
    the triangle inequality), ``blocks`` (``knn_blocks``: all pairs, no vector
    shuffled) or ``auto``: from ``CELLS_FROM`` vectors on cells, where a sample says
    that they leave out most pairs, or else blocks. All are exact and give the same rows.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError("metric must be cosine or euclidean")
    if method not in ("auto", "grid", "cells", "blocks"):
        raise ValueError("method must be auto, grid, cells or blocks")
    if method == "cells":
        return knn_cells(df, k, metric, id_col, vec_col, cell_rows=block_rows)[0]
    emb = df.where(has_embedding(vec_col)).select(F.col(id_col).cast("bigint").alias("id"),
                                                  F.col(vec_col).alias("v"))
    if method == "blocks":
        return knn_blocks(emb, k, metric)
    if num_blocks is None:
        n = emb.count()
        if method == "auto" and n >= CELLS_FROM:
            if separable(emb, metric) > CELLS_SHARE:
                return knn_blocks(emb, k, metric)
            return knn_cells(df, k, metric, id_col, vec_col, cell_rows=block_rows)[0]
        # enough block pairs for all task slots, of at least MIN_BLOCK_ROWS rows a block
        slots = df.sparkSession.sparkContext.defaultParallelism
        spread = min(math.ceil(math.sqrt(2 * slots)), math.ceil(n / MIN_BLOCK_ROWS))
        num_blocks = max(1, spread, min(SPREAD, math.ceil(n / block_rows)))
    B = int(num_blocks)
    blk = F.pmod(F.xxhash64("id"), F.lit(B)).cast("int")
    rep = (emb.select("id", "v", blk.alias("blk"))
           .select("id", "v", "blk", F.explode(F.sequence(F.lit(0), F.lit(B - 1))).alias("other"))
           .select("id", "v", "blk", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi")))
    cand = rep.groupBy("lo", "hi").applyInPandas(_pair_topk(k, metric), schema="q long, c long, distance double")
    w = Window.partitionBy("q").orderBy("distance", "c")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_neighbors(df: DataFrame, k: int = 4, metric: str = "cosine", column: str | None = None,
                  **kw) -> DataFrame:
    """K1 / K3: append ``k<k>_distances`` = array of (issue_number, title, distance),
    nearest first; empty for issues without embedding, and for every issue when
    fewer than k + 1 issues are embedded."""
    column = column or f"k{k}_distances"
    pairs = knn_pairs(df, k, metric, **kw)
    titles = df.select(F.col("number").alias("c"), F.col("title").alias("_t"))
    lists = (pairs.join(titles, "c", "left")
             .groupBy(F.col("q").alias("number"))
             .agg(F.array_sort(F.collect_list(F.struct(
                 "rank", F.col("c").alias("issue_number"), F.col("_t").alias("title"), "distance")))
                 .alias("_l")))
    n_emb = df.where(has_embedding()).select(F.count(F.lit(1))).scalar()
    t = "array<struct<issue_number:bigint,title:string,distance:double>>"
    val = F.transform("_l", lambda s: F.struct(s["issue_number"].alias("issue_number"),
                                               s["title"].alias("title"), s["distance"].alias("distance")))
    out = df.join(lists, "number", "left")
    return out.withColumn(column, F.when((n_emb >= k + 1) & F.col("_l").isNotNull(), val)
                          .otherwise(F.array().cast(t))).drop("_l")


# ---------------------------------------------------------------- K5 approximate
def knn_lsh(df: DataFrame, k: int = 4, bucket_length: float = 1.0, num_tables: int = 4, seed: int = 7,
            block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """K5 (addition): approximate cosine neighbours for collections where the
    exact grid is out of reach. Random-projection LSH (Spark ML) on unit
    vectors puts near vectors into the same bucket of some hash table; each
    bucket is then searched exactly with the bounded block-pair kernel of K1.
    A bucket larger than ``block_rows`` (e.g. many copies of one text) is
    split into sub-blocks by id hash, at most ``BUCKET_BLOCKS``, and searched
    pair by pair in tiles, so no task holds a whole hot bucket and no step emits
    all pairs of a bucket -- only the k best per row and task. Recall is below 1
    by design."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    emb = df.where(has_embedding()).select(F.col("number").cast("bigint").alias("id"), F.col("embedding").alias("v"),
                                           array_to_vector(F.col("embedding")).alias("raw"))
    unit = Normalizer(inputCol="raw", outputCol="vec", p=2.0).transform(emb)
    model = BucketedRandomProjectionLSH(inputCol="vec", outputCol="h", bucketLength=bucket_length,
                                        numHashTables=num_tables, seed=seed).fit(unit)
    hashed = (model.transform(unit)
              .select("id", "v", F.posexplode("h").alias("t", "hv"))
              .select("id", "v", "t", vector_to_array("hv")[0].alias("b")))
    sizes = hashed.groupBy("t", "b").agg(F.count(F.lit(1)).alias("_n"))
    sub = F.least(F.lit(BUCKET_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_rows)))).cast("int")
    # unit vectors fall into 2 / bucket_length + 2 buckets of a table at most
    blocked = (hashed.join(F.broadcast(sizes), ["t", "b"])
               .withColumn("_s", sub)
               .withColumn("blk", F.pmod(F.xxhash64("id"), F.col("_s")).cast("int")))
    rep = (blocked.select("id", "v", "t", "b", "blk", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("o"))
           .select("id", "v", "t", "b", "blk", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi")))
    cand = (rep.groupBy("t", "b", "lo", "hi")
            .applyInPandas(_pair_topk(k, "cosine"), schema="q long, c long, distance double"))
    best = cand.groupBy("q", "c").agg(F.min("distance").alias("distance"))   # found by several tables
    w = Window.partitionBy("q").orderBy("distance", "c")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("q", "c", "distance", "rank"))


# ---------------------------------------------------------------- K6 layout
def layout_2d(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """K6 (re-aimed): 2-D coordinates of embedded issues by PCA (a linear,
    distributed projection instead of single-machine t-SNE). Each axis sign is
    fixed so that its largest-magnitude loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    emb = df.where(has_embedding()).select("number", array_to_vector(F.col("embedding")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(emb)
    pc = model.pc.toArray()  # d x 2 loadings: small, on the driver by construction
    signs = [1.0 if pc[np.argmax(np.abs(pc[:, j])), j] >= 0 else -1.0 for j in range(2)]
    xy = vector_to_array(F.col("p"))
    return model.transform(emb).select(
        "number", (xy[0] * F.lit(signs[0] * scale)).alias("x"), (xy[1] * F.lit(signs[1] * scale)).alias("y"))
