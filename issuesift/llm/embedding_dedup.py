"""Near-duplicate embeddings by an exact metric range join.

Cosine at least ``threshold`` between unit vectors is distance at most
``r = sqrt(2 - 2 * threshold)``. Pivots partition the vectors: each belongs to
the cell of its nearest pivot. By the triangle inequality a vector can have
partners in another cell only if that cell's pivot is at most ``2 r`` farther
than its own (and the cells' bisecting plane at most ``r`` away), so it is
replicated to just those cells, and cells join independently: every vector
meets all its partners in its own cell.

Equal vectors are joined once, as a class with a count. A cell is joined in
tiles of at most about ``TILE`` x ``TILE`` rows, so neither a hot label nor a
hot cell makes a task large. A tile reports link counts and, instead of all
its pairs, one edge per vector to the least vector it reaches in the tile.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and those with a null label, link with nothing; repeated rows are
vectors of their own; rows with a null id keep 0 links and a null component;
vectors of different lengths do not link; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components

TILE = 2048
PER_PIVOT = 16_384
MAX_PIVOTS = 256


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def classes(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``label``, ``vec``, ``rep`` (least id), ``copies``: distinct vectors that can link."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return (rows.select(F.col(f"`{label_col}`").alias("label"), v.alias("vec"), F.col(f"`{id_col}`").cast("long").alias("id"))
            .where(F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(ok, F.lit(False))))


def _cells(vectors: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """One row per vector and cell it is in; ``home`` marks its own."""
    kind = vectors.schema["label"].dataType.simpleString()
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-12))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            rows, cells, home = [], [], []
            sizes = np.array([len(v) for v in vecs], int)
            same = np.flatnonzero(sizes == pivots.shape[1])
            for i in np.flatnonzero(sizes != pivots.shape[1]):  # other lengths: one cell apart
                rows.append(i), cells.append(-int(sizes[i])), home.append(True)
            if len(same):
                unit = _unit(np.array([vecs[i] for i in same], float))
                dist = np.sqrt(np.maximum(2 - 2 * unit @ pivots.T, 0.0))
                own = dist.argmin(axis=1)
                near = dist[np.arange(len(same)), own][:, None]
                plane = (dist ** 2 - near ** 2) / (2 * between[own])
                at, cell = np.nonzero((dist - near <= 2 * radius + 1e-9) & (plane <= radius + 1e-9))
                rows += same[at].tolist()
                cells += cell.tolist()
                home += (own[at] == cell).tolist()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(take) for c in batch.columns), pa.array(cells, pa.int32()), pa.array(home, pa.bool_())],
                ["label", "vec", "rep", "copies", "cell", "home"])

    return vectors.select("label", "vec", "rep", "copies").mapInArrow(
        place, f"label {kind}, vec array<double>, rep long, copies long, cell int, home boolean")


def _join_tile(threshold: float):
    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rep": [], "links": [], "other": []}).astype("int64")
        if not len(left) or not len(right):
            return none
        a, b = (np.stack(x["vec"].to_numpy()).astype(float) for x in (left, right))
        a, b = _unit(a), _unit(b)
        ra, rb = left["rep"].to_numpy(np.int64), right["rep"].to_numpy(np.int64)
        link = (a @ b.T >= threshold) & (ra[:, None] != rb[None, :])
        rows, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        if not len(rows):
            return none
        link = link[np.ix_(rows, cols)]
        ra, rb = ra[rows], rb[cols]
        links = link @ right["copies"].to_numpy(np.int64)[cols]
        far = np.iinfo(np.int64).max
        la, lb = ra.copy(), rb.copy()
        while True:  # least id reachable inside the tile
            na = np.minimum(la, np.where(link, lb[None, :], far).min(axis=1))
            nb = np.minimum(lb, np.where(link, na[:, None], far).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        return pd.DataFrame({"rep": np.concatenate([ra, rb]), "links": np.concatenate([links, np.zeros(len(rb), np.int64)]),
                             "other": np.concatenate([la, lb])})
    return join


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    usable = classes(rows, id_col, vec_col, label_col)
    vectors = stage(usable.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "dedup-classes")
    n = vectors.count()
    n_pivots = min(MAX_PIVOTS, 1 + n // PER_PIVOT)
    picked = vectors.orderBy(F.xxhash64("rep"), "rep").limit(n_pivots).select("vec").collect()
    if picked:
        width = len(picked[0][0])
        pivots = _unit(np.array([r[0] for r in picked if len(r[0]) == width], float))
        radius = float(np.sqrt(2 - 2 * threshold))
        placed = stage(_cells(vectors, pivots, radius), "dedup-cells")
        key = ["label", "cell"]
        tiles = stage(placed.groupBy(*key).agg(F.ceil(F.count_if("home") / TILE).alias("ta"), F.ceil(F.count(F.lit(1)) / TILE).alias("tb"))
                      .where("ta > 0"), "dedup-tiles")
        sized = placed.join(tiles, key)
        mine_a, mine_b = F.pmod(F.xxhash64("rep"), F.col("ta")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("tb"))
        one = F.lit(1).cast("long")
        zero = F.lit(0).cast("long")
        left = sized.where("home").withColumn("a", mine_a).withColumn("b", F.explode(F.sequence(zero, F.col("tb") - one)))
        right = sized.withColumn("b", mine_b).withColumn("a", F.explode(F.sequence(zero, F.col("ta") - one)))
        tile = [*key, "a", "b"]
        left, right = (x.select(*[F.col(c).alias(c) for c in (*tile, "vec", "rep", "copies")]).groupBy(*tile) for x in (left, right))
        met = stage(left.cogroup(right).applyInPandas(_join_tile(threshold), "rep long, links long, other long"), "dedup-links")
    else:
        met = rows.sparkSession.createDataFrame([], "rep long, links long, other long")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(met.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    per = (vectors.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
           .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c")))
    per_id = usable.join(per, ["label", "vec"]).select("id", "n", "c")
    every = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    # repeated rows of one id: each is a row of the result
    known = per_id.groupBy("id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = every.join(known, "id", "left")
    comp_id = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      comp_id.alias("component_id"), F.coalesce(comp_id == F.col("id"), F.lit(False)).alias("kept"))
