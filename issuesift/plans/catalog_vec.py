"""Catalog: vectors, neighbours and the issue graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import sql_with
from ..operators import graph as G
from ..operators import knn as K
from . import enrich as E
from .registry import register

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_L2 = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _knn_sql(dist: str, view: str = "vectors", k: int = 4) -> str:
    return f"""
SELECT number, rank, neighbor, round(d, 6) AS distance FROM (
  SELECT a.number, b.number AS neighbor, {dist} AS d,
         row_number() OVER (PARTITION BY a.number ORDER BY {dist}, b.number) AS rank
  FROM {view} a JOIN {view} b ON a.number <> b.number
  WHERE a.embedding IS NOT NULL AND len(a.embedding) > 0 AND b.embedding IS NOT NULL AND len(b.embedding) > 0)
WHERE rank <= {k}"""


def _pairs_out(p):
    return p.select(F.col("q").alias("number"), F.col("rank").cast("bigint").alias("rank"),
                    F.col("c").alias("neighbor"), F.round("distance", 6).alias("distance"))


# ------------------------------------------------------------------ K4, K2
@register("cosine_pairs", sql_with("vectors") + f"""
SELECT a.number, b.number AS other, round({_COS}, 6) AS cosine
FROM vectors a JOIN vectors b ON b.number = a.number + 1""")
def q_cosine_pairs(spark, sf):
    v = fx.vectors(spark, sf)
    a = v.select("number", F.col("embedding").alias("ea"))
    b = v.select(F.col("number").alias("other"), F.col("embedding").alias("eb"))
    j = a.join(b, F.col("other") == F.col("number") + 1)
    return j.select("number", "other", F.round(K.cosine(F.col("ea"), F.col("eb")), 6).alias("cosine"))


def _similar_sql(n: int, thr: float, limit: int, status: str | None) -> str:
    st = f"AND lower(coalesce(b.state, '')) = '{status}'" if status else ""
    return sql_with("vectors") + f"""
SELECT b.number, b.title, b.url, b.state, round({_COS.replace('a.embedding', 't.embedding')}, 6) AS similarity
FROM vectors b, (SELECT embedding FROM vectors WHERE number = {n} ORDER BY pos LIMIT 1) t
WHERE b.number <> {n} AND b.embedding IS NOT NULL AND len(b.embedding) > 0 {st}
  AND {_COS.replace('a.embedding', 't.embedding')} >= {thr}
ORDER BY {_COS.replace('a.embedding', 't.embedding')} DESC, b.pos LIMIT {limit}"""


@register("similar", _similar_sql(0, 0.3, 10, None))
def q_similar(spark, sf):
    s = K.similar_issues(fx.vectors(spark, sf), 0, threshold=0.3, limit=10)
    return s.select("number", "title", "url", "state", F.round("similarity", 6).alias("similarity"))


@register("similar_open", _similar_sql(5, 0.25, 10, "open"))
def q_similar_open(spark, sf):
    s = K.similar_issues(fx.vectors(spark, sf), 5, threshold=0.25, limit=10, status="open")
    return s.select("number", "title", "url", "state", F.round("similarity", 6).alias("similarity"))


_NEAR = """,
near AS (SELECT pos, number, title, state, url, embedding FROM vectors UNION ALL
  SELECT pos + 1000000, number + 1000000, title, state, url,
         list_transform(embedding, lambda x, i: CASE WHEN i > 32 THEN x / 2 ELSE x END) FROM vectors)"""


@register("similar_default", _similar_sql(0, 0.8, 10, None).replace("\nSELECT b.number", _NEAR + "\nSELECT b.number").replace(
    "FROM vectors b", "FROM near b"))
def q_similar_default(spark, sf):
    """The default threshold, over the vectors and near copies of them (the second half of the components halved)."""
    v = fx.vectors(spark, sf).select("pos", "number", "title", "state", "url", "embedding")
    halved = F.transform("embedding", lambda x, i: F.when(i >= 32, x / 2).otherwise(x)).cast("array<float>")
    copies = v.withColumns({"pos": F.col("pos") + 1000000, "number": F.col("number") + 1000000, "embedding": halved})
    s = K.similar_issues(v.unionByName(copies), 0)
    return s.select("number", "title", "url", "state", F.round("similarity", 6).alias("similarity"))


# ------------------------------------------------------------------ K1, K3
@register("knn_cosine", sql_with("vectors") + _knn_sql(f"1 - {_COS}"))
def q_knn_cosine(spark, sf):
    return _pairs_out(K.knn_pairs(fx.vectors(spark, sf), 4, "cosine"))


@register("knn_cosine_blocked", sql_with("vectors") + _knn_sql(f"1 - {_COS}"))
def q_knn_cosine_blocked(spark, sf):
    # the same query forced onto a 3 x 3 block grid: results must not depend on B
    return _pairs_out(K.knn_pairs(fx.vectors(spark, sf), 4, "cosine", num_blocks=3))


@register("knn_l2", sql_with("vectors") + _knn_sql(_L2))
def q_knn_l2(spark, sf):
    return _pairs_out(K.knn_pairs(fx.vectors(spark, sf), 4, "euclidean"))


@register("knn_cosine_cells", sql_with("vectors") + _knn_sql(f"1 - {_COS}"))
def q_knn_cosine_cells(spark, sf):
    """The same neighbours by pivot cells and the triangle inequality."""
    return _pairs_out(K.knn_pairs(fx.vectors(spark, sf), 4, "cosine", method="cells"))


@register("knn_l2_cells", sql_with("vectors") + _knn_sql(_L2))
def q_knn_l2_cells(spark, sf):
    return _pairs_out(K.knn_pairs(fx.vectors(spark, sf), 4, "euclidean", method="cells"))


@register("knn_lists", sql_with("ivec") + f""",
nb AS (SELECT number, string_agg(CAST(neighbor AS VARCHAR), ',' ORDER BY rank) AS neighbors,
              string_agg(title, '|' ORDER BY rank) AS titles FROM (
  SELECT a.number, b.number AS neighbor, b.title,
         row_number() OVER (PARTITION BY a.number ORDER BY 1 - {_COS}, b.number) AS rank
  FROM ivec a JOIN ivec b ON a.number <> b.number
  WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL) WHERE rank <= 4 GROUP BY number)
SELECT i.number, coalesce(nb.neighbors, '') AS neighbors, coalesce(nb.titles, '') AS titles
FROM ivec i LEFT JOIN nb ON i.number = nb.number""")
def q_knn_lists(spark, sf):
    out = K.knn_neighbors(E.orders_with_embeddings(spark, sf), 4, "cosine")
    return out.select(
        "number",
        F.array_join(F.transform("k4_distances", lambda s: s["issue_number"].cast("string")), ",").alias("neighbors"),
        F.array_join(F.transform("k4_distances", lambda s: s["title"]), "|").alias("titles"))


# ------------------------------------------------------------------ J4, S9, S10, A18
@register("xref_edges", sql_with("xedges") + "SELECT src, dst FROM xedges")
def q_xref_edges(spark, sf):
    c = E.orders_corpus(spark, sf)
    return G.xref_edges(c["issues"], c["xrefs"]).select("src", "dst")


_EDGES_SQL = f""",
emb AS (SELECT number, pos FROM ivec WHERE embedding IS NOT NULL AND len(embedding) > 0),
nn AS (SELECT * FROM (
  SELECT a.number AS source, b.number AS target, 'nearest_neighbor' AS edge_type, 0 AS t,
         row_number() OVER (PARTITION BY a.number ORDER BY {_L2}, b.number) AS r
  FROM ivec a JOIN ivec b ON a.number <> b.number
  WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL) WHERE r <= 4),
xr AS (SELECT src AS source, dst AS target, 'cross_reference' AS edge_type, 1 AS t, dst AS r FROM xedges
       WHERE src IN (SELECT number FROM emb) AND dst IN (SELECT number FROM emb)),
edges AS (SELECT e.*, emb.pos AS src_pos FROM (SELECT * FROM nn UNION ALL SELECT * FROM xr) e
          JOIN emb ON e.source = emb.number)"""


@register("graph_edges", sql_with("ivec", "xedges") + _EDGES_SQL + """
SELECT 'e' || CAST(row_number() OVER (ORDER BY t, src_pos, r) - 1 AS VARCHAR) AS edge_id,
       source, target, edge_type FROM edges""")
def q_graph_edges(spark, sf):
    c = E.orders_corpus(spark, sf)
    e = G.graph_edges(E.orders_with_embeddings(spark, sf), c["xrefs"], 4, contiguous_ids=True)
    return e.select("edge_id", "source", "target", "edge_type")


@register("edge_stats", sql_with("ivec", "xedges") + _EDGES_SQL + """
SELECT edge_type, CAST(count(*) AS BIGINT) AS edges FROM edges GROUP BY edge_type""")
def q_edge_stats(spark, sf):
    c = E.orders_corpus(spark, sf)
    return G.edge_stats(G.graph_edges(E.orders_with_embeddings(spark, sf), c["xrefs"], 4))


@register("graph_vertices", sql_with("ivec", "xedges") + """,
deg AS (SELECT src AS number, count(*) AS n FROM xedges GROUP BY src)
SELECT CAST(i.number AS VARCHAR) AS id, CAST(i.number AS VARCHAR) || ': ' || coalesce(i.title, '') AS label,
  coalesce(i.title, '') AS title, coalesce(i.state, 'unknown') AS state, i.body_emojis AS reactions,
  i.number_of_comments AS comments, coalesce(i.url, '') AS url, coalesce(i.state, 'unknown') AS status,
  i.number_of_comments AS num_comments, i.total_emojis AS num_emojis,
  CAST(i.number_of_comments + i.total_emojis + coalesce(deg.n, 0) AS BIGINT) AS total_engagements
FROM ivec i LEFT JOIN deg ON i.number = deg.number
WHERE i.embedding IS NOT NULL AND len(i.embedding) > 0""")
def q_graph_vertices(spark, sf):
    c = E.orders_corpus(spark, sf)
    v = G.graph_vertices(E.orders_with_embeddings(spark, sf), c["xrefs"])
    return v.drop("number", "pos")


# ------------------------------------------------------------------ K5, K6 (rows-only: approximate / not SQL)
@register("knn_lsh", sql_with("vectors") + """
SELECT count(*)::BIGINT AS vectors, true AS full_lists, true AS exact_distances, true AS recall_reached
FROM vectors WHERE embedding IS NOT NULL AND len(embedding) > 0""")
def q_knn_lsh(spark, sf):
    """K5 held to the exact lists: k rows each, distances of the exact search for
    every pair both find, and at least 0.9 of the exact neighbours."""
    v = fx.vectors(spark, sf)
    near, exact = K.knn_lsh(v, 4), K.knn_pairs(v, 4, "cosine").select("q", "c", F.col("distance").alias("d"))
    per = near.join(exact, ["q", "c"], "left").groupBy("q").agg(
        F.count(F.lit(1)).alias("k"), F.count("d").alias("hits"), F.max(F.abs(F.col("distance") - F.col("d"))).alias("off"))
    return per.agg(F.count(F.lit(1)).alias("vectors"), (F.min("k") == 4).alias("full_lists"), (F.max("off") < 1e-6).alias("exact_distances"),
                   (F.sum("hits") >= 0.9 * F.sum("k")).alias("recall_reached"))


@register("layout_2d")
def q_layout_2d(spark, sf):
    return K.layout_2d(fx.vectors(spark, sf), scale=100.0)
