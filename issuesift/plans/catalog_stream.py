"""Catalog: streaming ingest (X1-X4) and model plug-ins with cache.

Streaming queries land files derived from the driver tables into a scratch
folder under the checkpoint directory, run the stream to completion
(``availableNow``) and return the table the stream produced.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import sql_with
from ..functions.text import cache_key
from ..operators import conversation as C
from ..operators import embed as EM
from ..session import scratch_path
from ..sources import buckets as B
from ..streaming import ingest as X
from ..streaming import versions as V
from . import enrich as E
from .catalog_text import _sql_embed_text
from .catalog_tools import _REC_ERRORS_SQL
from .registry import ORACLE, register, sql_strip, sql_ts, ts_str

_ITEM_SCHEMA = "repo string, number bigint, pos bigint, title string, state string, updatedAt timestamp"


FILES, PER_BATCH = 24, 4


def _land_events(spark, sf, root: str) -> str:
    """Write item versions from ``events`` as 24 files in no order of time, with
    a repeat of the versions from Jan 20 (a re-poll overlap): six micro-batches."""
    ev = fx.event_updates(spark, sf).select("repo", "number", "pos", "title", "state", "updatedAt")
    again = ev.where(F.col("updatedAt") >= F.to_timestamp(F.lit("2024-01-20")))
    land = os.path.join(root, "landing")
    both = ev.withColumn("_n", F.lit(0)).unionByName(again.withColumn("_n", F.lit(1)))
    # round robin over a hash order: every file spans all of the time
    dealt = both.repartitionByRange(FILES, F.xxhash64("number", "pos", "updatedAt", "_n"))
    dealt.drop("_n").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(land)
    return land


def _stream(spark, land: str, files_per_batch: int = PER_BATCH):
    return spark.readStream.schema(_ITEM_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(land)


def _guarded_log(spark, sf, root: str) -> str:
    log = os.path.join(root, "log")
    X.start_guarded_log(_stream(spark, _land_events(spark, sf, root)), log, os.path.join(root, "ckpt")).awaitTermination()
    return log


@register("stream_upsert", sql_with("updates") + f"""
SELECT number, pos, state, {sql_ts('updatedAt')} AS updatedAt FROM (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY updatedAt DESC, pos DESC) AS rn FROM updates)
WHERE rn = 1""")
def q_stream_upsert(spark, sf):
    root = scratch_path(spark, f"stream-upsert-{uuid.uuid4().hex}")
    land = _land_events(spark, sf, root)
    X.start_upsert_stream(_stream(spark, land), os.path.join(root, "table"), os.path.join(root, "ckpt")).awaitTermination()
    out = X.read_latest(spark, os.path.join(root, "table"))
    return out.select("number", "pos", "state", ts_str("updatedAt").alias("updatedAt"))


@register("stream_rest_pages", sql_with("issues") + f"""
SELECT number, CASE WHEN item_type = 'pull_request' THEN 'closed' ELSE state END AS state, item_type,
  {sql_ts('updatedAt')} AS updatedAt FROM issues""")
def q_stream_rest_pages(spark, sf):
    """X1 end to end: landed REST pages -> stream -> normalise (S5) -> dedupe
    -> deltas (S3) -> current table."""
    from .catalog_sources import rest_items

    root = scratch_path(spark, f"stream-rest-{uuid.uuid4().hex}")
    stream = X.rest_page_stream(spark, rest_items(spark, sf), fx.REPO_ORDERS, files_per_trigger=2)
    X.start_upsert_stream(stream, os.path.join(root, "table"), os.path.join(root, "ckpt")).awaitTermination()
    out = X.read_latest(spark, os.path.join(root, "table"))
    return out.select("number", "state", "item_type", ts_str("updatedAt").alias("updatedAt"))


@register("stream_late_guard", sql_with("updates") + f"""
SELECT number, pos, {sql_ts('updatedAt')} AS updatedAt FROM updates""")
def q_stream_late_guard(spark, sf):
    """Every version once, late ones included."""
    log = _guarded_log(spark, sf, scratch_path(spark, f"stream-guard-{uuid.uuid4().hex}"))
    return spark.read.parquet(log).select("number", "pos", ts_str("updatedAt").alias("updatedAt"))


@register("stream_versions", ORACLE["stream_late_guard"])
def q_stream_versions(spark, sf):
    """X2 by keyed state: every version once, without reading the log."""
    root = scratch_path(spark, f"stream-versions-{uuid.uuid4().hex}")
    stream = _stream(spark, _land_events(spark, sf, root))
    V.start_version_log(stream, os.path.join(root, "log"), os.path.join(root, "ckpt")).awaitTermination()
    log = V.read_versions(spark, os.path.join(root, "log"), stream.schema)
    return log.select("number", "pos", ts_str("updatedAt").alias("updatedAt"))


@register("stream_weekly", sql_with("updates") + f"""
SELECT {sql_ts("time_bucket(INTERVAL 7 DAY, updatedAt, TIMESTAMP '2024-01-01')")} AS week_start,
       CAST(count(*) AS BIGINT) AS events FROM updates GROUP BY 1""")
def q_stream_weekly(spark, sf):
    """X3 over the log of X2, so that repeats are not counted."""
    root = scratch_path(spark, f"stream-weekly-{uuid.uuid4().hex}")
    log = _guarded_log(spark, sf, root)
    schema = spark.read.parquet(log).drop("batch_id").schema
    out = os.path.join(root, "out")
    versions = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(os.path.join(log, "batch_id=*"))
    q = (X.weekly_activity(versions).writeStream.outputMode("complete")
         .option("checkpointLocation", os.path.join(root, "weekly-ckpt"))
         .foreachBatch(lambda df, bid: df.write.mode("overwrite").parquet(out))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select(ts_str("week_start").alias("week_start"), "events")


@register("stream_rec_intake", sql_with("rec_inputs", "issues", "recs") + f""",
ok AS (SELECT * FROM rec_inputs WHERE {_REC_ERRORS_SQL} = ''
       AND issue_number IN (SELECT number FROM issues)),
prior AS (SELECT number, count(*) AS n FROM recs GROUP BY number)
SELECT ok.issue_number AS number,
  CAST(coalesce(p.n, 0) + row_number() OVER (PARTITION BY ok.issue_number ORDER BY ok.input_pos) AS BIGINT) AS seq,
  recommendation, {sql_strip('summary')} AS summary
FROM ok LEFT JOIN prior p ON ok.issue_number = p.number""")
def q_stream_rec_intake(spark, sf):
    from ..operators.recs import RECS_SCHEMA

    root = scratch_path(spark, f"stream-recs-{uuid.uuid4().hex}")
    recs_root = os.path.join(root, "recs")
    existing = fx.label_recs(spark, sf)
    spark.createDataFrame([], RECS_SCHEMA).unionByName(existing, allowMissingColumns=True) \
        .write.parquet(os.path.join(recs_root, "batch_id=-1"))
    inputs = fx.rec_inputs(spark, sf)
    land = os.path.join(root, "landing")
    inputs.write.json(land)
    stream = (spark.readStream.schema(inputs.schema).option("maxFilesPerTrigger", 2).json(land))
    issues = fx.orders_issues(spark, sf)
    q = X.start_recommendation_intake(stream, issues, recs_root, os.path.join(root, "quarantine"),
                                      os.path.join(root, "ckpt"))
    q.awaitTermination()
    recs = spark.read.parquet(recs_root).where(F.col("batch_id") >= 0)
    return recs.select("number", "seq", "recommendation", "summary")


# ------------------------------------------------------------------ J9, E1, E2, F8
@register("cache_misses", """
WITH cache AS (SELECT DISTINCT 'embed-model:' || sha256(d.text) AS key FROM documents d
               WHERE d.doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id AS number, ('embed-model:' || sha256(text)) IN (SELECT key FROM cache) AS hit FROM documents""")
def q_cache_misses(spark, sf):
    docs = fx.docs_issues(spark, sf)
    labeled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("number"))
    cache = (docs.join(labeled, "number", "left_semi")
             .select(cache_key("body", "embed-model").alias("key"), F.lit("cached").alias("value")))
    keyed = docs.select("number", cache_key("body", "embed-model").alias("key"))
    hits, _misses = EM.cache_lookup(keyed.select("key"), cache)
    return keyed.join(hits.select("key", F.lit(True).alias("hit")), "key", "left").select(
        "number", F.coalesce(F.col("hit"), F.lit(False)).alias("hit"))


@register("cache_misses_stored", ORACLE["cache_misses"])
def q_cache_misses_stored(spark, sf):
    """The same over a cache stored in buckets by key: only the keys are shuffled."""
    docs = fx.docs_issues(spark, sf)
    labeled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("number"))
    cache = (docs.join(labeled, "number", "left_semi")
             .select(cache_key("body", "embed-model").alias("key"), F.lit("cached").alias("value")))
    b = B.write_buckets(cache, scratch_path(spark, f"buckets-{uuid.uuid4().hex}/cache"), ["key"], 8)
    keyed = docs.select("number", cache_key("body", "embed-model").alias("key"))
    hits, misses = B.lookup(spark, b, keyed.select("key"))
    known = hits.select("key", F.lit(True).alias("hit")).unionByName(misses.select("key", F.lit(False).alias("hit")))
    return keyed.join(known, "key").select("number", "hit")


_DIMS = 256


@register("embed_docs", sql_with("docs_issues", "docs_comments") + _sql_embed_text("docs_issues", "docs_comments").replace(
    "\nSELECT i.number,", ",\net AS (SELECT i.number,", 1) + f"""),
tok AS (SELECT number, unnest(regexp_extract_all(translate(embed_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z0-9]+')) AS t FROM et),
h AS (SELECT number, md5(t) AS m FROM tok),
b AS (SELECT number, CAST('0x' || substr(m, 1, 7) AS BIGINT) % {_DIMS} AS b, sum(CASE WHEN substr(m, 8, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v
      FROM h GROUP BY ALL),
n AS (SELECT number, sqrt(sum(v * v)) AS n, sum(v * (b + 1)) AS s FROM b GROUP BY number)
SELECT et.number, CASE WHEN et.embed_text IS NOT NULL THEN {_DIMS} END::INTEGER AS dims,
  round(CASE WHEN et.embed_text IS NOT NULL THEN coalesce(n.s / nullif(n.n, 0), 0) END, 2) AS weighted
FROM et LEFT JOIN n ON n.number = et.number""")
def q_embed_docs(spark, sf):
    """E1 with the default local embedder over the documents' embedding text;
    ``weighted`` is the sum of its components times their position."""
    t = C.embedding_text(fx.docs_issues(spark, sf), fx.docs_comments(spark, sf))
    out, _new = EM.embed_issues(t, "embed_text", dims=_DIMS)
    at = F.zip_with(F.col("embedding").cast("array<double>"), F.sequence(F.lit(1), F.lit(_DIMS)), lambda x, i: x * i)
    return out.select("number", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"),
                      F.round(F.aggregate(at, F.lit(0.0), lambda a, x: a + x), 2).alias("weighted"))


_PROMPT = ("number bigint, url string, title string, author string, updatedAt string, state string, age_days bigint, "
           "comment_count bigint, engagements bigint, engagements_per_day double, body_emojis bigint, comment_emojis bigint, "
           "total_emojis bigint, total_emojis_quartile string, engagements_quartile string")


@register("prompt_text", sql_with("enriched") + """
SELECT number, url, title, author, strftime(updatedAt, '%Y-%m-%dT%H:%M:%SZ') AS updatedAt, state, age_days, comment_count, engagements,
  round(engagements_per_day, 6) AS engagements_per_day, body_emojis, comment_emojis, total_emojis, total_emojis_quartile,
  engagements_quartile, CAST(22 AS INTEGER) AS fields FROM enriched""")
def q_prompt_text(spark, sf):
    """F8 prompt per enriched issue, its JSON read back to columns."""
    p = EM.prompt_text(E.orders_enriched(spark, sf)).select(F.substring("prompt", F.lit(len(EM.PROMPT_HEAD) + 1), F.length("prompt")).alias("js"))
    back = p.select(F.from_json("js", _PROMPT).alias("p"), F.json_object_keys("js").alias("k"))
    return back.select("p.*", F.size("k").alias("fields")).withColumn("engagements_per_day", F.round("engagements_per_day", 6))


@register("summaries", sql_with("enriched") + "SELECT number, title || ' (summary)' AS summary FROM enriched")
def q_summaries(spark, sf):
    """E2 with a local completer plug-in (first sentence of the conversation),
    cache-backed; the default without a completer yields null summaries."""
    import pandas as pd

    def first_title(prompts: pd.Series) -> pd.Series:
        return prompts.str.extract(r'"title":"([^"]*)"', expand=False).fillna("") + " (summary)"

    out, _new = EM.summarize(E.orders_enriched(spark, sf), completer=first_title)
    return out.select("number", "summary")


@register("enrich_full")
def q_enrich_full(spark, sf):
    """The whole enrichment over the documents corpus (conversation, cached
    embedding, metrics, quartiles, summaries, k-NN lists). Rows-only."""
    out, _cache = E.enrich(fx.docs_issues(spark, sf), fx.docs_comments(spark, sf))
    return out.select("number", F.length("conversation").alias("conversation_chars"),
                      F.size("embedding").alias("dims"), "comment_count", "total_emojis", "total_emojis_quartile",
                      F.size("k4_distances").alias("neighbors"))


@register("layout_export", sql_with("vectors") + "SELECT number, true AS finite FROM vectors WHERE embedding IS NOT NULL AND len(embedding) > 0")
def q_layout_export(spark, sf):
    """Layout coordinates written as JSON lines and read back."""
    from ..operators.knn import layout_2d
    from ..sources.export import write_layout

    path = scratch_path(spark, f"layout-{uuid.uuid4().hex}")
    write_layout(layout_2d(fx.vectors(spark, sf), 100.0), path)
    back = spark.read.json(path)
    id_col = "number" if "number" in back.columns else back.columns[0]
    return back.select(F.col(id_col).cast("bigint").alias("number"), (F.abs("x") + F.abs("y") < float("inf")).alias("finite"))


@register("migrate_docs", sql_with("vdocs") + """
SELECT v.number AS doc_id, v.number, i.title, i.state, v.claim AS number_of_comments
FROM vdocs v JOIN issues i ON v.number = i.number""")
def q_migrate_docs(spark, sf):
    """The orders' issue documents written in the legacy store layout
    ``{"_default": {"<id>": doc}}`` (one file per page of documents), then
    migrated back to a table. Rows-only."""
    from ..sources.pages import migrate_documents

    docs = E.orders_documents(spark, sf)
    path = scratch_path(spark, f"legacy-{uuid.uuid4().hex}")
    page = F.expr("number div 1000")
    body = docs.select(page.alias("page"), F.col("number").cast("string").alias("id"),
                       F.to_json(F.struct(*[c for c in docs.columns if c not in ("repo", "pos")])).alias("doc"))
    files = body.groupBy("page").agg(F.concat(F.lit('{"_default": {'), F.array_join(F.collect_list(
        F.concat(F.lit('"'), F.col("id"), F.lit('": '), F.col("doc"))), ", "), F.lit("}}")).alias("value"))
    files.select("value").write.text(path)
    m = migrate_documents(spark, path, fx.REPO_ORDERS)
    return m.select("doc_id", "number", "title", "state", "number_of_comments")
