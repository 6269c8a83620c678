"""Structured Streaming forms of the incremental feed.

The reference polls the API from a watermark with a one-week overlap and
upserts item by item. Here landed files are a file stream. File order is not
time order, so nothing depends on which micro-batch a row arrives in:

* X1 ``start_upsert_stream``: ``readStream`` -> normalise -> ``foreachBatch``
  that writes the batch's newest versions (W1) as a delta of the table. Readers
  merge base and deltas by the greatest ``(updatedAt, pos)``; ``compact`` folds
  deltas into a new base. The work per batch follows the batch.
* X2 ``start_guarded_log``: each version of an item once. Versions older than
  the watermark are marked late, not dropped.
* X3 ``weekly_activity``: weekly tumbling windows over such a log.
* X4 ``start_recommendation_intake``: checked review submissions appended to
  the review log; rejects go to a quarantine folder.

Each batch writes folders named by its id and overwrites them when it is
replayed. Checkpoints live under the folder the caller passes (on a cluster:
inside ``spark.checkpoint.dir`` or another shared path), never on a local disk.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import latest_version
from ..operators.windows import week_bucket


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbered(spark: SparkSession, root: str, prefix: str, committed: bool = True) -> list[int]:
    """Numbers of the folders ``<root>/<prefix><number>`` whose write finished."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    jvm = spark.sparkContext._jvm
    dirs = [st.getPath() for st in fs.listStatus(p) if st.isDirectory() and st.getPath().getName().startswith(prefix)]
    return sorted(int(d.getName()[len(prefix):]) for d in dirs
                  if not committed or fs.exists(jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))


# ---------------------------------------------------------------- the table
# <root>/delta=<batch id>     newest versions of the batch's items
# <root>/base=<g>             all items merged up to a batch
# <root>/manifest=<g>         one row {"base": g, "upto": batch id}, written last:
#                             the newest manifest says which base and deltas count
def committed_deltas(spark: SparkSession, root: str) -> list[int]:
    return _numbered(spark, root, "delta=")


def manifest(spark: SparkSession, root: str) -> dict | None:
    gens = _numbered(spark, root, "manifest=")
    return json.loads(spark.read.text(f"{root}/manifest={gens[-1]}").first()[0]) if gens else None


def current_paths(spark: SparkSession, root: str) -> list[str]:
    """The base and the deltas that make up the table now."""
    m = manifest(spark, root)
    base = [f"{root}/base={m['base']}"] if m else []
    return base + [f"{root}/delta={b}" for b in committed_deltas(spark, root) if not m or b > m["upto"]]


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The table: of every item the greatest ``(updatedAt, pos)``, whatever
    batch brought it. Columns a version lacks are null in it (S3 on stored
    collections keeps them, see ``operators.incremental.upsert``); a column has
    one type in all batches."""
    paths = current_paths(spark, root)
    if not paths:
        return None
    # one scan, whatever the number of deltas
    return latest_version(spark.read.option("mergeSchema", "true").parquet(*paths))


def upsert_batch(spark: SparkSession, batch: DataFrame, root: str, batch_id: int) -> None:
    """Write the batch's newest versions as delta ``batch_id``. A replay writes
    the same delta again."""
    latest_version(batch).write.mode("overwrite").parquet(f"{root}/delta={batch_id}")


def compact(spark: SparkSession, root: str) -> int | None:
    """Fold the deltas so far into a new base; bases are numbered on their own,
    so a batch that commits meanwhile stays a delta of its own. Returns the
    base's number, or None when there is nothing to fold."""
    m, deltas = manifest(spark, root), committed_deltas(spark, root)
    deltas = [b for b in deltas if not m or b > m["upto"]]
    if not deltas:
        return None
    # numbers of unfinished bases are never used again
    g = max([-1, *_numbered(spark, root, "base=", committed=False)]) + 1
    read_latest(spark, root).write.parquet(f"{root}/base={g}")
    line = json.dumps({"base": g, "upto": deltas[-1]})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{root}/manifest={g}")
    return g


def clean_up(spark: SparkSession, root: str, keep_bases: int = 1) -> list[str]:
    """Remove bases no manifest in the newest ``keep_bases`` names, their
    manifests, and deltas the oldest kept base holds. Returns what went."""
    gens = _numbered(spark, root, "manifest=")
    if not gens:
        return []
    kept = gens[-keep_bases:]
    upto = json.loads(spark.read.text(f"{root}/manifest={kept[0]}").first()[0])["upto"]
    dead = [f"{root}/{kind}={g}" for g in gens if g not in kept for kind in ("manifest", "base")]
    dead += [f"{root}/delta={b}" for b in committed_deltas(spark, root) if b <= upto]
    for path in dead:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return dead


def start_upsert_stream(stream: DataFrame, table_root: str, checkpoint: str, available_now: bool = True):
    """Run the upsert stream; returns the ``StreamingQuery``."""
    spark = stream.sparkSession
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: upsert_batch(spark, df, table_root, bid)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def rest_page_stream(spark: SparkSession, path: str, repo: str, files_per_trigger: int | None = None) -> DataFrame:
    """X1 source: landed REST issue pages (JSON Lines, one page per line) as a
    stream of normalised items (S5); new files are picked up incrementally."""
    from ..sources.pages import REST_ITEM_SCHEMA, normalize_rest_items

    r = spark.readStream.schema(REST_ITEM_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    items = r.json(path)
    return normalize_rest_items(items, repo).withColumn("pos", F.col("number"))


VERSION = ["repo", "number", "updatedAt"]


def guard_batch(spark: SparkSession, batch: DataFrame, root: str, batch_id: int, delay: str = "7 days") -> None:
    """Append the batch's versions that the log under ``root`` does not
    hold yet. ``late`` marks those older than the greatest ``updatedAt`` of
    earlier batches less ``delay``; they are kept, so a backfill in any file
    order loses nothing. Only log rows as new as the batch's oldest are read."""
    before = [b for b in _numbered(spark, root, "batch_id=") if b < batch_id]
    new = batch.dropDuplicates(VERSION)
    if before:
        log = spark.read.option("basePath", root).parquet(*[f"{root}/batch_id={b}" for b in before])
        marks = spark.read.option("basePath", f"{root}-marks").parquet(*[f"{root}-marks/batch_id={b}" for b in before])
        oldest = batch.agg(F.min("updatedAt"), F.count_if(F.col("updatedAt").isNull())).first()
        known = log.where((F.col("updatedAt") >= F.lit(oldest[0])) | F.col("updatedAt").isNull()).select(VERSION).alias("k")
        n = new.alias("n")
        new = n.join(known, [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in VERSION], "left_anti")
        mark = marks.agg((F.max("high") - F.expr(f"INTERVAL {delay}")).alias("m")).first()[0]
        late = F.coalesce(F.col("updatedAt") < F.lit(mark), F.lit(False))
    else:
        late = F.lit(False)
    # the mark first: it is read only for batches whose rows are committed
    batch.agg(F.max("updatedAt").alias("high")).write.mode("overwrite").parquet(f"{root}-marks/batch_id={batch_id}")
    new.withColumn("late", late).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def start_guarded_log(stream: DataFrame, root: str, checkpoint: str, delay: str = "7 days", available_now: bool = True):
    """X2 on a stream: a log of distinct versions, late ones marked."""
    spark = stream.sparkSession
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: guard_batch(spark, df, root, bid, delay)))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def weekly_activity(stream: DataFrame, ts: str = "updatedAt") -> DataFrame:
    """Item versions per Monday-aligned week, for output mode ``complete``
    or ``update``. The state is one count per week, so no watermark is needed
    and no late row is lost."""
    return (stream.groupBy(week_bucket(ts).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("week_start"), F.col("w.end").alias("week_end"), "events"))


def start_recommendation_intake(stream: DataFrame, issues: DataFrame, recs_root: str, quarantine: str,
                                checkpoint: str):
    """Check each batch of submissions (V10 + unknown issue), append the
    accepted rows to the review log with their ``seq``, quarantine the rest.
    Both tables are folders per ``batch_id``; a replayed batch sees only what
    earlier batches stored and overwrites its own folders."""
    from ..operators.recs import RECS_SCHEMA, append_recommendations

    spark = stream.sparkSession

    def run(df: DataFrame, bid: int) -> None:
        before = [f"{recs_root}/batch_id={b}" for b in _numbered(spark, recs_root, "batch_id=") if b < bid]
        recs = spark.read.parquet(*before) if before else spark.createDataFrame([], RECS_SCHEMA)
        acc, rej = append_recommendations(issues, recs, df)
        rej.write.mode("overwrite").parquet(f"{quarantine}/batch_id={bid}")
        acc.write.mode("overwrite").parquet(f"{recs_root}/batch_id={bid}")

    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
            .trigger(availableNow=True).start())
