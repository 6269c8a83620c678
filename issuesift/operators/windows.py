"""Time buckets (F13 / X3): weekly tumbling windows aligned to Monday 2024-01-01.

``window(ts, '7 days', '7 days', '4 days')`` starts buckets on Mondays: the
epoch is a Thursday, and four days later is a Monday. Any Monday anchor gives
the same bucket edges, so the anchor of the reference (2024-01-01) holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = "7 days"
MONDAY_OFFSET = "4 days"


def week_bucket(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.window(c, WEEK, WEEK, MONDAY_OFFSET)


def weekly_counts(df: DataFrame, ts: str = "updatedAt") -> DataFrame:
    """Rows per week bucket (batch form; the streaming form adds a watermark)."""
    return (df.groupBy(week_bucket(ts).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("week_start"), F.col("w.end").alias("week_end"), "events"))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str = "running",
                num_partitions: int | None = None) -> DataFrame:
    """Exact running ``sum(value)`` per group in ``order`` that never puts a hot
    group into one task.

    A window partitioned by the group sorts the whole group in one task; here
    rows are range-partitioned on ``(keys, order)`` instead, so a group with a
    third of all rows is cut into many consecutive ranges. Each task computes
    running sums inside its (partition, group) slices, the slice totals (one
    row per slice) give each slice's offset, and the offset is added back.
    The partitioned data is checkpointed so both passes see the same split.
    Cost versus a plain window: one range shuffle and a checkpoint write more,
    in exchange for no task ever holding a whole group.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = (df.repartitionByRange(n, *[F.col(k) for k in keys], F.col(order))
            .withColumn("_pid", F.spark_partition_id())
            .checkpoint(eager=True))
    local_w = (Window.partitionBy("_pid", *keys).orderBy(order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = part.withColumn("_local", F.sum(value).over(local_w))
    slices = part.groupBy("_pid", *keys).agg(F.sum(value).alias("_slice"))
    prev_w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("_off", F.coalesce(F.sum("_slice").over(prev_w), F.lit(0))).drop("_slice")
    return (local.join(offsets, ["_pid", *keys], "left")
            .withColumn(out, F.col("_local") + F.col("_off"))
            .drop("_pid", "_local", "_off"))
