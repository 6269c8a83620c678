"""Skew-safe running sums and weekly buckets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from issuesift.operators.windows import running_sum, weekly_counts


def test_running_sum_with_a_hot_group_equals_window(spark):
    # 70% of all rows in one group: it must be split over several ranges
    df = spark.range(0, 40000).select(
        F.when(F.col("id") % 10 < 7, F.lit(1)).otherwise(F.col("id") % 97).alias("g"),
        F.col("id").alias("i"), (F.col("id") % 13).alias("v"))
    got = running_sum(df, ["g"], "i", "v", num_partitions=8)
    w = Window.partitionBy("g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("running", F.sum("v").over(w))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_weekly_buckets_start_on_monday(spark):
    df = spark.createDataFrame([("2024-01-07 23:59:59",), ("2024-01-08 00:00:00",), ("2023-12-31 12:00:00",)],
                               "t string").select(F.to_timestamp("t").alias("updatedAt"))
    got = {str(r.week_start): r.events for r in weekly_counts(df).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-08 00:00:00": 1, "2023-12-25 00:00:00": 1}
