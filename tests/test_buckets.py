"""Stored tables bucketed by key: right rows, and no exchange above them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from issuesift.operators.embed import cache_lookup
from issuesift.operators.incremental import upsert
from issuesift.sources import buckets as B

COLUMNS = "repo string, number long, pos long, state string, updatedAt timestamp_ntz, summary string"


def exchanges_above_buckets(df) -> list[str]:
    """Exchanges between the scans of bucketed tables and the first join above."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [re.search(r"[A-Za-z(*]", x).start() if re.search(r"[A-Za-z(*]", x) else 0 for x in lines]
    found, scans = [], [i for i, x in enumerate(lines) if "Bucketed: true" in x]
    assert scans
    for i in scans:
        at = depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                if "Join" in lines[j]:
                    break
                found += [lines[j]] if "Exchange" in lines[j] else []
    return found


def items(spark, rows):
    return spark.createDataFrame(rows, "repo string, number long, pos long, state string, day int").select(
        "repo", "number", "pos", "state", F.make_timestamp_ntz(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("updatedAt"))


def bag(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upsert_moves_only_the_update(spark, tmpdir_path, no_broadcast):
    target = items(spark, [("r", n, n, "open", 5) for n in range(200)]).withColumn("summary", F.concat(F.lit("kept-"), "number"))
    updates = items(spark, [("r", n % 230, n, "closed", 1 + n % 9) for n in range(150, 400)] + [("s", 1, 1, "open", 2)])
    b = B.write_buckets(target, f"{tmpdir_path}/t", ["repo", "number"], 6)
    out = B.upserted(spark, b, updates)
    assert exchanges_above_buckets(out) == []
    want = bag(upsert(target, updates))
    assert bag(out) == want
    g1 = B.upsert_buckets(spark, b, updates, f"{tmpdir_path}/g")
    assert bag(B.read_buckets(spark, g1)) == want and bag(B.read_buckets(spark, b)) == bag(target)
    again = B.upserted(spark, g1, updates.where("pos < 200"))
    assert exchanges_above_buckets(again) == [] and bag(again) == want
    g2 = B.upsert_buckets(spark, g1, updates, f"{tmpdir_path}/g")  # the same update changes nothing
    assert bag(B.read_buckets(spark, g2)) == want


def test_one_file_a_bucket_also_after_an_upsert(spark, tmpdir_path, no_broadcast):
    import glob

    target = items(spark, [("r", n, n, "open", 5) for n in range(300)])
    b = B.write_buckets(target, f"{tmpdir_path}/t", ["repo", "number"], 5)
    g = B.upsert_buckets(spark, b, items(spark, [("r", n, n, "closed", 9) for n in range(250, 350)]), tmpdir_path)
    for path in (b.path, g.path):
        assert len(glob.glob(f"{path}/part-*.parquet")) == 5


def test_opened_by_another_session(spark, tmpdir_path, no_broadcast):
    target = items(spark, [("r", n, n, "open", 5) for n in range(50)])
    b = B.write_buckets(target, f"{tmpdir_path}/t", ["repo", "number"], 4)
    spark.sql(f"DROP TABLE {b.table()}")  # what a new session's catalog looks like
    opened = B.open_buckets(spark, f"{tmpdir_path}/t")
    assert opened == b
    out = B.upserted(spark, opened, target)
    assert exchanges_above_buckets(out) == [] and bag(out) == bag(target)


def test_lookup_moves_only_the_keys(spark, tmpdir_path, no_broadcast):
    cache = spark.createDataFrame([(f"k{i % 80}", f"v{i % 80}") for i in range(100)], "key string, value string")
    keys = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(60, 120)] * 2, "key string, raw string")
    b = B.write_buckets(cache, f"{tmpdir_path}/c", ["key"], 4)
    hits, misses = B.lookup(spark, b, keys)
    want_hits, want_misses = cache_lookup(keys, cache)
    for got, want in ((hits, want_hits), (misses, want_misses)):
        assert exchanges_above_buckets(got) == [] and bag(got) == bag(want)
    grown = B.extend(spark, b, misses.select("key", F.col("raw").alias("value")), tmpdir_path)
    assert B.lookup(spark, grown, keys)[1].count() == 0
    old = B.lookup(spark, grown, keys.where("key = 'k61'"))[0].collect()
    assert [(r.key, r.value) for r in old] == [("k61", "v61")]


def test_wrong_keys(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 1)], "key string, n int")
    for keys, n in ((["nope"], 2), ([], 2), (["key"], 0)):
        with pytest.raises(ValueError):
            B.write_buckets(df, f"{tmpdir_path}/x", keys, n)
    b = B.write_buckets(df, f"{tmpdir_path}/y", ["key"], 2)
    with pytest.raises(ValueError):
        B.upserted(spark, b, df)
