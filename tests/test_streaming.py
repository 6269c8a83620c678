"""Streaming: results do not depend on how rows are dealt over files and
batches; replays, compaction and clean-up change nothing."""

import pytest
from pyspark.sql import functions as F

from issuesift import fixtures as fx
from issuesift.operators.incremental import latest_version
from issuesift.streaming import ingest as X
from tests.conftest import SF_SMALL

SCHEMA = "repo string, number bigint, pos bigint, title string, state string, updatedAt timestamp"


@pytest.fixture(scope="module")
def events(spark):
    return fx.event_updates(spark, SF_SMALL).select("repo", "number", "pos", "title", "state", "updatedAt").cache()


def land(spark, events, root, files):
    events.repartitionByRange(files, F.xxhash64("number", "pos", "updatedAt")).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(f"{root}/landing-{files}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).json(f"{root}/landing-{files}")


def key(df):
    return sorted((r.number, r.pos, r.state, str(r.updatedAt)) for r in df.collect())


@pytest.mark.parametrize("files", [1, 6, 20])
def test_upsert_and_guard_for_any_number_of_files(spark, events, tmpdir_path, files):
    stream = land(spark, events, tmpdir_path, files)
    X.start_upsert_stream(stream, f"{tmpdir_path}/t", f"{tmpdir_path}/t-ckpt").awaitTermination()
    assert len(X.committed_deltas(spark, f"{tmpdir_path}/t")) >= files // 4
    assert key(X.read_latest(spark, f"{tmpdir_path}/t")) == key(latest_version(events))
    X.start_guarded_log(stream, f"{tmpdir_path}/log", f"{tmpdir_path}/log-ckpt").awaitTermination()
    log = spark.read.parquet(f"{tmpdir_path}/log")
    assert key(log) == key(events.dropDuplicates(["repo", "number", "updatedAt"]))
    if files == 20:
        assert log.where("late").count() > 0


def test_repolled_and_late_versions(spark, tmpdir_path):
    def batch(*rows):
        return spark.createDataFrame([("r", n, n, "t", "open", u) for n, u in rows], SCHEMA.replace("updatedAt timestamp", "u string")).select(
            "repo", "number", "pos", "title", "state", F.to_timestamp("u").alias("updatedAt"))

    log = f"{tmpdir_path}/log"
    X.guard_batch(spark, batch((1, "2024-02-01"), (1, "2024-02-01"), (2, None)), log, 0)
    second = batch((1, "2024-02-01"), (2, None), (3, "2024-01-02"), (4, "2024-01-30"))
    for _ in range(2):  # the second time is a replay
        X.guard_batch(spark, second, log, 1)
    X.guard_batch(spark, batch((3, "2024-01-02")), log, 2)
    assert sorted((r.number, r.late) for r in spark.read.parquet(log).collect()) == [(1, False), (2, False), (3, True), (4, False)]


def test_weekly_activity_stream(spark, events, tmpdir_path):
    stream = land(spark, events, tmpdir_path, 20)
    q = (X.weekly_activity(stream).writeStream.outputMode("complete").format("memory").queryName("weekly_t")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {str(r.week_start): r.events for r in spark.table("weekly_t").collect()}
    assert sum(got.values()) == events.count()
    assert all(k.startswith("2024-01-01") or k >= "2024-01-08" for k in got)


def test_older_versions_never_win_and_compaction_survives_the_next_batch(spark, tmpdir_path):
    root = f"{tmpdir_path}/table"

    def rows(numbers, state, day):
        df = spark.createDataFrame([("r", n, n, "t", state) for n in numbers], "repo string, number long, pos long, title string, state string")
        return df.withColumn("updatedAt", F.to_timestamp(F.lit(f"2024-01-{day:02d}")))

    def now():
        return {r.number: r.state for r in X.read_latest(spark, root).collect()}

    assert X.read_latest(spark, root) is None and X.compact(spark, root) is None
    X.upsert_batch(spark, rows(range(6), "open", 5), root, 0)
    X.upsert_batch(spark, rows([1], "closed", 9), root, 1)
    X.upsert_batch(spark, rows([1, 2], "older", 1), root, 2)
    want = dict.fromkeys(range(6), "open") | {1: "closed"}
    assert now() == want
    assert X.compact(spark, root) == 0 and X.compact(spark, root) is None
    assert now() == want and X.current_paths(spark, root) == [f"{root}/base=0"]
    X.upsert_batch(spark, rows([1], "older", 1), root, 2)  # a replay of a folded batch
    X.upsert_batch(spark, rows([2, 9], "new", 20), root, 3)
    want |= {2: "new", 9: "new"}
    assert now() == want
    assert X.compact(spark, root) == 1
    gone = X.clean_up(spark, root)
    assert f"{root}/base=0" in gone and f"{root}/delta=3" in gone
    assert now() == want and X.committed_deltas(spark, root) == []


def test_recommendation_intake_replay_changes_nothing(spark, tmpdir_path):
    from issuesift.operators.recs import append_recommendations  # noqa: F401

    inputs = fx.rec_inputs(spark, SF_SMALL)
    inputs.repartition(6).write.json(f"{tmpdir_path}/in")
    issues = fx.orders_issues(spark, SF_SMALL)

    def run(name):
        stream = spark.readStream.schema(inputs.schema).option("maxFilesPerTrigger", 2).json(f"{tmpdir_path}/in")
        X.start_recommendation_intake(stream, issues, f"{tmpdir_path}/recs", f"{tmpdir_path}/bad", f"{tmpdir_path}/{name}").awaitTermination()
        recs, bad = (spark.read.parquet(f"{tmpdir_path}/{t}") for t in ("recs", "bad"))
        return sorted((r.number, r.seq) for r in recs.collect()), bad.count()

    first = run("c1")
    assert run("c2") == first  # a lost checkpoint replays every batch
    assert len(first[0]) + first[1] == inputs.count()
