"""The version log by keyed state: repeats, late rows, bounded state and work."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest

from issuesift.streaming import versions as V

SCHEMA = "repo string, number long, pos long, state string, updatedAt timestamp"
START = dt.datetime(2024, 1, 1)


def land(folder, batch, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{batch:04d}.json", "w") as f:
        for number, pos, state, day in rows:
            at = None if day is None else (START + dt.timedelta(days=day)).strftime("%Y-%m-%dT%H:%M:%S")
            f.write(json.dumps({"repo": "r", "number": number, "pos": pos, "state": state, "updatedAt": at}) + "\n")
    os.utime(f"{folder}/{batch:04d}.json", (1_700_000_000 + batch,) * 2)  # the stream takes files in this order


def run(spark, folder, root, ckpt, **settings):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    q = V.start_version_log(stream, root, ckpt, **settings)
    q.awaitTermination()
    return q


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def stored(spark, root):
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = V.read_versions(spark, root, schema).collect()
    return sorted((r.number, (r.updatedAt - START).days, r.pos, r.late) for r in rows)


def test_repeats_late_rows_and_rows_without_a_time(spark, tmpdir_path, few_partitions):
    land(f"{tmpdir_path}/in", 0, [(1, 1, "open", 0), (1, 2, "open", 0), (1, 3, "open", 3), (2, 1, "open", 30)])
    land(f"{tmpdir_path}/in", 1, [(1, 9, "open", 3), (1, 4, "closed", 20), (2, 2, "open", 1), (2, 2, "open", 1), (4, 1, "x", 5)])
    land(f"{tmpdir_path}/in", 2, [(1, 5, "open", 0), (1, 6, "back", 14), (2, 3, "open", 1), (2, 4, "open", 30)])
    run(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/log", f"{tmpdir_path}/ckpt")
    assert stored(spark, f"{tmpdir_path}/log") == [
        (1, 0, 2, False), (1, 3, 3, False), (1, 14, 6, False), (1, 20, 4, False), (2, 1, 3, True), (2, 30, 1, False), (4, 5, 1, False)]
    log = spark.read.parquet(f"{tmpdir_path}/log")
    assert log.where("batch_id = 2 and late").count() == 2 and log.where("not late").count() == 6
    rows = log.count()
    # a lost checkpoint replays every batch into the same folders
    run(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/log", f"{tmpdir_path}/ckpt2")
    assert spark.read.parquet(f"{tmpdir_path}/log").count() == rows


def test_rows_without_a_time_come_once(spark, tmpdir_path, few_partitions):
    land(f"{tmpdir_path}/in", 0, [(1, 1, "open", None), (1, 2, "open", None)])
    land(f"{tmpdir_path}/in", 1, [(1, 3, "open", None), (1, 4, "open", 2), (2, None, "open", 2)])
    run(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/log", f"{tmpdir_path}/ckpt")
    schema = spark.createDataFrame([], SCHEMA).schema
    got = V.read_versions(spark, f"{tmpdir_path}/log", schema).collect()
    assert sorted(((r.number, r.pos, r.updatedAt is None) for r in got), key=str) == [(1, 2, True), (1, 4, False), (2, None, False)]


def test_fifty_batches_keep_state_and_work_bounded(spark, tmpdir_path, few_partitions):
    items, batches = 20, 50
    for b in range(batches):  # each batch: a new version of every item, and the last two again
        land(f"{tmpdir_path}/in", b, [(n, 100 * b + d, "s", b - d) for n in range(items) for d in range(3) if b >= d])
    q = run(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/log", f"{tmpdir_path}/ckpt")
    got = stored(spark, f"{tmpdir_path}/log")
    assert got == sorted((n, b, 100 * b, False) for n in range(items) for b in range(batches))
    done = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(done) == batches
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in done]
    assert max(held) == items  # one value an item, with the times of the last seven days
    written = [spark.read.parquet(f"{tmpdir_path}/log/batch_id={b}").count() for b in (1, 25, 49)]
    assert written == [items] * 3


def test_items_pass_as_rows(spark, tmpdir_path, few_partitions):
    # a frame of an item made its places floats beside a missing one: 2**53 + 1 was lost
    large = 2**53 + 1
    land(f"{tmpdir_path}/in", 0, [(1, large, "open", 2), (1, None, "open", 3), (1, large - 2, "open", 2)])
    run(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/log", f"{tmpdir_path}/ckpt")
    schema = spark.createDataFrame([], SCHEMA).schema
    got = V.read_versions(spark, f"{tmpdir_path}/log", schema).collect()
    assert sorted(((r.updatedAt - START).days, r.pos) for r in got) == [(2, large), (3, None)]


def test_no_version_of_rows_with_nulls_is_lost(spark, tmpdir_path):
    rows = [(None if i % 7 == 0 else i % 20, None if i % 11 == 0 else i, "s", None if i % 13 == 0 else i % 25) for i in range(400)]
    for b in range(4):
        land(f"{tmpdir_path}/in", b, rows[100 * b:100 * b + 100])
    run(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/log", f"{tmpdir_path}/ckpt")
    got = V.read_versions(spark, f"{tmpdir_path}/log", spark.createDataFrame([], SCHEMA).schema).collect()
    got = [(r.number, r.updatedAt and (r.updatedAt - START).days) for r in got]
    assert len(got) == len(set(got)) and set(got) == {(number, day) for number, _, _, day in rows}


def test_wrong_delay(spark):
    with pytest.raises(ValueError):
        V.version_rows(spark.createDataFrame([], SCHEMA), delay_days=-1)
