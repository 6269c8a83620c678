import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from issuesift.llm import mixing, quality, toxicity
from issuesift.llm.common import held_out, stage
from issuesift.llm.queries import tokenizer_path
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents
from tests.llm.test_ngram_join import brute


def learn():
    return ~held_out(F.col("doc_id"), 5, 0)


def bag(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, fn in cp.STAGES:
        out.append(stage(fn(spark, out[-1], SF_SMALL), name))
    return out


def test_stages_keep_the_columns_and_run_is_their_chain(spark, outputs):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "ngram_join", "mixing", "packing"]
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns
    assert bag(cp.run(spark, SF_SMALL)) == bag(outputs[-1])


def test_rejected_documents_go(spark, outputs):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    toxic = toxicity.score_toxicity(outputs[0], labels, learn()).where("predicted = 1")
    low = quality.score_quality(outputs[1], labels, learn()).where("predicted = 0")
    for before, after, out in ((outputs[0], outputs[1], toxic), (outputs[1], outputs[2], low)):
        gone = {r.doc_id for r in out.collect()}
        assert gone
        assert bag(after) == bag(before.where(~F.col("doc_id").isin(gone)))


def test_one_document_of_each_group_stays(outputs):
    rows = [(r.doc_id, r.text) for r in outputs[2].collect()]
    groups = {c.split(", ")[2][:-1] for c in brute(rows)}
    assert {str(r.doc_id) for r in outputs[3].collect()} == groups


def test_mix_and_packing(spark, outputs):
    want = {r.doc_id: r.taken for r in mixing.mix(outputs[3]).taken().collect() if r.taken}
    got = {}
    for r in outputs[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == want
    encode = __import__("issuesift.llm.packing", fromlist=["x"]).encoder(tokenizer_path())
    assert outputs[5].agg(F.sum("length")).first()[0] == sum(len(encode(r.text)) + 1 for r in outputs[4].collect())


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here now five six", "en", "a", 0),
            (4, "same words here now five six", "en", None, 0), (4, "same words here now five six", "en", None, 0), (None, "no id at all", None, "b", 0),
            (5, "w " * 50_000, "en", "b", 0)]
    for docs in (documents(spark, rows).withColumn("copy", F.lit(1)).withColumn("label", F.lit("x")), documents(spark, [])):
        for name, fn in cp.STAGES:
            out = stage(fn(spark, docs, SF_SMALL), f"odd-{name}")
            assert name == "packing" or out.columns == docs.columns
            if name == "ngram_join":
                ids = [r.doc_id for r in out.collect()]
                assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 4 not in ids
            docs = out


def test_quality_keeps_all_without_labels(spark):
    folder = tempfile.mkdtemp(prefix="issuesift-test-")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = documents(spark, [(1, "a clean text", "en", "a", 0), (2, None, None, None, 0), (None, "no id", None, None, 0)])
    assert bag(cp.keep_quality(spark, docs, folder)) == bag(docs)


def test_rows_without_or_with_repeated_ids_are_judged_by_their_text(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    scored = toxicity.score_toxicity(docs, labels, learn()).where("predicted = 1")
    toxic = docs.join(scored, "doc_id").select(docs.columns).limit(2).collect()
    clean = docs.join(scored, "doc_id", "left_anti").where("length(text) > 200").limit(1).collect()[0]
    odd = [(None, toxic[0].text, "en", "a", 0), (toxic[0].doc_id, clean.text, "en", "a", 0), (clean.doc_id, toxic[1].text, "en", "a", 0)]
    every = docs.unionByName(documents(spark, odd))
    kept = cp.drop_toxic(spark, every, SF_SMALL)
    assert bag(kept) == bag(every.join(scored.select("doc_id").join(docs, "doc_id").select("text").distinct(), "text", "left_anti").select(docs.columns))
    assert any(r.doc_id == toxic[0].doc_id and r.text == clean.text for r in kept.collect())

    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(None, long, "en", "a", 0), (7, long + " end", "en", "b", 0), (7, other, "en", "a", 0), (7, other, "en", "a", 0), (3, other + " end", "en", "a", 0),
            (None, "alone without an id in this table", None, None, 0), (8, None, None, None, 0), (8, "", None, None, 0)]
    kept = sorted(map(str, ((r.doc_id, r.text) for r in cp.one_per_group(spark, documents(spark, rows), SF_SMALL).collect())))
    assert kept == sorted(map(str, [(7, long + " end"), (3, other + " end"), (None, rows[5][1]), (8, None), (8, "")]))


def test_only_rows_that_may_go_are_shuffled(spark):
    docs = documents(spark, [(i, f"text number {i}", "en", "a", 0) for i in range(2000)] + [(5, None, None, None, 0)])
    keyed, key = cp._keyed(docs)
    gone = stage(keyed.where("doc_id in (7, 8)").select(key), "gone")
    others, maybe = cp._told_apart(keyed, key, gone)
    assert {7, 8} <= {r.doc_id for r in maybe.collect()} and maybe.count() < 200
    assert bag(others.unionByName(maybe)) == bag(keyed)
    plan = others._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # that of the bitmap
    rejected = gone.select(F.col(key).alias("row"))
    assert bag(cp._without(keyed, key, rejected, docs.columns)) == bag(docs.where("doc_id not in (7, 8)"))
