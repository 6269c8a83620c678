"""Embedding and completion plug-ins with the content-hash cache."""

import hashlib
import os

import pandas as pd
from pyspark.sql import functions as F

from issuesift.functions.text import cache_key
from issuesift.operators import embed as EM


def test_embed_cache_retry_and_blank(spark):
    def fake_embedder(texts: pd.Series) -> pd.Series:
        # fails (None) on long inputs, like a remote model over its limit
        return pd.Series([None if len(t) > 20000 else [float(len(t)), 1.0] for t in texts], dtype=object)

    long_text = "First line here\n" + "w " * 15000
    rows = [(1, "short text"), (2, "short text"), (3, long_text), (4, "   "), (5, None), (6, "cached one")]
    df = spark.createDataFrame(rows, "number long, embed_text string")
    cache = spark.createDataFrame([("cached", [9.0, 9.0])], "value string, v array<float>").select(
        cache_key(F.lit("cached one"), "m").alias("key"), F.col("v").alias("value"))
    out, new = EM.embed_issues(df, "embed_text", cache=cache, embedder=fake_embedder, model="m")
    got = {r.number: r.embedding for r in out.collect()}
    assert got[1] == got[2] == [10.0, 1.0]                 # same text, embedded once
    assert got[3] == [float(len("First line here")), 1.0]  # retried with the first line
    assert got[4] is None and got[5] is None               # blank -> no embedding
    assert got[6] == [9.0, 9.0]                            # cache hit
    assert new.count() == 2                                # short text + long text (by its key)


def test_summaries_default_and_plugin(spark):
    df = spark.createDataFrame([(1, "t1", "open"), (2, "t2", "closed")], "number long, title string, state string")
    none, _ = EM.summarize(df)
    assert [r.summary for r in none.collect()] == [None, None]
    def completer(p: pd.Series) -> pd.Series:
        return p.str.len().astype(str)

    out, new = EM.summarize(df, completer=completer)
    assert all(r.summary is not None for r in out.collect()) and new.count() == 2
    prompts = EM.prompt_text(df).collect()
    assert prompts[0].prompt.startswith(EM.PROMPT_HEAD) and '"title":"t1"' in prompts[0].prompt


def test_default_embedding_is_a_function_of_the_text(spark):
    texts = [(1, "Some words and Words"), (2, "other text"), (3, "!!"), (4, None)]
    schema = "number long, embed_text string"
    both, cache = EM.embed_issues(spark.createDataFrame(texts, schema))
    alone, _ = EM.embed_issues(spark.createDataFrame(texts[:1], schema))
    got = {r.number: r.embedding for r in both.collect()}
    assert alone.first().embedding == got[1] != got[2]
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and set(got[3]) == {0.0} and got[4] is None
    warm, new = EM.embed_issues(spark.createDataFrame(texts, schema), cache=cache)
    assert {r.number: r.embedding for r in warm.collect()} == got and new.count() == 0


def test_a_model_sees_each_text_once(spark, tmpdir_path):
    def counting(texts: pd.Series) -> pd.Series:
        import uuid

        for t in texts:
            with open(f"{tmpdir_path}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return pd.Series([[1.0, 2.0] for _ in texts], dtype=object)

    def calls():
        import os

        return sorted(open(f"{tmpdir_path}/{f}").read() for f in os.listdir(tmpdir_path))

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "number long, embed_text string")
    out, new = EM.embed_issues(df, embedder=counting)
    assert out.count() == 3 and out.where("embedding is not null").count() == 3 and new.count() == 2
    assert calls() == ["a", "b"]
    out, new = EM.summarize(df.withColumnRenamed("embed_text", "title"), completer=lambda p: counting(p).map(lambda _: "s"))
    assert out.count() == 3 and new.count() == 3
    assert len(calls()) == 5


def test_a_model_is_given_bounded_parts(spark):
    df = spark.range(2500).coalesce(1).selectExpr("id as number", "concat('t', id) as title")

    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([str(len(texts))] * len(texts))

    out, _ = EM.summarize(df, completer=size)
    got = [int(r.summary) for r in out.collect()]
    assert len(got) == 2500 and max(got) <= EM.PART_ROWS
    long = spark.range(8).coalesce(1).selectExpr("id as number", "concat(repeat('x', 900000), id) as title")
    out, _ = EM.summarize(long, completer=size)
    assert max(int(r.summary) for r in out.collect()) <= EM.PART_BYTES // 900_000


def test_tokens_are_not_shuffled(spark):
    texts = spark.createDataFrame([("k", "b A a é1"), ("none", "!"), ("null", None)], "key string, text string")
    made = EM.embed_texts(texts, dims=4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {r.key: r.value for r in made.collect()}
    assert got["none"] == got["null"] == [0.0] * 4 and abs(sum(x * x for x in got["k"]) - 1) < 1e-6


def _bytes(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_enrichment_stores_texts_once_and_compressed(spark):
    from issuesift.plans.enrich import enrich
    from issuesift.session import ensure_checkpoint_dir

    def text(n: int) -> str:
        return " ".join(hashlib.md5(f"{n} {i}".encode()).hexdigest() for i in range(120))

    rows = [("r", n, f"t{n}", text(n)) for n in [*range(100), 5]]  # number 5 twice
    issues = spark.createDataFrame(rows, "repo string, number long, title string, body string")
    issues = issues.selectExpr("*", "'open' as state", "'a' as author", "cast(null as bigint) as reactions_total")
    said = spark.createDataFrame([("r", n // 3, n, b) for _, n, _, b in rows[:-1]], "repo string, number long, idx long, body string")
    said = said.selectExpr("*", "'a' as author", "1L as reactions_total")
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = _bytes(root)
    out, new = enrich(issues, said)
    kept = out.drop("reactions_total").collect()
    assert _bytes(root) - before < 3 * sum(len(b) for *_, b in rows)  # body, conversation, embedded text
    plain, _ = enrich(issues, said, materialize=False)
    assert sorted(map(str, kept)) == sorted(str(r) for r in plain.select(*out.drop("reactions_total").columns).collect())
    assert len(kept) == 101 and new.count() == 100
