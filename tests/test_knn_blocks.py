"""Exact neighbours by packed blocks, and an enrichment that moves texts and vectors seldom."""

import os
import re

import numpy as np
import pytest

from issuesift.operators import conversation as C
from issuesift.operators import embed as EM
from issuesift.operators import knn as K
from issuesift.operators import knn_blocks as B
from issuesift.plans import enrich as E
from issuesift.session import ensure_checkpoint_dir
from tests.test_knn import _frame, brute


@pytest.mark.parametrize("kind", ["array<float>", "array<double>"])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_equal_brute_force(spark, monkeypatch, metric, kind):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    monkeypatch.setattr(B, "MANY", 2)
    df, vecs, ids = _frame(spark)
    got = {}
    cast = df.withColumn("embedding", df.embedding.cast(kind)).repartition(3)
    for r in K.knn_pairs(cast, 4, metric, method="blocks").collect():
        got.setdefault(r.q, []).append((r.rank, r.c, r.distance))
    want = brute(vecs, ids, 4, metric)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [c for _, c, _ in sorted(found)] == [c for _, c in want[q]], q
        assert np.allclose([d for _, _, d in sorted(found)], [d for d, _ in want[q]], atol=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("scale", [1e-12, 1.0, 1e18])
def test_screening_loses_nothing(metric, scale):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)) * scale
    v[50:150] = v[3]                                   # more equal ones than MANY
    v[200:220] = v[4] * (1 + 1e-9 * rng.normal(size=(20, 1)))
    whole, rows = B.Best(300, 5), B.Rows(np.arange(300), v, metric)
    d = B._distance(rows.v @ rows.v.T, rows.sq[:, None], rows.sq[None, :], metric)
    np.fill_diagonal(d, np.inf)
    for part in (rows.part(0, 40), rows.part(40, 160), rows.part(160, 300)):
        B.search(whole, rows, part, metric, B.screen(rows, part, metric))
    back = B.Best(300, 5)
    for part in (rows.part(0, 40), rows.part(40, 300)):
        B.search(back, rows, part, metric, B.screen(part, rows, metric), back=True)
    want = np.sort(d, axis=1)[:, :5]
    for best in (whole, back):
        assert np.allclose(best.d, want, rtol=1e-6, atol=1e-7 * (scale if metric != "cosine" else 1))


def test_sample_tells_clusters_from_noise(spark):
    rng = np.random.default_rng(2)
    centres = 5 * rng.normal(size=(8, 6))
    near = [(i, [float(x) for x in centres[i % 8] + 0.01 * rng.normal(size=6)]) for i in range(400)]
    far = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(400)]
    share = [B.separable(spark.createDataFrame(rows, "id long, v array<double>"), "cosine") for rows in (near, far)]
    assert share[0] < 0.3 and share[1] > 0.8


def corpus(spark, n=60):
    issues = [("r", i, i, f"t{i}", None if i % 7 == 0 else f"body {i % 20} " + "word " * (i % 9), "open", "a") for i in range(n)]
    comments = [("r", i // 10, i, f"comment {i % 5}", "b", i % 3) for i in range(n)]
    return (spark.createDataFrame(issues, "repo string, pos long, number long, title string, body string, state string, author string"),
            spark.createDataFrame(comments, "repo string, number long, idx long, body string, author string, reactions_total long"))


def test_gathered_comments_move_once(spark):
    from pyspark.sql import functions as F

    issues, comments = (t.withColumn("repo", F.lit("r")) for t in corpus(spark))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.conversation(issues, comments)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above = plan[:plan.index("ObjectHashAggregate")]   # of the gathered parts
    assert len(re.findall("Exchange hashpartitioning", above)) == 1     # the issues; the parts stay where they are


def test_embedding_by_row_is_that_by_key(spark):
    issues, comments = corpus(spark)
    texts = C.embedding_text(issues, comments).withColumn("row", issues.pos)
    cache = texts.where("number < 5").selectExpr("concat('local-hash:', sha2(embed_text, 256)) AS key", "array(cast(1 as float)) AS value")
    for few in (10_000, 0):
        old, EM.FEW_ROWS = EM.FEW_ROWS, few
        try:
            for c in (None, cache):
                plain, new = EM.embed_issues(texts, cache=c, dims=16)
                by_row, new_by_row = EM.embed_issues(texts, cache=c, dims=16, row="row")
                assert sorted(map(str, plain.select("number", "embedding").collect())) == sorted(map(str, by_row.select("number", "embedding").collect()))
                assert sorted(map(str, new.collect())) == sorted(map(str, new_by_row.collect()))
        finally:
            EM.FEW_ROWS = old


def test_stored_and_plain_enrichment_agree(spark):
    issues, comments = corpus(spark)
    issues = issues.selectExpr("*", "cast(null as bigint) AS reactions_total")
    names = None
    got = []
    for materialize in (True, False):
        out, _ = E.enrich(issues, comments, materialize=materialize)
        names = names or sorted(out.columns)
        assert sorted(out.columns) == names
        got.append(sorted(map(str, out.select(*names).collect())))
    assert got[0] == got[1]
    folder = os.path.join(re.sub("^file:", "", ensure_checkpoint_dir(spark)), "tables")
    stored = [d for d in os.listdir(folder) if d.startswith("enriched-")]
    schema = spark.read.parquet(os.path.join(folder, stored[-1])).columns
    assert "_texts" in schema and "body" not in schema and "embed_text" not in schema
