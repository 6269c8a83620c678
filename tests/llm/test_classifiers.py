import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuesift.llm import calibration, langid, quality, toxicity
from issuesift.llm.common import held_out
from tests.conftest import SF_MID
from tests.llm.helpers import documents


def learn():
    return ~held_out(F.col("doc_id"), 5, 0)
ODD = [(9001, None, None, None, 0), (9002, "", "xx", None, 0), (9003, " \n\t", "en", None, 0), (9004, "12 34 !!", "en", None, 0),
       (9005, "a" * 200_000, "en", None, 0), (0, "x", None, None, 0), (None, "text without an id", None, None, 0)]


def with_odd(spark, docs):
    return docs.unionByName(documents(spark, ODD)).withColumn("label", F.lit(1)).withColumn("raw", F.lit(0.5)).withColumn("score", F.lit(2.0))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(0, 0, None), (0, 1, 0), (None, 1, 1), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(with_odd(spark, docs), labels.unionByName(odd), learn()).collect()
    assert len(got) == docs.count() + len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    right = [r.predicted == marks[r.doc_id] for r in got if r.doc_id in marks]
    assert np.mean(right) > 0.9
    toxic, clean = ([r.raw for r in got if marks.get(r.doc_id) == k] for k in (1, 0))
    assert np.mean(toxic) > 5 * np.mean(clean)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(with_odd(spark, docs), labels, learn()).withColumn("out", ~learn()).collect()
    assert len(got) == docs.count() + len(ODD)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([r.predicted == marks[r.doc_id] for r in got if r.out and r.doc_id in marks]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_without_labels_or_rows(spark):
    docs, none = documents(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (toxicity.score_toxicity, quality.score_quality):
        assert {(r.score, r.predicted) for r in f(docs, none, learn()).collect()} == {(0.0, 0)}
        assert f(documents(spark, []), none, learn()).count() == 0
    one = spark.createDataFrame([(9002, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, one, learn()).collect()} == {0.0}


def test_distance_prefers_the_dictionary_that_knows_the_word():
    d = toxicity.Distance(b" the and of to in ordinary words here " * 20, b" scoundrel nasty " * 5)
    assert d("scoundrel") > 2 and d("ordinary") == 0 and d("") == 0
    assert d("scoundrel") == d("scoundrel")


@given(st.lists(st.tuples(st.integers(1, 50), st.floats(0, 1)), min_size=1, max_size=40))
def test_pool_is_monotone_and_keeps_the_mean_order(rows):
    n = np.array([r[0] for r in rows])
    pos = np.round(n * [r[1] for r in rows])
    fit = calibration.pool(n, pos)
    assert len(fit) == len(rows) and ((fit >= 0) & (fit <= 1)).all()


@given(st.text("abc", min_size=5, max_size=60), st.text("abcd", min_size=1, max_size=300))
def test_phrases_against_greedy_parse(train, text):
    code = {c: i for i, c in enumerate("abc")}
    a = langid.Automaton(np.array([code[c] for c in train]), 3)
    lanes = [[code.get(c, 3) for c in text[i:i + langid.LANE]] for i in range(0, len(text), langid.LANE)]
    lanes = np.array([x + [4] * (langid.LANE - len(x)) for x in lanes], np.int32).T
    want = 0
    for i in range(0, len(text), langid.LANE):
        part, at = text[i:i + langid.LANE], 0
        phrase = ""
        want += 1
        while at < len(part):
            if phrase + part[at] in train:
                phrase += part[at]
            else:
                want += 1
                phrase = part[at] if part[at] in train else ""
            at += 1
    assert a.phrases(lanes).sum() == want


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    may = ~held_out(F.col("doc_id"), 4, 2)
    known = docs.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    got = langid.predict_language(known.unionByName(documents(spark, ODD)).withColumn("h", F.lit(1)), may).withColumn("out", ~may).collect()
    assert len(got) == docs.count() + len(ODD)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.out and r.doc_id in truth]) > 0.97
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (9001, 9002, 9003, 9004)} == {"und"} and by[9004].score == 0.0
    assert by[9005].lang_pred != "und" and by[None].lang_pred == "en"


def test_language_without_training_or_rows(spark):
    docs = documents(spark, [(1, "text", None, None, 0)])
    assert [tuple(r) for r in langid.predict_language(docs, F.lit(True)).collect()] == [(1, "und", 0.0)]
    assert langid.predict_language(documents(spark, []), F.lit(True)).count() == 0
    one = documents(spark, [(1, "some words", "en", None, 0), (2, "other", None, None, 0)])
    assert {(r.lang_pred, r.score) for r in langid.predict_language(one, F.lit(True)).collect()} == {("en", 1.0)}


def test_copies_of_a_text_take_one_training_place(spark):
    texts = [f"text number {i} of the language" for i in range(12)]
    first = spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.xxhash64("text")).first().text
    rows = [(i, first, "en", None, 0) for i in range(50)] + [(100 + i, t, "en", None, 0) for i, t in enumerate(texts)]
    got = langid.train(documents(spark, rows).select("doc_id", "text", "lang"), max_docs=12)["en"].decode()
    assert sorted(got.strip().replace(" text", "\ntext").split("\n")) == sorted(texts)
