"""Review-submission checks, append and ordinals."""

from pyspark.sql import functions as F

from issuesift.operators import recs as R
from issuesift.operators import tools as T

IN_T = ("repo string, input_pos long, issue_number long, recommendation string, confidence string, "
        "severity string, frequency string, prevalence string, solution_complexity string, solution_risk string, "
        "summary string, rationale string, report string, affected_packages array<string>, "
        "affected_paths array<string>, affected_components array<string>, merge_with array<long>, "
        "relevant_issues array<struct<number:long,title:string,url:string>>")


def row(pos, n, **kw):
    base = dict(repo="r", input_pos=pos, issue_number=n, recommendation="close_merge", confidence="low",
                severity="low", frequency="low", prevalence="low", solution_complexity="low", solution_risk="high",
                summary=" s ", rationale="r", report="p", affected_packages=["a"], affected_paths=[],
                affected_components=[], merge_with=[], relevant_issues=None)
    base.update(kw)
    return tuple(base[k.split()[0]] for k in IN_T.split(", "))


def test_validation_messages_in_order(spark):
    df = spark.createDataFrame([row(0, 1, recommendation="nope", severity="x", summary="  ",
                                    affected_packages=None, relevant_issues=[(1, None, "u")])], IN_T)
    errs = R.validate_recommendations(df).first().errors
    assert errs == [
        "recommendation must be one of: close_completed, close_invalid, close_merge, close_not_planned, "
        "needs_more_info, priority_high, priority_low, priority_medium",
        "severity must be one of: high, low, medium",
        "summary must be a non-empty string",
        "affected_packages must be a list",
        "relevant_issues must be a list of dictionaries with keys: number, title, url"]


def test_append_seq_unknown_issue_and_defaults(spark):
    issues = spark.createDataFrame([("r", 1, 1), ("r", 2, 2)], "repo string, number long, pos long")
    recs = spark.createDataFrame([("r", 1, 1, "priority_low")], "repo string, number long, seq long, recommendation string")
    inputs = spark.createDataFrame([row(0, 1), row(1, 1), row(2, 2), row(3, 9)], IN_T)
    acc, rej = R.append_recommendations(issues, recs, inputs)
    got = sorted((r.number, r.seq, r.summary, r.reviewer, r.relevant_issues) for r in acc.collect())
    assert got == [(1, 2, "s", "ai", []), (1, 3, "s", "ai", []), (2, 1, "s", "ai", [])]
    assert [r.errors for r in rej.collect()] == [["Issue #9 not found"]]
    assert acc.select(F.countDistinct("review_id")).first()[0] == 3


def test_ordinal_latest_and_difficulty(spark):
    recs = spark.createDataFrame([("r", 1, s, "x", "low", "low") for s in range(1, 8)],
                                 "repo string, number long, seq long, recommendation string, "
                                 "solution_complexity string, solution_risk string")
    words = [r.ordinal for r in R.with_ordinal(recs).orderBy("seq").collect()]
    assert words == ["first", "second", "third", "fourth", "fifth", "6th", "7th"]
    lat = T.with_difficulty(T.latest_recommendation(recs)).first()
    assert (lat.recommendations_count, lat.seq, lat.difficulty) == (7, 7, "easy")
