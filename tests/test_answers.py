"""Whole answers (P1, A17), mixed-type top-n (T1) and tags."""

import json

import pytest

from issuesift.operators import tools as T


def mixed(spark, values):
    """``values`` are JSON texts; None is a missing value."""
    return spark.createDataFrame([(i, i, v) for i, v in enumerate(values)], "pos long, number long, j string") \
        .selectExpr("pos", "number", "parse_json(j) AS v")


def brute(values, descending, limit):
    """Python's own stable sort; text where it raises."""
    rows = [(i, json.loads(v)) for i, v in enumerate(values) if v is not None and json.loads(v) is not None]
    try:
        rows.sort(key=lambda r: r[1], reverse=descending)
    except TypeError:
        rows.sort(key=lambda r: str(r[1]) if not isinstance(r[1], (list, dict))
                  else json.dumps(r[1], separators=(",", ":")), reverse=descending)
    return [i for i, _ in rows[:limit]]


CASES = {
    "numbers": ["3", "1.5", "-2", "true", "false", "null", None, "3", "1", "9007199254740993", "9007199254740992"],
    "strings": ['"b"', '"a"', '""', '"é"', '"B"', '"b"', "null", '"\U0001F600"', '"￮"'],
    "number and string": ["10", '"9"', "true", '"True"', "9", '"a"', "null", "10"],
    "lists of numbers": ["[2]", "[1, 5]", "[]", "[1]", "[1, 5]", "[10]"],
    "lists of strings": ['["b"]', '["a", "z"]', "[]", '["a"]'],
    "objects": ['{"a": 2}', '{"a": 1}', '{"a": 10}'],
    "string and list": ['"x"', "[1]", '["b", 2]', '"[1]"'],
    "one value": ["null", "5"],
    "nothing": ["null", None],
}


@pytest.mark.parametrize("case", list(CASES))
def test_mixed_values_sort_like_python(spark, case):
    df = mixed(spark, CASES[case])
    for descending in (True, False):
        got = [r.number for r in T.top_issues_variant(df, "v", 6, descending).collect()]
        assert got == brute(CASES[case], descending, 6), (case, descending)


def test_top_n_of_no_rows_and_unknown_column(spark):
    df = mixed(spark, ["1"])
    assert T.top_issues_variant(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError, match="no column 'w'"):
        T.top_issues_variant(df, "w")


def test_get_issue_gives_whole_reviews(spark):
    issues = spark.createDataFrame([("r", 0, 1, "s", "open"), ("r", 1, 2, None, "open")],
                                   "repo string, pos long, number long, summary string, state string")
    recs = spark.createDataFrame([("r", 1, 2, "b", {"k": 1}), ("r", 1, 1, "a", None), ("q", 1, 1, "x", None)],
                                 "repo string, number long, seq long, recommendation string, meta map<string,int>")
    one = T.get_issue(issues, 1, recs=recs).first()
    assert [(r.seq, r.recommendation, r.meta) for r in one.recommendations] == [(1, "a", None), (2, "b", {"k": 1})]
    assert T.get_issue(issues, 2, recs=recs).first().recommendations == []
    assert T.get_issue(issues, 3, recs=recs).count() == 0


def test_difficulty_answer(spark):
    issues = spark.createDataFrame(
        [("r", 0, 1, 3, 2, 1), ("r", 1, 2, 3, None, None), ("r", 2, 3, 9, 9, 0)],
        "repo string, pos long, number long, total_emojis long, body_emojis long, comment_emojis long")
    recs = spark.createDataFrame(
        [("r", n, 1, "low", "low", "close_merge") for n in (1, 2)] + [("r", 3, 1, "high", "low", "priority_low")],
        "repo string, number long, seq long, solution_complexity string, solution_risk string, recommendation string")
    xrefs = spark.createDataFrame([("r", 1, 1, 8), ("r", 1, 0, 7), ("q", 1, 0, 5), ("r", 2, 0, 6)],
                                  "repo string, src long, idx long, dst long")
    a = T.difficulty_answer(issues, recs, xrefs, "easy").first()      # tie: the first stored
    assert (a.number, a.engagement_score, a.issue_emojis, a.conversation_emojis) == (1, 3, 2, 1)
    assert [(x.idx, x.dst) for x in a.cross_references] == [(0, 7), (1, 8)]
    b = T.difficulty_answer(issues, recs, xrefs, "hard").first()
    assert b.number == 3 and b.cross_references == []
    assert T.difficulty_answer(issues, recs, xrefs, "medium").count() == 0
