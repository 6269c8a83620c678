"""Query tools on hand-made rows: column checks, stable top-n, filters, lookups."""

import pytest

from issuesift.operators import tools as T

ROWS = [("r", 1, 3, "c", "open", "https://x/issues/1", 5, None, "Top25%"),
        ("r", 2, 1, "a", "closed", "https://x/pull/2", 5, True, "Bottom25%"),
        ("r", 3, 2, "b", "OPEN", "https://x/issues/3", None, None, "Top50%"),
        ("r", 4, 4, "d", "merged", "https://x/pull/4", 9, True, "Bottom50%"),
        ("r", 5, 5, "e", None, None, 5, None, None)]
SCHEMA = ("repo string, number long, pos long, title string, state string, url string, total_emojis long, "
          "merged boolean, total_emojis_quartile string")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_require_column_lists_sorted_columns(df):
    with pytest.raises(ValueError, match=r"no column 'nope' in this table; it has \['merged', 'number'"):
        T.top_issues(df, "nope")


def test_top_issues_stable_ties_both_directions(df):
    desc = [r.number for r in T.top_issues(df, "total_emojis", 10).collect()]
    asc = [r.number for r in T.top_issues(df, "total_emojis", 10, descending=False).collect()]
    assert desc == [4, 2, 1, 5]      # ties (5) in storage order: pos 1, 3, 5
    assert asc == [2, 1, 5, 4]
    labels = [r.number for r in T.top_issues(df, "total_emojis_quartile", 2, descending=False).collect()]
    assert labels == [2, 4]          # quartile labels sort as text
    with pytest.raises(ValueError):
        T.top_issues(df, "total_emojis", -1)


def test_status_and_list_filters(df):
    assert sorted(r.number for r in T.status_filter(df, "Open").collect()) == [1, 3]
    assert T.status_filter(df, "whatever").count() == 5
    # merged = a PR in state merged (GraphQL) or closed with merged=true (REST)
    assert sorted(r.number for r in T.list_filter(df, "merged", "prs").collect()) == [2, 4]
    assert sorted(r.number for r in T.list_filter(df, "all", "issues").collect()) == [1, 3, 5]
    types = {r.number: r.issue_type for r in T.with_issue_type(df).collect()}
    assert types == {1: "issue", 2: "pr", 3: "issue", 4: "pr", 5: "issue"}


def test_get_issue_first_match_then_status(spark, df):
    dup = df.unionByName(spark.createDataFrame([("r", 1, 0, "z", "closed", "u", 0, None, None)], SCHEMA))
    assert [r.state for r in T.get_issue(dup, 1).collect()] == ["closed"]          # pos 0 is first
    assert T.get_issue(dup, 1, "open").count() == 0                               # first match fails status
    assert T.get_issue(df, 99).count() == 0


def test_profile_and_sortable(df):
    prof = {r.column: r for r in T.profile_columns(df).collect()}
    assert prof["total_emojis"].nulls == 1 and prof["total_emojis"].max_value == "9"
    assert "state" in T.sortable_columns(df)
