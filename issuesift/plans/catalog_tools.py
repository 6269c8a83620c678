"""Catalog: query tools, review log and incremental-ingest operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import sql_with
from ..operators import incremental as I
from ..operators import recs as R
from ..operators import tools as T
from ..session import scratch_path
from ..sources import buckets as B
from . import enrich as E
from .registry import ORACLE, register, sql_blank, sql_strip, sql_ts, ts_str

_LEVELS_SQL = "('low', 'medium', 'high')"
_RECS_SQL = ", ".join(f"'{r}'" for r in R.RECOMMENDATIONS)


# ------------------------------------------------------------------ P2, P3, P4
@register("status_filter", sql_with("issues") + """
SELECT number, state FROM issues WHERE lower(coalesce(state, '')) = 'open'""")
def q_status_filter(spark, sf):
    return T.status_filter(fx.orders_issues(spark, sf), "open").select("number", "state")


@register("status_filter_any", sql_with("issues") + "SELECT number, state FROM issues")
def q_status_filter_any(spark, sf):
    # an unrecognised status keeps every row
    return T.status_filter(fx.orders_issues(spark, sf), "pending").select("number", "state")


@register("issue_type", sql_with("issues") + """
SELECT number, CASE WHEN coalesce(url, '') LIKE '%/pull/%' THEN 'pr' ELSE 'issue' END AS issue_type
FROM issues""")
def q_issue_type(spark, sf):
    return T.with_issue_type(fx.orders_issues(spark, sf)).select("number", "issue_type")


@register("list_filter", sql_with("issues") + """
SELECT number FROM issues WHERE coalesce(url, '') LIKE '%/pull/%'
  AND (lower(coalesce(state, '')) = 'merged' OR (lower(coalesce(state, '')) = 'closed' AND coalesce(merged, false)))""")
def q_list_filter(spark, sf):
    return T.list_filter(fx.orders_issues(spark, sf), "merged", "prs").select("number")


@register("list_filter_closed_issues", sql_with("issues") + """
SELECT number FROM issues WHERE coalesce(url, '') NOT LIKE '%/pull/%'
  AND lower(coalesce(state, '')) = 'closed'""")
def q_list_filter_closed(spark, sf):
    return T.list_filter(fx.orders_issues(spark, sf), "closed", "issues").select("number")


# ------------------------------------------------------------------ P1, P15, P7
@register("get_issue", sql_with("enriched", "recs") + """
SELECT e.number, e.summary, e.state, CAST(coalesce(r.n, 0) AS BIGINT) AS recommendations_count
FROM (SELECT * FROM enriched WHERE number = 10 ORDER BY pos LIMIT 1) e
LEFT JOIN (SELECT number, count(*) AS n FROM recs GROUP BY number) r ON e.number = r.number""")
def q_get_issue(spark, sf):
    c = E.orders_corpus(spark, sf)
    hit = T.get_issue(E.orders_enriched(spark, sf), 10, None, recs=c["recs"])
    return hit.select("number", "summary", "state",
                      F.size("recommendations").cast("bigint").alias("recommendations_count"))


@register("get_issue_status", sql_with("issues") + """
SELECT number, state FROM (SELECT * FROM issues WHERE number = 10 ORDER BY pos LIMIT 1)
WHERE lower(coalesce(state, '')) = 'closed'""")
def q_get_issue_status(spark, sf):
    return T.get_issue(fx.orders_issues(spark, sf), 10, "closed").select("number", "state")


_PROFILE_COLS = ["pos", "number", "title", "body", "state", "item_type", "createdAt", "updatedAt", "url",
                 "author", "reactions_total", "number_of_comments", "mergeable", "merged", "merged_at",
                 "base_ref", "head_ref"]


@register("profile_columns", sql_with("issues") + "\n UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS non_null,
        CAST(count(*) - count({c}) AS BIGINT) AS nulls,
        CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM issues"""
    for c in _PROFILE_COLS))
def q_profile_columns(spark, sf):
    p = T.profile_columns(fx.orders_issues(spark, sf), _PROFILE_COLS)
    return p.select("column", "non_null", "nulls", "min_value", "max_value")


# ------------------------------------------------------------------ P8, P9, P14, A17, W5
@register("first_unreviewed", sql_with("enriched", "recs") + """
SELECT number, title, summary, url, state FROM enriched
WHERE lower(coalesce(state, '')) = 'open' AND number NOT IN (SELECT number FROM recs)
ORDER BY pos LIMIT 1""")
def q_first_unreviewed(spark, sf):
    c = E.orders_corpus(spark, sf)
    return T.first_without_recommendation(E.orders_enriched(spark, sf), c["recs"], "open").drop("pos")


_LATEST_SQL = """latest AS (SELECT number, count(*) AS recommendations_count,
    arg_max(recommendation, seq) AS recommendation, arg_max(confidence, seq) AS confidence,
    arg_max(solution_complexity, seq) AS solution_complexity, arg_max(solution_risk, seq) AS solution_risk,
    max(seq) AS seq FROM recs GROUP BY number)"""
_DIFF_SQL = """CASE WHEN lower(coalesce(solution_complexity, '')) = 'low' AND lower(coalesce(solution_risk, '')) = 'low'
    THEN 'easy' WHEN lower(coalesce(solution_complexity, '')) = 'high' OR lower(coalesce(solution_risk, '')) = 'high'
    THEN 'hard' ELSE 'medium' END"""


@register("latest_rec", sql_with("recs") + ", " + _LATEST_SQL + """
SELECT number, CAST(recommendations_count AS BIGINT) AS recommendations_count, seq, recommendation, confidence
FROM latest""")
def q_latest_rec(spark, sf):
    lat = T.latest_recommendation(fx.label_recs(spark, sf))
    return lat.select("number", "recommendations_count", "seq", "recommendation", "confidence")


@register("difficulty", sql_with("recs") + ", " + _LATEST_SQL + f"""
SELECT number, solution_complexity, solution_risk, {_DIFF_SQL} AS difficulty FROM latest""")
def q_difficulty(spark, sf):
    lat = T.with_difficulty(T.latest_recommendation(fx.label_recs(spark, sf)))
    return lat.select("number", "solution_complexity", "solution_risk", "difficulty")


def _by_difficulty_sql(level: str) -> str:
    return sql_with("enriched", "recs") + ", " + _LATEST_SQL + f"""
SELECT e.number, e.title, e.summary, e.url, e.state, '{level}' AS difficulty,
       CAST(coalesce(e.total_emojis, 0) AS BIGINT) AS engagement_score,
       l.solution_complexity, l.solution_risk, l.recommendation,
       CAST(l.recommendations_count AS BIGINT) AS recommendations_count
FROM enriched e JOIN latest l ON e.number = l.number
WHERE {_DIFF_SQL.replace('solution_', 'l.solution_')} = '{level}'
ORDER BY engagement_score DESC, e.pos ASC LIMIT 1"""


def _by_difficulty(level: str):
    def q(spark, sf):
        c = E.orders_corpus(spark, sf)
        return T.issue_by_difficulty(E.orders_enriched(spark, sf), c["recs"], level).select(
            "number", "title", "summary", "url", "state", "difficulty", "engagement_score",
            "solution_complexity", "solution_risk", "recommendation",
            F.col("recommendations_count").cast("bigint").alias("recommendations_count"))
    return q


for _lvl in ("easy", "medium", "hard"):
    register(f"by_difficulty_{_lvl}", _by_difficulty_sql(_lvl))(_by_difficulty(_lvl))


@register("rec_ordinal", sql_with("recs") + """
SELECT number, seq, CAST(row_number() OVER (PARTITION BY number ORDER BY seq) AS BIGINT) AS position,
  CASE row_number() OVER (PARTITION BY number ORDER BY seq) WHEN 1 THEN 'first' WHEN 2 THEN 'second'
  WHEN 3 THEN 'third' WHEN 4 THEN 'fourth' WHEN 5 THEN 'fifth'
  ELSE CAST(row_number() OVER (PARTITION BY number ORDER BY seq) AS VARCHAR) || 'th' END AS ordinal
FROM recs""")
def q_rec_ordinal(spark, sf):
    return R.with_ordinal(fx.label_recs(spark, sf)).select(
        "number", "seq", F.col("position").cast("bigint").alias("position"), "ordinal")


_REC_ERRORS_SQL = "concat_ws('; ', " + ", ".join(
    [f"CASE WHEN recommendation IS NULL OR recommendation NOT IN ({_RECS_SQL}) THEN "
     f"'recommendation must be one of: {', '.join(sorted(R.RECOMMENDATIONS))}' END"]
    + [f"CASE WHEN {f} IS NULL OR {f} NOT IN {_LEVELS_SQL} THEN '{f} must be one of: high, low, medium' END"
       for f in R.LEVEL_FIELDS]
    + [f"CASE WHEN {sql_blank(f)} THEN '{f} must be a non-empty string' END" for f in R.TEXT_FIELDS]
    + ["CASE WHEN issue_number IS NULL THEN 'issue_number must be an integer' END"]) + ")"


@register("validate_recs", sql_with("rec_inputs") + f"""
SELECT issue_number, {_REC_ERRORS_SQL} AS errors FROM rec_inputs""")
def q_validate_recs(spark, sf):
    v = R.validate_recommendations(fx.rec_inputs(spark, sf))
    return v.select("issue_number", F.array_join("errors", "; ").alias("errors"))


@register("append_recs", sql_with("rec_inputs", "issues", "recs") + f""",
ok AS (SELECT * FROM rec_inputs WHERE {_REC_ERRORS_SQL} = ''
       AND issue_number IN (SELECT number FROM issues)),
prior AS (SELECT number, count(*) AS n FROM recs GROUP BY number)
SELECT ok.issue_number AS number,
  CAST(coalesce(p.n, 0) + row_number() OVER (PARTITION BY ok.issue_number ORDER BY ok.input_pos) AS BIGINT) AS seq,
  recommendation, {sql_strip('summary')} AS summary
FROM ok LEFT JOIN prior p ON ok.issue_number = p.number""")
def q_append_recs(spark, sf):
    c = E.orders_corpus(spark, sf)
    acc, _rej = R.append_recommendations(c["issues"], c["recs"], fx.rec_inputs(spark, sf))
    return acc.select("number", "seq", "recommendation", "summary")


@register("rejected_recs", sql_with("rec_inputs", "issues") + f"""
SELECT issue_number, CASE WHEN {_REC_ERRORS_SQL} <> '' THEN {_REC_ERRORS_SQL}
  ELSE 'Issue #' || CAST(issue_number AS VARCHAR) || ' not found' END AS errors
FROM rec_inputs WHERE {_REC_ERRORS_SQL} <> '' OR issue_number NOT IN (SELECT number FROM issues)""")
def q_rejected_recs(spark, sf):
    c = E.orders_corpus(spark, sf)
    _acc, rej = R.append_recommendations(c["issues"], c["recs"], fx.rec_inputs(spark, sf))
    return rej.select("issue_number", F.array_join("errors", "; ").alias("errors"))


# ------------------------------------------------------------------ P11, P12, P13
@register("pull_filter", sql_with("issues") + """
SELECT number FROM issues WHERE lower(coalesce(state, '')) = 'open' AND item_type = 'issue'""")
def q_pull_filter(spark, sf):
    return T.pull_filter(fx.orders_issues(spark, sf), include_closed=False, item_types="issues").select("number")


@register("pull_since", sql_with("issues") + f"""
SELECT number, {sql_ts('updatedAt')} AS updatedAt FROM issues WHERE updatedAt >= TIMESTAMP '1997-06-01'""")
def q_pull_since(spark, sf):
    return T.since_filter(fx.orders_issues(spark, sf), "1997-06-01").select("number", ts_str("updatedAt").alias("updatedAt"))


@register("pull_since_limit", sql_with("issues") + f"""
SELECT number, {sql_ts('updatedAt')} AS updatedAt FROM issues WHERE updatedAt >= TIMESTAMP '1997-06-01'
ORDER BY issues.updatedAt, pos LIMIT 100""")
def q_pull_since_limit(spark, sf):
    return T.since_filter(fx.orders_issues(spark, sf), "1997-06-01", limit=100).select(
        "number", ts_str("updatedAt").alias("updatedAt"))


@register("select_numbers", sql_with("issues") + """
SELECT number, title FROM issues WHERE number IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def q_select_numbers(spark, sf):
    refetch = fx.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("number"))
    return T.select_numbers(fx.orders_issues(spark, sf), refetch).select("number", "title")


# ------------------------------------------------------------------ J3, J6, S8
@register("xref_status", sql_with("issues", "xrefs") + """
SELECT x.src, x.idx, x.dst, x.type FROM xrefs x
WHERE x.src = 100 AND EXISTS (SELECT 1 FROM issues WHERE number = 100)
  AND x.dst <> 0 AND x.dst IN (SELECT number FROM issues WHERE lower(coalesce(state, '')) = 'open')""")
def q_xref_status(spark, sf):
    c = E.orders_corpus(spark, sf)
    return T.cross_referenced(c["issues"], c["xrefs"], 100, "open").select("src", "idx", "dst", "type")


@register("xref_status_118", sql_with("issues", "xrefs") + """
SELECT x.src, x.idx, x.dst, x.type FROM xrefs x
WHERE x.src = 118 AND EXISTS (SELECT 1 FROM issues WHERE number = 118)
  AND x.dst <> 0 AND x.dst IN (SELECT number FROM issues WHERE lower(coalesce(state, '')) = 'open')""")
def q_xref_status_open_118(spark, sf):
    # an issue whose references reach open issues (the first example reaches none)
    c = E.orders_corpus(spark, sf)
    return T.cross_referenced(c["issues"], c["xrefs"], 118, "open").select("src", "idx", "dst", "type")


@register("xref_unknown_status", sql_with("xrefs") + "SELECT src, idx, dst, type FROM xrefs WHERE false")
def q_xref_unknown_status(spark, sf):
    # an unrecognised status returns nothing for cross references
    c = E.orders_corpus(spark, sf)
    return T.cross_referenced(c["issues"], c["xrefs"], 118, "pending").select("src", "idx", "dst", "type")


@register("xref_all", sql_with("issues", "xrefs") + """
SELECT x.src, x.idx, x.dst, x.type FROM xrefs x
WHERE x.src = 100 AND EXISTS (SELECT 1 FROM issues WHERE number = 100)""")
def q_xref_all(spark, sf):
    c = E.orders_corpus(spark, sf)
    return T.cross_referenced(c["issues"], c["xrefs"], 100).select("src", "idx", "dst", "type")


@register("linked_issues", sql_with("issues", "xrefs") + """
SELECT x.idx AS ref_idx, i.number, i.title, i.state FROM xrefs x JOIN issues i ON x.dst = i.number
WHERE x.src = 100 AND x.dst IS NOT NULL AND x.dst <> 0""")
def q_linked_issues(spark, sf):
    c = E.orders_corpus(spark, sf)
    return T.linked_issues(c["issues"], c["xrefs"], 100).select("ref_idx", "number", "title", "state")


@register("export_open", sql_with("enriched") + """
SELECT '#' || CAST(number AS VARCHAR) AS name, coalesce(title, '') AS title, coalesce(url, '') AS url,
       summary FROM enriched WHERE upper(coalesce(state, '')) = 'OPEN'""")
def q_export_open(spark, sf):
    from ..sources.export import open_issues_export
    return open_issues_export(E.orders_enriched(spark, sf))


# ------------------------------------------------------------------ A1-A6, J2, W1, S3
@register("watermark", sql_with("issues") + f"SELECT {sql_ts('max(updatedAt)')} AS watermark FROM issues")
def q_watermark(spark, sf):
    return I.last_updated(fx.orders_issues(spark, sf)).select(ts_str("watermark").alias("watermark"))


@register("coverage", sql_with("issues") + f"""
SELECT {sql_ts('min(createdAt)')} AS coverage_start, {sql_ts('max(createdAt)')} AS coverage_end FROM issues""")
def q_coverage(spark, sf):
    cov = I.coverage(fx.orders_issues(spark, sf), "create")
    return cov.select(ts_str("coverage_start").alias("coverage_start"), ts_str("coverage_end").alias("coverage_end"))


@register("since", sql_with("issues") + f"""
SELECT {sql_ts("max(updatedAt) - INTERVAL 7 DAY")} AS since FROM issues""")
def q_since(spark, sf):
    return I.since(fx.orders_issues(spark, sf)).select(ts_str("since").alias("since"))


@register("new_items", sql_with("vectors") + """
SELECT doc_id AS number FROM documents WHERE doc_id NOT IN (SELECT number FROM vectors)""")
def q_new_items(spark, sf):
    page = fx.docs_issues(spark, sf)
    return I.new_items(page, fx.vectors(spark, sf)).select("number")


@register("page_needs", sql_with("updates") + """,
cov AS (SELECT min(updatedAt) - INTERVAL 1 DAY AS lo, max(updatedAt) + INTERVAL 1 DAY AS hi
        FROM updates WHERE updatedAt < TIMESTAMP '2024-01-15')
SELECT pos // 100 AS page, bool_or(updatedAt < cov.lo OR updatedAt > cov.hi) AS needs_processing
FROM updates, cov GROUP BY pos // 100""")
def q_page_needs(spark, sf):
    items = fx.event_updates(spark, sf).withColumn("page", F.expr("pos div 100"))
    stored = items.where(F.col("updatedAt") < F.to_timestamp(F.lit("2024-01-15")))
    return I.page_needs_processing(items, I.coverage(stored, "update"), "update")


@register("pull_stats", sql_with("issues", "xrefs") + """,
nx AS (SELECT src AS number, count(*) AS n FROM xrefs GROUP BY src),
it AS (SELECT i.number // 100 AS page, i.number_of_comments, coalesce(nx.n, 0) AS nx
       FROM issues i LEFT JOIN nx ON i.number = nx.number)
SELECT page, CAST(count(*) AS BIGINT) AS items, CAST(sum(number_of_comments) AS BIGINT) AS comments,
       CAST(sum(nx) AS BIGINT) AS cross_references FROM it GROUP BY ROLLUP (page)""")
def q_pull_stats(spark, sf):
    c = E.orders_corpus(spark, sf)
    items = c["issues"].withColumn("page", F.expr("number div 100"))
    return I.pull_stats(items, c["xrefs"])


@register("latest_version", sql_with("updates") + f"""
SELECT number, pos, state, {sql_ts('updatedAt')} AS updatedAt FROM (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY updatedAt DESC, pos DESC) AS rn FROM updates)
WHERE rn = 1""")
def q_latest_version(spark, sf):
    lv = I.latest_version(fx.event_updates(spark, sf))
    return lv.select("number", "pos", "state", ts_str("updatedAt").alias("updatedAt"))


@register("upsert_items", sql_with("updates") + f""",
lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY updatedAt DESC, pos DESC) AS rn
       FROM updates WHERE updatedAt < TIMESTAMP '2024-01-15') WHERE rn = 1),
tgt AS (SELECT number, pos, state, updatedAt, 'kept-' || CAST(number AS VARCHAR) AS summary FROM lv),
upd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY updatedAt DESC, pos DESC) AS rn
        FROM updates WHERE updatedAt >= TIMESTAMP '2024-01-15') WHERE rn = 1)
SELECT coalesce(u.number, t.number) AS number,
  CASE WHEN u.number IS NOT NULL THEN u.pos ELSE t.pos END AS pos,
  CASE WHEN u.number IS NOT NULL THEN u.state ELSE t.state END AS state,
  {sql_ts("CASE WHEN u.number IS NOT NULL THEN u.updatedAt ELSE t.updatedAt END")} AS updatedAt,
  t.summary AS summary
FROM tgt t FULL OUTER JOIN upd u ON t.number = u.number""")
def q_upsert_items(spark, sf):
    ev = fx.event_updates(spark, sf).select("repo", "number", "pos", "state", "updatedAt")
    cut = F.to_timestamp(F.lit("2024-01-15"))
    target = I.latest_version(ev.where(F.col("updatedAt") < cut)).withColumn(
        "summary", F.concat(F.lit("kept-"), F.col("number").cast("string")))
    out = I.upsert(target, ev.where(F.col("updatedAt") >= cut))
    return out.select("number", "pos", "state", ts_str("updatedAt").alias("updatedAt"), "summary")


@register("upsert_items_stored", ORACLE["upsert_items"])
def q_upsert_items_stored(spark, sf):
    """The same upsert over a collection stored in buckets by (repo, number):
    only the update's newest versions are shuffled."""
    ev = fx.event_updates(spark, sf).select("repo", "number", "pos", "state", "updatedAt")
    cut = F.to_timestamp(F.lit("2024-01-15"))
    target = I.latest_version(ev.where(F.col("updatedAt") < cut)).withColumn(
        "summary", F.concat(F.lit("kept-"), F.col("number").cast("string")))
    base = scratch_path(spark, f"buckets-{uuid.uuid4().hex}")
    b = B.write_buckets(target, f"{base}/first", I.KEY, 8)
    out = B.read_buckets(spark, B.upsert_buckets(spark, b, ev.where(F.col("updatedAt") >= cut), base))
    return out.select("number", "pos", "state", ts_str("updatedAt").alias("updatedAt"), "summary")


@register("union_types", sql_with("issues") + """
SELECT number, item_type, merged FROM issues""")
def q_union_types(spark, sf):
    iss = fx.orders_issues(spark, sf)
    issues_only = iss.where(F.col("item_type") == "issue").drop(
        "mergeable", "merged", "merged_at", "base_ref", "head_ref")
    prs = iss.where(F.col("item_type") == "pull_request")
    return issues_only.unionByName(prs, allowMissingColumns=True).select("number", "item_type", "merged")


# ------------------------------------------------------------------ A13, A20
@register("enrich_stats", sql_with("ivec") + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(embedding) AS BIGINT) AS with_embedding,
       CAST(count(summary) AS BIGINT) AS with_summary FROM ivec""")
def q_enrich_stats(spark, sf):
    return T.enrich_stats(E.orders_with_embeddings(spark, sf))


@register("issue_tags", sql_with("issues") + """
SELECT number, 'prio-' || substring(title, 1, 1) AS labels, CAST(0 AS BIGINT) AS more_labels, '' AS assignees
FROM issues""")
def q_issue_tags(spark, sf):
    from ..sources import pages as P
    from .catalog_sources import graphql_pages

    ip, pp = graphql_pages(spark, sf)
    items = P.read_graphql_pages(spark, ip, "issues", fx.REPO_ORDERS).unionByName(
        P.read_graphql_pages(spark, pp, "pull_requests", fx.REPO_ORDERS), allowMissingColumns=True)
    return T.issue_tags(items)


# ------------------------------------------------------------------ whole answers: P1, A17, T1 over mixed values, A20
_REC_FIELDS = ["seq", "recommendation", "confidence", "summary", "rationale", "report", "severity", "frequency",
               "prevalence", "solution_complexity", "solution_risk"]


@register("get_issue_reviews", sql_with("recs") + """
SELECT number, string_agg(concat_ws('/', seq, recommendation, confidence, 'review of ' || number, 'rationale',
  'report', 'medium', 'low', 'low', solution_complexity, solution_risk), '; ' ORDER BY seq) AS reviews
FROM recs WHERE number = (SELECT min(number) FROM recs WHERE seq = 2) GROUP BY number""")
def q_get_issue_reviews(spark, sf):
    """P1 with whole reviews, for the first issue reviewed twice."""
    c = E.orders_corpus(spark, sf)
    number = c["recs"].where(F.col("seq") == 2).agg(F.min("number")).first()[0]
    hit = T.get_issue(E.orders_enriched(spark, sf), -1 if number is None else number, None, recs=c["recs"])
    one = F.transform("recommendations", lambda r: F.concat_ws("/", *[r[f].cast("string") for f in _REC_FIELDS]))
    return hit.select("number", F.array_join(one, "; ").alias("reviews"))


def _answer_sql(level: str) -> str:
    return _by_difficulty_sql(level).replace(
        "FROM enriched e JOIN latest", """, e.body_emojis AS issue_emojis, e.comment_emojis AS conversation_emojis,
  coalesce((SELECT string_agg(concat_ws('/', x.dst, x.type, x.title, x.url), '; ' ORDER BY x.idx)
            FROM xrefs x WHERE x.src = e.number), '') AS cross_references
FROM enriched e JOIN latest""").replace("WITH ", sql_with("xrefs") + ", ", 1)


def _answer(level: str):
    def q(spark, sf):
        c = E.orders_corpus(spark, sf)
        a = T.difficulty_answer(E.orders_enriched(spark, sf), c["recs"], c["xrefs"], level)
        one = F.transform("cross_references", lambda x: F.concat_ws(
            "/", x["dst"].cast("string"), x["type"], x["title"], x["url"]))
        return a.select("number", "title", "summary", "url", "state", "difficulty", "engagement_score",
                        "issue_emojis", "conversation_emojis", "solution_complexity", "solution_risk",
                        "recommendation", F.col("recommendations_count").cast("bigint").alias("recommendations_count"),
                        F.array_join(one, "; ").alias("cross_references"))
    return q


for _lvl in ("easy", "medium", "hard"):
    register(f"difficulty_answer_{_lvl}", _answer_sql(_lvl))(_answer(_lvl))


def _mixed_issues(spark, sf, open_value):
    """Order-issues with a VARIANT: closed ones their comment count, merged ones true,
    open ones what ``open_value`` says."""
    i = fx.orders_issues(spark, sf)
    return i.withColumn("extra", F.parse_json(
        F.when(F.col("state") == "closed", F.col("number_of_comments").cast("string"))
         .when(F.col("state") == "merged", F.lit("true")).otherwise(open_value)))


@register("top_issues_variant", sql_with("issues") + """
SELECT number, title, url FROM (SELECT *, CASE state WHEN 'closed' THEN CAST(number_of_comments AS VARCHAR)
  WHEN 'merged' THEN 'True' ELSE title END AS extra FROM issues)
WHERE extra IS NOT NULL ORDER BY extra ASC, pos ASC LIMIT 500""")
def q_top_issues_variant(spark, sf):
    """Numbers, truth values and strings do not compare: all as text."""
    mixed = _mixed_issues(spark, sf, F.to_json(F.struct("title")))
    mixed = mixed.withColumn("extra", F.expr("coalesce(variant_get(extra, '$.title', 'variant'), extra)"))
    return T.top_issues_variant(mixed, "extra", 500, descending=False)


@register("top_issues_variant_numbers", sql_with("issues") + """
SELECT number, title, url FROM (SELECT *, CASE state WHEN 'closed' THEN number_of_comments
  WHEN 'merged' THEN 1 END AS extra FROM issues)
WHERE extra IS NOT NULL ORDER BY extra DESC, pos ASC LIMIT 500""")
def q_top_issues_variant_numbers(spark, sf):
    """Numbers and truth values compare; nulls are dropped."""
    return T.top_issues_variant(_mixed_issues(spark, sf, F.lit("null")), "extra", 500)


@register("issue_tags_lines", sql_with("issues") + """,
l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
        AS flags, list(l_linestatus ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS st
      FROM lineitem GROUP BY l_orderkey),
n AS (SELECT i.number, list_filter(coalesce(l.flags, []), lambda x: x <> 'R') AS names,
        list_filter(coalesce(l.st, []), lambda x: x <> 'O') AS logins
      FROM issues i LEFT JOIN l ON i.number = l.l_orderkey)
SELECT number, array_to_string(names[1:5], ', ') AS labels,
  CAST(greatest(len(names) - 5, 0) AS BIGINT) AS more_labels, array_to_string(logins, ', ') AS assignees FROM n""")
def q_issue_tags_lines(spark, sf):
    """A20 over lists of any length: a label and an assignee per line of the order, in
    comment order; returned lines have an empty label, open ones an assignee without login."""
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    name = F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.col("l_returnflag"))
    login = F.when(F.col("l_linestatus") != "O", F.col("l_linestatus"))
    lines = (fx.table(spark, sf, "lineitem")
             .select(F.col("l_orderkey").alias("number"),
                     F.struct(*order, F.struct(name.alias("name")).alias("label"),
                              F.struct(login.alias("login")).alias("assignee")).alias("l"))
             .groupBy("number").agg(F.array_sort(F.collect_list("l")).alias("_l")))
    items = (fx.orders_issues(spark, sf).select("number").join(lines, "number", "left")
             .select("number", F.col("_l.label").alias("labels"), F.col("_l.assignee").alias("assignees")))
    return T.issue_tags(items)
