"""Catalog: text functions, conversation and embedding text, weekly buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..fixtures import sql_with
from ..functions import text as X
from ..operators import conversation as C
from ..operators.windows import weekly_counts
from .registry import SQL_WS, register, sql_blank, sql_strip, sql_trunc, sql_ts, ts_str

_EMOJI_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EMOJI) + " ELSE {c} END"
_EMOJI_ORD_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, (k, _v) in enumerate(X.EMOJI)) \
    + f" ELSE {len(X.EMOJI) + 1} END"
_NN = "chr(10) || chr(10)"


def _sql_sanitize(x: str, limit: int = X.SANITIZE_LIMIT) -> str:
    s = f"regexp_replace({x}, '[\\x00\\x{{feff}}]', '', 'g')"
    s = f"regexp_replace({s}, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')"
    s = f"regexp_replace({s}, '{SQL_WS}+', ' ', 'g')"
    s = f"regexp_replace({s}, '^ | $', '', 'g')"
    return sql_trunc(s, limit, "...")


def _sql_conversation(iv: str, cv: str) -> str:
    t = sql_trunc("body", X.CONV_COMMENT_LIMIT)
    lim = X.CONV_COMMENTS_LIMIT
    return f""",
cc1 AS (SELECT number, idx, {t} AS t, author, reactions_total FROM {cv} WHERE NOT {sql_blank('body')}),
cc2 AS (SELECT *, sum(length(t)) OVER (PARTITION BY number ORDER BY idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM cc1),
cc3 AS (SELECT number, string_agg(CASE WHEN run <= {lim} THEN coalesce(author, 'unknown') || ': ' || {sql_strip('t')}
          || CASE WHEN coalesce(reactions_total, 0) > 0 THEN ' [👍 ' || CAST(reactions_total AS VARCHAR) || ']'
             ELSE '' END END, {_NN} ORDER BY idx) AS parts,
        bool_or(run > {lim}) AS cut FROM cc2 WHERE run - length(t) <= {lim} GROUP BY number)
SELECT i.number, concat_ws({_NN},
   NULLIF({sql_strip("coalesce(i.title, '')")}, ''),
   CASE WHEN NOT {sql_blank('i.body')} THEN coalesce(i.author, 'unknown') || ': '
        || {sql_strip(sql_trunc('i.body', X.CONV_BODY_LIMIT))} END,
   NULLIF(c.parts, ''),
   CASE WHEN c.cut THEN '{X.CONV_CUT_MARKER}' END) AS conversation
FROM {iv} i LEFT JOIN cc3 c ON i.number = c.number"""


def _sql_embed_text(iv: str, cv: str) -> str:
    lim = X.EMBED_COMMENTS_LIMIT
    joined = (f"CASE WHEN c.cut THEN CASE WHEN c.nk > 0 THEN c.parts || chr(10) || '{X.EMBED_CUT_MARKER}' "
              f"ELSE '{X.EMBED_CUT_MARKER}' END ELSE coalesce(c.parts, '') END")
    content = (f"coalesce(i.title, '') || chr(10) || {sql_trunc(chr(99) + 'oalesce(i.body, ' + chr(39) * 2 + ')', X.EMBED_BODY_LIMIT)}"
               f" || chr(10) || {joined}")
    return f""",
ec1 AS (SELECT number, idx, coalesce(body, '') AS b FROM {cv}),
ec2 AS (SELECT *, sum(length(b)) OVER (PARTITION BY number ORDER BY idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ec1),
ec3 AS (SELECT number, string_agg(CASE WHEN run <= {lim} THEN b END, chr(10) ORDER BY idx) AS parts,
        count(CASE WHEN run <= {lim} THEN 1 END) AS nk, bool_or(run > {lim}) AS cut
        FROM ec2 WHERE run - length(b) <= {lim} GROUP BY number)
SELECT i.number, NULLIF({sql_strip(content)}, '') AS embed_text
FROM {iv} i LEFT JOIN ec3 c ON i.number = c.number"""


# ------------------------------------------------------------------ F1, F2, F6, F7, F10, F12
@register("sanitize", sql_with("docs_issues") + f"""
SELECT number, {_sql_sanitize('body')} AS sanitized FROM docs_issues""")
def q_sanitize(spark, sf):
    return fx.docs_issues(spark, sf).select("number", X.sanitize("body").alias("sanitized"))


@register("truncate", sql_with("docs_issues") + f"""
SELECT number, {sql_trunc('body', X.EMBED_BODY_LIMIT)} AS body_15k, {sql_trunc('body', X.CONV_BODY_LIMIT)} AS body_20k,
       {sql_trunc('body', X.CONV_COMMENT_LIMIT)} AS body_5k FROM docs_issues""")
def q_truncate(spark, sf):
    d = fx.docs_issues(spark, sf)
    return d.select("number", X.truncate("body", X.EMBED_BODY_LIMIT).alias("body_15k"),
                    X.truncate("body", X.CONV_BODY_LIMIT).alias("body_20k"),
                    X.truncate("body", X.CONV_COMMENT_LIMIT).alias("body_5k"))


@register("cache_key", sql_with("docs_issues") + """
SELECT number, 'embed-model:' || sha256(body) AS cache_key FROM docs_issues""")
def q_cache_key(spark, sf):
    return fx.docs_issues(spark, sf).select("number", X.cache_key("body", "embed-model").alias("cache_key"))


@register("title_fallback", sql_with("docs_issues") + f"""
SELECT number, CASE WHEN length({_sql_sanitize('body')}) > {X.FALLBACK_MIN_LEN}
  AND length({_sql_sanitize("split_part(body, chr(10), 1)")}) > 0
  AND length({_sql_sanitize("split_part(body, chr(10), 1)")}) < {X.FALLBACK_TITLE_MAX}
  THEN {_sql_sanitize("split_part(body, chr(10), 1)")} END AS title_fallback FROM docs_issues""")
def q_title_fallback(spark, sf):
    return fx.docs_issues(spark, sf).select("number", X.title_fallback("body").alias("title_fallback"))


@register("short_title", """
SELECT conv_id AS number, CASE WHEN length(text) > 50 THEN substring(text, 1, 47) || '...' ELSE text END
  AS short_title FROM conversations""")
def q_short_title(spark, sf):
    cv = fx.table(spark, sf, "conversations")
    return cv.select(F.col("conv_id").alias("number"), X.short_title("text").alias("short_title"))


@register("issue_refs", """
SELECT page_id, array_to_string(regexp_extract_all(html, '(^|[^\\w/])#(\\d+)', 2), ',') AS refs FROM pages""")
def q_issue_refs(spark, sf):
    pg = fx.table(spark, sf, "pages")
    return pg.select("page_id", F.array_join(F.transform(X.issue_refs("html"), lambda x: x.cast("string")), ",")
                     .alias("refs"))


# ------------------------------------------------------------------ F3
@register("emoji_text", sql_with("reactions") + f"""
SELECT number, CASE WHEN count(*) FILTER (WHERE count > 0) > 0 THEN ' [' || string_agg(
  CASE WHEN count > 0 THEN {_EMOJI_SQL.format(c='content')} || ' ' || CAST(count AS VARCHAR) END, ', '
  ORDER BY {_EMOJI_ORD_SQL.format(c='content')}, content) || ']' ELSE '' END AS emoji_text
FROM reactions GROUP BY number""")
def q_emoji_text(spark, sf):
    g = C.body_reaction_groups(fx.event_reactions(spark, sf))
    return g.select("number", X.emoji_text("reactionGroups").alias("emoji_text"))


# ------------------------------------------------------------------ F4 + W2, F5 + W3
@register("conversation", sql_with("conv_issues", "conv_comments") + _sql_conversation("conv_issues", "conv_comments"))
def q_conversation(spark, sf):
    out = C.conversation(fx.conv_issues(spark, sf), fx.conv_comments(spark, sf))
    return out.select("number", "conversation")


@register("conversation_docs", sql_with("docs_issues", "docs_comments")
          + _sql_conversation("docs_issues", "docs_comments"))
def q_conversation_docs(spark, sf):
    out = C.conversation(fx.docs_issues(spark, sf), fx.docs_comments(spark, sf))
    return out.select("number", "conversation")


@register("embed_text", sql_with("conv_issues", "conv_comments") + _sql_embed_text("conv_issues", "conv_comments"))
def q_embed_text(spark, sf):
    out = C.embedding_text(fx.conv_issues(spark, sf), fx.conv_comments(spark, sf))
    return out.select("number", "embed_text")


@register("embed_text_docs", sql_with("docs_issues", "docs_comments")
          + _sql_embed_text("docs_issues", "docs_comments"))
def q_embed_text_docs(spark, sf):
    out = C.embedding_text(fx.docs_issues(spark, sf), fx.docs_comments(spark, sf))
    return out.select("number", "embed_text")


# ------------------------------------------------------------------ F13 / X3
@register("weekly_buckets", sql_with("updates") + f"""
SELECT {sql_ts("time_bucket(INTERVAL 7 DAY, updatedAt, TIMESTAMP '2024-01-01')")} AS week_start,
       CAST(count(*) AS BIGINT) AS events FROM updates GROUP BY 1""")
def q_weekly_buckets(spark, sf):
    w = weekly_counts(fx.event_updates(spark, sf), "updatedAt")
    return w.select(ts_str("week_start").alias("week_start"), "events")
