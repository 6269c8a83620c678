"""Issue-shaped views over the driver's tables (see FIXTURES.md, part B).

Each view exists twice: as a Spark builder (the input of the operators) and
as a DuckDB CTE (the input of the oracle SQL in ``__spark_entry__``). The two
must define the same rows; tests compare them.

Flat table model used by every operator (one row per entity):

* ``issues``     repo, pos, number, title, body, state, item_type, createdAt,
                 updatedAt, url, author, reactions_total, number_of_comments,
                 mergeable, merged, merged_at, base_ref, head_ref
* ``comments``   repo, number, idx, id, body, createdAt, updatedAt, author,
                 authorAssociation, reactions_total, reactionGroups
* ``reactions``  repo, number, content, count        (body reaction groups)
* ``xrefs``      repo, src, idx, dst, type, title, url, author
* ``recs``       repo, number, seq, recommendation, confidence, ...
* ``vectors``    repo, number, title, state, embedding
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPO_ORDERS = "fixture/orders"
REPO_CONV = "fixture/conversations"
REPO_DOCS = "fixture/documents"
REPO_VEC = "fixture/embeddings"
REPO_EVENTS = "fixture/events"

# Event types of the driver data mapped onto reaction names.
# "error" stays unmapped on purpose so unknown reaction names are exercised.
EVENT_REACTION = {
    "click": "THUMBS_UP",
    "view": "EYES",
    "signup": "HOORAY",
    "purchase": "HEART",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(c: str) -> Column:
    return F.col(c).cast("timestamp")


def _event_content() -> Column:
    expr = F.upper(F.col("event_type"))
    for ev, name in EVENT_REACTION.items():
        expr = F.when(F.col("event_type") == ev, F.lit(name)).otherwise(expr)
    return expr


_REACTION_GROUPS_T = "array<struct<content:string,count:bigint>>"


# ---------------------------------------------------------------- Spark views
def orders_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items_orders``: one issue per order."""
    o = table(spark, sf_dir, "orders")
    last = (table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.max("l_shipdate").alias("last_ship"), F.count(F.lit(1)).alias("n_lines")))
    j = o.join(last, o.o_orderkey == last.l_orderkey, "left")
    created = _ts("o_orderdate")
    is_pr = F.col("o_orderstatus") == "P"
    return j.select(
        F.lit(REPO_ORDERS).alias("repo"),
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderkey").alias("number"),
        F.col("o_orderpriority").alias("title"),
        F.lit(None).cast("string").alias("body"),
        F.when(F.col("o_orderstatus") == "F", "closed")
         .when(F.col("o_orderstatus") == "O", "open")
         .when(is_pr, "merged").alias("state"),
        F.when(is_pr, "pull_request").otherwise("issue").alias("item_type"),
        created.alias("createdAt"),
        F.greatest(created, F.coalesce(_ts("last_ship"), created)).alias("updatedAt"),
        F.concat(F.lit("https://x/"), F.when(is_pr, "pull").otherwise("issues"), F.lit("/"),
                 F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_custkey").cast("string").alias("author"),
        F.lit(None).cast("bigint").alias("reactions_total"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("bigint").alias("number_of_comments"),
        F.when(is_pr, F.lit("MERGEABLE")).alias("mergeable"),
        F.when(is_pr, F.lit(True)).alias("merged"),
        F.when(is_pr, F.greatest(created, F.coalesce(_ts("last_ship"), created))).alias("merged_at"),
        F.when(is_pr, F.lit("main")).alias("base_ref"),
        F.when(is_pr, F.concat(F.lit("branch-"), F.col("o_orderkey").cast("string"))).alias("head_ref"),
    )


def _placed_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Line items as ``number`` (their order), ``idx`` (place in it), the columns that
    order them and ``more``. They are dealt as they are, by the name that later steps
    group and join on, so that the texts made from them need not be dealt again."""
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), *order, *more)
    w = Window.partitionBy("number").orderBy(*order)
    return li.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))


def stored_lines(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """All that documents are made of lines, dealt once: placed and stored under the new
    folder ``path`` in buckets by ``number``."""
    from .sources.buckets import read_buckets, write_buckets

    lines = _placed_lines(spark, sf_dir, "l_quantity", "l_returnflag", "l_linestatus", "l_tax", "l_discount")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_buckets(spark, write_buckets(lines, path, ["number"], n, aligned=True))


def orders_comments(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """``comments_lines``: one comment per line item, ordered per order. ``lines`` are
    the placed lines, where they are stored."""
    li = _placed_lines(spark, sf_dir, "l_quantity") if lines is None else lines
    return li.select(
        F.lit(REPO_ORDERS).alias("repo"),
        F.col("number"),
        F.col("idx"),
        F.concat_ws("-", "number", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("body"),
        _ts("l_shipdate").alias("createdAt"),
        _ts("l_shipdate").alias("updatedAt"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("author"),
        F.lit("NONE").alias("authorAssociation"),
        F.col("l_quantity").cast("bigint").alias("reactions_total"),
        F.lit(None).cast(_REACTION_GROUPS_T).alias("reactionGroups"),
    )


def event_reactions(spark: SparkSession, sf_dir: str, repo: str = REPO_ORDERS) -> DataFrame:
    """``body_reactions``: reaction groups of issue bodies from the event log."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit(repo).alias("repo"), F.col("user_id").alias("number"),
                    _event_content().alias("content"), F.col("count").cast("bigint").alias("count")))


def orders_xrefs(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """``xrefs_lines``: a cross reference from each order to the issue numbered by its part."""
    li = _placed_lines(spark, sf_dir, "l_linestatus") if lines is None else lines
    return li.select(
        F.lit(REPO_ORDERS).alias("repo"),
        F.col("number").alias("src"),
        F.col("idx"),
        F.col("l_partkey").alias("dst"),
        F.when(F.col("l_linestatus") == "O", "issue").otherwise("pr").alias("type"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
        F.concat(F.lit("https://x/issues/"), F.col("l_partkey").cast("string")).alias("url"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("author"),
    )


def conv_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items_conv``: turn 0 is the body, its first line the title."""
    cv = table(spark, sf_dir, "conversations").where(F.col("turn") == 0)
    return cv.select(
        F.lit(REPO_CONV).alias("repo"),
        F.col("conv_id").alias("pos"),
        F.col("conv_id").alias("number"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body"),
        F.lit("open").alias("state"),
        F.lit("issue").alias("item_type"),
        F.col("role").alias("author"),
        F.lit(None).cast("bigint").alias("reactions_total"),
    )


def conv_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations").where(F.col("turn") > 0)
    return cv.select(
        F.lit(REPO_CONV).alias("repo"),
        F.col("conv_id").alias("number"),
        F.col("turn").alias("idx"),
        F.col("text").alias("body"),
        F.col("role").alias("author"),
        F.lit(None).cast("bigint").alias("reactions_total"),
        F.lit(None).cast(_REACTION_GROUPS_T).alias("reactionGroups"),
    )


def docs_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items_docs``: one issue per document."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit(REPO_DOCS).alias("repo"),
        F.col("doc_id").alias("pos"),
        F.col("doc_id").alias("number"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("body"),
        F.lit("open").alias("state"),
        F.lit("issue").alias("item_type"),
        F.col("source").alias("author"),
        F.lit(None).cast("bigint").alias("reactions_total"),
    )


def docs_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of issue g are the documents with ``doc_id div 10 = g``, by doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit(REPO_DOCS).alias("repo"),
        F.expr("doc_id div 10").alias("number"),
        F.col("doc_id").alias("idx"),
        F.col("text").alias("body"),
        F.col("lang").alias("author"),
        F.col("n_chars").alias("reactions_total"),
        F.lit(None).cast(_REACTION_GROUPS_T).alias("reactionGroups"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items_vec``: embedded issues."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.lit(REPO_VEC).alias("repo"),
        F.col("vec_id").alias("pos"),
        F.col("vec_id").alias("number"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("title"),
        F.when(F.col("label") % 2 == 0, "open").otherwise("closed").alias("state"),
        F.concat(F.lit("https://x/issues/"), F.col("vec_id").cast("string")).alias("url"),
        F.col("embedding"),
    )


def _levels() -> Column:
    return F.array(F.lit("low"), F.lit("medium"), F.lit("high"))


def label_recs(spark: SparkSession, sf_dir: str, repo: str = REPO_ORDERS) -> DataFrame:
    """``recs_labels``: review log rows; a second review for even doc ids."""
    lb = table(spark, sf_dir, "labels")
    seqs = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rec = (F.when(F.col("toxic") == 1, "close_invalid")
           .when(F.col("quality") == 1, "priority_high").otherwise("priority_low"))
    base = lb.select("doc_id", "quality", "toxic", F.explode(seqs).alias("seq"))
    cx = F.element_at(_levels(), (F.col("doc_id") % 3 + 1).cast("int"))
    rk = F.element_at(_levels(), (F.expr("doc_id div 3") % 3 + 1).cast("int"))
    # the second review swaps complexity and risk so "latest" is observable
    return base.select(
        F.lit(repo).alias("repo"),
        F.col("doc_id").alias("number"),
        F.col("seq").cast("bigint").alias("seq"),
        rec.alias("recommendation"),
        F.when(F.col("quality") == 1, "high").otherwise("medium").alias("confidence"),
        F.concat(F.lit("review of "), F.col("doc_id").cast("string")).alias("summary"),
        F.lit("rationale").alias("rationale"),
        F.lit("report").alias("report"),
        F.lit("medium").alias("severity"),
        F.lit("low").alias("frequency"),
        F.lit("low").alias("prevalence"),
        F.when(F.col("seq") == 1, cx).otherwise(rk).alias("solution_complexity"),
        F.when(F.col("seq") == 1, rk).otherwise(cx).alias("solution_risk"),
    )


def event_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``updates_events``: a stream of item versions (number = user, time = event)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.lit(REPO_EVENTS).alias("repo"),
        F.col("event_id").alias("pos"),
        F.col("user_id").alias("number"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title"),
        F.col("props").alias("body"),
        F.col("event_type").alias("state"),
        F.lit("issue").alias("item_type"),
        _ts("ts").alias("createdAt"),
        _ts("ts").alias("updatedAt"),
        F.concat(F.lit("https://x/issues/"), F.col("user_id").cast("string")).alias("url"),
        F.lit("ghost").alias("author"),
        F.col("value").alias("value"),
    )


def rec_inputs(spark: SparkSession, sf_dir: str, repo: str = REPO_ORDERS) -> DataFrame:
    """Review submissions (FIXTURES A6) derived from ``labels``; some break the rules:
    an unknown action, an unknown severity, a blank summary, an unknown issue."""
    lb = table(spark, sf_dir, "labels")
    lv = _levels()
    return lb.select(
        F.lit(repo).alias("repo"),
        F.col("doc_id").alias("input_pos"),
        F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") + 1000000).otherwise(F.col("doc_id"))
         .alias("issue_number"),
        F.when(F.col("toxic") == 1, "close_invalid").when(F.col("quality") == 1, "priority_high")
         .otherwise("triage").alias("recommendation"),
        F.element_at(lv, (F.col("doc_id") % 3 + 1).cast("int")).alias("confidence"),
        F.when(F.col("doc_id") % 7 == 0, "critical").otherwise("medium").alias("severity"),
        F.lit("low").alias("frequency"),
        F.lit("low").alias("prevalence"),
        F.element_at(lv, (F.expr("doc_id div 3") % 3 + 1).cast("int")).alias("solution_complexity"),
        F.element_at(lv, (F.col("doc_id") % 3 + 1).cast("int")).alias("solution_risk"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit(" \t "))
         .otherwise(F.concat(F.lit("  review "), F.col("doc_id").cast("string"), F.lit(" "))).alias("summary"),
        F.lit("because").alias("rationale"),
        F.lit("report").alias("report"),
        F.array(F.lit("core")).alias("affected_packages"),
        F.array().cast("array<string>").alias("affected_paths"),
        F.array().cast("array<string>").alias("affected_components"),
        F.array().cast("array<bigint>").alias("merge_with"),
        F.lit(None).cast("array<struct<number:bigint,title:string,url:string>>").alias("relevant_issues"),
    )


# ---------------------------------------------------------------- DuckDB views
SQL_VIEWS: dict[str, str] = {
    "li_last": """SELECT l_orderkey, max(l_shipdate) AS last_ship, count(*) AS n_lines
        FROM lineitem GROUP BY l_orderkey""",
    "issues": """SELECT o.o_orderkey AS pos, o.o_orderkey AS number, o.o_orderpriority AS title,
        CAST(NULL AS VARCHAR) AS body,
        CASE o.o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'merged' END AS state,
        CASE WHEN o.o_orderstatus = 'P' THEN 'pull_request' ELSE 'issue' END AS item_type,
        o.o_orderdate AS createdAt,
        greatest(o.o_orderdate, coalesce(li.last_ship, o.o_orderdate)) AS updatedAt,
        'https://x/' || CASE WHEN o.o_orderstatus = 'P' THEN 'pull' ELSE 'issues' END || '/'
            || CAST(o.o_orderkey AS VARCHAR) AS url,
        CAST(o.o_custkey AS VARCHAR) AS author,
        CAST(NULL AS BIGINT) AS reactions_total,
        CAST(coalesce(li.n_lines, 0) AS BIGINT) AS number_of_comments,
        CASE WHEN o.o_orderstatus = 'P' THEN 'MERGEABLE' END AS mergeable,
        CASE WHEN o.o_orderstatus = 'P' THEN TRUE END AS merged,
        CASE WHEN o.o_orderstatus = 'P' THEN greatest(o.o_orderdate, coalesce(li.last_ship, o.o_orderdate)) END AS merged_at,
        CASE WHEN o.o_orderstatus = 'P' THEN 'main' END AS base_ref,
        CASE WHEN o.o_orderstatus = 'P' THEN 'branch-' || CAST(o.o_orderkey AS VARCHAR) END AS head_ref
        FROM orders o LEFT JOIN li_last li ON o.o_orderkey = li.l_orderkey""",
    "comments": """SELECT l_orderkey AS number,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey,
            l_suppkey, l_extendedprice) - 1 AS BIGINT) AS idx,
        'part ' || CAST(l_partkey AS VARCHAR) AS body,
        l_shipdate AS createdAt,
        's' || CAST(l_suppkey AS VARCHAR) AS author,
        CAST(l_quantity AS BIGINT) AS reactions_total
        FROM lineitem""",
    "reactions": """SELECT user_id AS number,
        CASE event_type WHEN 'click' THEN 'THUMBS_UP' WHEN 'view' THEN 'EYES' WHEN 'signup' THEN 'HOORAY'
            WHEN 'purchase' THEN 'HEART' ELSE upper(event_type) END AS content,
        CAST(count(*) AS BIGINT) AS count
        FROM events GROUP BY user_id, event_type""",
    "xrefs": """SELECT l_orderkey AS src,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey,
            l_suppkey, l_extendedprice) - 1 AS BIGINT) AS idx,
        l_partkey AS dst,
        CASE WHEN l_linestatus = 'O' THEN 'issue' ELSE 'pr' END AS type,
        'part ' || CAST(l_partkey AS VARCHAR) AS title,
        'https://x/issues/' || CAST(l_partkey AS VARCHAR) AS url
        FROM lineitem""",
    "vectors": """SELECT vec_id AS pos, vec_id AS number, 'vector ' || CAST(vec_id AS VARCHAR) AS title,
        CASE WHEN label % 2 = 0 THEN 'open' ELSE 'closed' END AS state,
        'https://x/issues/' || CAST(vec_id AS VARCHAR) AS url, embedding
        FROM embeddings""",
    "recs": """SELECT doc_id AS number, CAST(s.seq AS BIGINT) AS seq,
        CASE WHEN toxic = 1 THEN 'close_invalid' WHEN quality = 1 THEN 'priority_high' ELSE 'priority_low' END
            AS recommendation,
        CASE WHEN quality = 1 THEN 'high' ELSE 'medium' END AS confidence,
        CASE WHEN s.seq = 1 THEN ['low','medium','high'][doc_id % 3 + 1]
             ELSE ['low','medium','high'][(doc_id // 3) % 3 + 1] END AS solution_complexity,
        CASE WHEN s.seq = 1 THEN ['low','medium','high'][(doc_id // 3) % 3 + 1]
             ELSE ['low','medium','high'][doc_id % 3 + 1] END AS solution_risk
        FROM labels, (SELECT unnest([1, 2]) AS seq) s
        WHERE s.seq = 1 OR doc_id % 2 = 0""",
    "updates": """SELECT event_id AS pos, user_id AS number, 'user ' || CAST(user_id AS VARCHAR) AS title,
        event_type AS state, ts AS createdAt, ts AS updatedAt, value
        FROM events""",
}



def _sql_quartile(m: str) -> str:
    e = f"q.{m}"
    return (f"CASE WHEN m.{m} IS NULL OR {e} IS NULL THEN NULL "
            f"WHEN len(list_distinct({e})) < 5 THEN 'Top25%' "
            f"WHEN m.{m} <= {e}[2] THEN 'Bottom25%' WHEN m.{m} <= {e}[3] THEN 'Bottom50%' "
            f"WHEN m.{m} <= {e}[4] THEN 'Top50%' ELSE 'Top25%' END AS {m}_quartile")


_METRICS = ["comment_count", "age_days", "engagements", "engagements_per_day", "body_emojis",
            "comment_emojis", "total_emojis"]

SQL_VIEWS.update({
    "cstats": """SELECT number, count(*) AS comment_count,
        sum(coalesce(reactions_total, 0)) AS comment_emojis FROM comments GROUP BY number""",
    "rstats": "SELECT number, sum(count) AS body_group_sum FROM reactions GROUP BY number",
    "metrics0": """SELECT i.*, CAST(coalesce(c.comment_count, 0) AS BIGINT) AS comment_count,
        CAST(coalesce(c.comment_emojis, 0) AS BIGINT) AS comment_emojis,
        CAST(CASE WHEN coalesce(r.body_group_sum, 0) = 0 THEN coalesce(i.reactions_total, 0)
             ELSE r.body_group_sum END AS BIGINT) AS body_emojis,
        CAST(floor((epoch_us(i.updatedAt) - epoch_us(i.createdAt)) / 86400000000.0) AS BIGINT) AS age_days
        FROM issues i LEFT JOIN cstats c ON i.number = c.number LEFT JOIN rstats r ON i.number = r.number""",
    "metrics1": """SELECT *, body_emojis + comment_emojis AS total_emojis,
        comment_count + body_emojis + comment_emojis AS engagements FROM metrics0""",
    "metrics": """SELECT *, CASE WHEN age_days > 0 THEN engagements / age_days ELSE 0.0 END
        AS engagements_per_day FROM metrics1""",
    "qedges": "SELECT " + ", ".join(
        f"quantile_cont({m}, [0.0, 0.25, 0.5, 0.75, 1.0]) AS {m}" for m in _METRICS) + " FROM metrics",
    "enriched": "SELECT m.*, " + ", ".join(_sql_quartile(m) for m in _METRICS)
        + ", CAST(NULL AS VARCHAR) AS summary FROM metrics m, qedges q",
})

SQL_VIEWS.update({
    "conv_issues": """SELECT conv_id AS pos, conv_id AS number, split_part(text, chr(10), 1) AS title,
        text AS body, role AS author, CAST(NULL AS BIGINT) AS reactions_total
        FROM conversations WHERE turn = 0""",
    "conv_comments": """SELECT conv_id AS number, turn AS idx, text AS body, role AS author,
        CAST(NULL AS BIGINT) AS reactions_total FROM conversations WHERE turn > 0""",
    "docs_issues": """SELECT doc_id AS pos, doc_id AS number, substring(text, 1, 60) AS title, text AS body,
        source AS author, CAST(NULL AS BIGINT) AS reactions_total FROM documents""",
    "docs_comments": """SELECT doc_id // 10 AS number, doc_id AS idx, text AS body, lang AS author,
        n_chars AS reactions_total FROM documents""",
    "rec_inputs": """SELECT doc_id AS input_pos,
        CASE WHEN doc_id % 11 = 0 THEN doc_id + 1000000 ELSE doc_id END AS issue_number,
        CASE WHEN toxic = 1 THEN 'close_invalid' WHEN quality = 1 THEN 'priority_high' ELSE 'triage' END
            AS recommendation,
        ['low','medium','high'][doc_id % 3 + 1] AS confidence,
        CASE WHEN doc_id % 7 = 0 THEN 'critical' ELSE 'medium' END AS severity,
        'low' AS frequency, 'low' AS prevalence,
        ['low','medium','high'][(doc_id // 3) % 3 + 1] AS solution_complexity,
        ['low','medium','high'][doc_id % 3 + 1] AS solution_risk,
        CASE WHEN quality = 0 AND toxic = 0 THEN ' ' || chr(9) || ' '
             ELSE '  review ' || CAST(doc_id AS VARCHAR) || ' ' END AS summary,
        'because' AS rationale, 'report' AS report
        FROM labels""",
})

SQL_VIEWS.update({
    "ivec": """SELECT e.*, v.embedding FROM enriched e LEFT JOIN vectors v ON e.number = v.number""",
    "xedges": """SELECT DISTINCT src, dst FROM xrefs WHERE type = 'issue' AND dst IS NOT NULL
        AND dst IN (SELECT number FROM issues)""",
})

SQL_VIEWS.update({
    "vdocs": """SELECT i.pos, i.number, i.url, i.merged, i.mergeable, coalesce(c.n, 0) AS actual,
        coalesce(c.claim, 0) AS claim, coalesce(c.n, 0) <> coalesce(c.claim, 0) AS mismatch,
        (i.url LIKE '%/pull/%' OR i.mergeable IS NOT NULL OR i.merged IS NOT NULL) AS is_pr
        FROM issues i LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS claim
            FROM lineitem GROUP BY l_orderkey) c ON i.number = c.l_orderkey""",
    "vmsgs": """SELECT pos, number, list_filter([
        CASE WHEN mismatch THEN {'category': 'comments', 'message': 'comment count mismatch: number_of_comments='
            || CAST(claim AS VARCHAR) || ', actual=' || CAST(actual AS VARCHAR)} END,
        CASE WHEN is_pr THEN {'category': 'pull_request', 'message': 'PR missing ''baseRefName'' field'} END,
        CASE WHEN is_pr THEN {'category': 'pull_request', 'message': 'PR missing ''headRefName'' field'} END,
        CASE WHEN is_pr AND coalesce(merged, false) THEN {'category': 'pull_request',
            'message': 'PR is merged but missing ''mergedAt'' field'} END], lambda x: x IS NOT NULL) AS messages
        FROM vdocs""",
})

# view -> views it reads
SQL_DEPS = {
    "issues": ["li_last"],
    "cstats": ["comments"],
    "rstats": ["reactions"],
    "metrics0": ["issues", "cstats", "rstats"],
    "metrics1": ["metrics0"],
    "metrics": ["metrics1"],
    "qedges": ["metrics"],
    "enriched": ["metrics", "qedges"],
    "ivec": ["enriched", "vectors"],
    "xedges": ["xrefs", "issues"],
    "vdocs": ["issues", "li_last"],
    "vmsgs": ["vdocs"],
}


def sql_with(*names: str) -> str:
    """A ``WITH`` clause defining the named views (and what they read)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in SQL_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order)
