"""Catalog: enrichment metrics, quartiles and top-n (the flagship slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import sql_with
from ..operators import metrics as M
from ..operators import tools as T
from . import enrich as E
from .registry import register

_METRIC_COLS = ["number", "comment_count", "body_emojis", "comment_emojis", "total_emojis",
                "age_days", "engagements"]


@register("metrics", sql_with("metrics") + """
SELECT number, comment_count, body_emojis, comment_emojis, total_emojis, age_days, engagements,
       round(engagements_per_day, 6) AS engagements_per_day FROM metrics""")
def q_metrics(spark, sf):
    return E.orders_metrics(spark, sf).select(
        *_METRIC_COLS, F.round("engagements_per_day", 6).alias("engagements_per_day"))


@register("quartiles", sql_with("enriched") + """
SELECT number, """ + ", ".join(f"{m}_quartile" for m in M.METRICS) + " FROM enriched")
def q_quartiles(spark, sf):
    # the quartile operator itself: computed here, not read from a stored table
    return E.orders_enriched(spark, sf, reuse=False).select("number", *[f"{m}_quartile" for m in M.METRICS])


@register("top_issues", sql_with("enriched") + """
SELECT number, title, summary, url FROM enriched WHERE total_emojis IS NOT NULL
ORDER BY total_emojis DESC, pos ASC LIMIT 10""")
def q_top_issues(spark, sf):
    return T.top_issues(E.orders_enriched(spark, sf), "total_emojis", 10, descending=True)


@register("top_issues_asc", sql_with("enriched") + """
SELECT number, title, summary, url FROM enriched WHERE age_days_quartile IS NOT NULL
ORDER BY age_days_quartile ASC, pos ASC LIMIT 25""")
def q_top_issues_asc(spark, sf):
    return T.top_issues(E.orders_enriched(spark, sf), "age_days_quartile", 25, descending=False)


@register("issue_metrics", sql_with("enriched") + """
SELECT number, """ + ", ".join(f"{m}, {m}_quartile" for m in M.METRICS if m != "engagements_per_day")
          + """, round(engagements_per_day, 6) AS engagements_per_day, engagements_per_day_quartile
FROM enriched WHERE number = 7""")
def q_issue_metrics(spark, sf):
    df = T.issue_metrics(E.orders_enriched(spark, sf), 7)
    return df.withColumn("engagements_per_day", F.round("engagements_per_day", 6))
