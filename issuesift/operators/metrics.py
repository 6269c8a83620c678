"""Engagement metrics (A7-A11) and quartile labels.

Per-issue metrics come from the flat ``comments`` and ``reactions`` tables
through partially aggregated ``groupBy`` (map-side combine), so an issue with
millions of comments costs one hash-aggregate entry per task, never one huge
row or one hot task. Quartile edges are one global aggregate evaluated as a
scalar subquery; the labels are then a narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantile_edges
from ..functions.text import counted_groups

# The seven metrics that get a quartile label, and the labels.
METRICS = [
    "comment_count",
    "age_days",
    "engagements",
    "engagements_per_day",
    "body_emojis",
    "comment_emojis",
    "total_emojis",
]
QUARTILE_LABELS = ["Bottom25%", "Bottom50%", "Top50%", "Top25%"]
QUARTILE_PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]

KEY = ["repo", "number"]
_DAY_MICROS = 86_400_000_000


def reaction_sum(groups: Column) -> Column:
    """Sum of ``count`` over an array of reaction groups (0 for null/empty)."""
    return F.coalesce(
        F.aggregate(groups, F.lit(0).cast("bigint"),
                    lambda acc, g: acc + F.coalesce(g["count"], F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"))


def with_fallback(group_sum: Column, total: Column) -> Column:
    """Group sum, or the plain reaction total when the groups sum to 0."""
    return F.when(group_sum == 0, F.coalesce(total, F.lit(0).cast("bigint"))).otherwise(group_sum)


def comment_emoji(comments: DataFrame) -> Column:
    groups = (reaction_sum(counted_groups(comments, "reactionGroups")) if "reactionGroups" in comments.columns
              else F.lit(0).cast("bigint"))
    return with_fallback(groups, F.col("reactions_total"))


def comment_stats(comments: DataFrame) -> DataFrame:
    """comment_count and comment_emojis per issue (partial aggregation)."""
    return comments.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("comment_count"),
        F.sum(comment_emoji(comments)).alias("comment_emojis"))


def body_reaction_stats(reactions: DataFrame) -> DataFrame:
    return reactions.groupBy(*KEY).agg(F.sum("count").alias("body_group_sum"))


def age_days(created: Column, updated: Column) -> Column:
    """Whole days between two instants, floored (negative spans floor down)."""
    span = F.unix_micros(updated.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    return F.floor(span / F.lit(_DAY_MICROS)).cast("bigint")


def engagements_per_day(eng: Column, age: Column) -> Column:
    return F.when(age > 0, eng / age).otherwise(F.lit(0.0))


def add_metrics(issues: DataFrame, comments: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """Append comment_count, body/comment/total emojis, age_days, engagements(/day)."""
    out = issues.join(comment_stats(comments), KEY, "left")
    if reactions is not None:
        out = out.join(body_reaction_stats(reactions), KEY, "left")
        body_sum = F.coalesce(F.col("body_group_sum"), F.lit(0).cast("bigint"))
    elif "reactionGroups" in issues.columns:
        body_sum = reaction_sum(counted_groups(issues, "reactionGroups"))
    else:
        body_sum = F.lit(0).cast("bigint")
    total = F.col("reactions_total") if "reactions_total" in issues.columns else F.lit(None)
    out = (out
           .withColumn("comment_count", F.coalesce(F.col("comment_count"), F.lit(0).cast("bigint")))
           .withColumn("comment_emojis", F.coalesce(F.col("comment_emojis"), F.lit(0).cast("bigint")))
           .withColumn("body_emojis", with_fallback(body_sum, total))
           .withColumn("total_emojis", F.col("body_emojis") + F.col("comment_emojis"))
           .withColumn("age_days", age_days(F.col("createdAt"), F.col("updatedAt"))
                       if {"createdAt", "updatedAt"} <= set(issues.columns) else F.lit(None).cast("bigint"))
           .withColumn("engagements", F.col("comment_count") + F.col("total_emojis"))
           .withColumn("engagements_per_day",
                       engagements_per_day(F.col("engagements"), F.col("age_days"))))
    if reactions is not None:
        out = out.drop("body_group_sum")
    return out


def quartile_label(value: Column, edges: Column) -> Column:
    """Label a value against five edges; tied edges label every row Top25%."""
    return (F.when(value.isNull() | edges.isNull(), F.lit(None).cast("string"))
            .when(F.size(F.array_distinct(edges)) < 5, QUARTILE_LABELS[3])
            .when(value <= F.element_at(edges, 2), QUARTILE_LABELS[0])
            .when(value <= F.element_at(edges, 3), QUARTILE_LABELS[1])
            .when(value <= F.element_at(edges, 4), QUARTILE_LABELS[2])
            .otherwise(QUARTILE_LABELS[3]))


def add_quartiles(df: DataFrame, metrics: list[str] | None = None, method: str = "exact",
                  with_rank: bool = False) -> DataFrame:
    """Append ``<metric>_quartile`` for each metric present in ``df``.

    ``method='exact'`` reproduces linear-interpolated quantiles exactly with a
    distributed two-pass search (see ``functions.quantiles``);
    ``method='approx'`` uses ``percentile_approx`` only.
    """
    metrics = [m for m in (metrics or METRICS) if m in df.columns]
    if not metrics:
        return df
    edges = quantile_edges(df, metrics, QUARTILE_PROBS, method=method)
    out = df
    for m in metrics:
        out = out.withColumn(f"{m}_quartile", quartile_label(F.col(m), edges[m]))
        if with_rank:
            out = out.withColumn(
                f"{m}_quartile_rank",
                F.array_position(F.array(*[F.lit(x) for x in QUARTILE_LABELS]),
                                 F.col(f"{m}_quartile")))
    return out
