"""Assemble nested issue documents from flat items, comments and references.

The analytic operators never need this form (they work on the flat tables);
it exists for document export and document-level validation. Children are
pre-aggregated per issue with ``collect_list`` (one shuffle per child table,
partial aggregation not possible for lists) and left-joined to the items.
An item is dropped when its comment or timeline fetch failed, as in the
reference, so a partial issue is never written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["repo", "number"]

COMMENT_T = ("struct<id:string,body:string,createdAt:timestamp,updatedAt:timestamp,"
             "author:struct<login:string>,authorAssociation:string,reactions:struct<totalCount:bigint>>")
XREF_T = "struct<number:bigint,type:string,title:string,url:string,author:string>"


def _nested_comments(comments: DataFrame) -> DataFrame:
    def col(c, default=None):
        return F.col(c) if c in comments.columns else F.lit(default)

    s = F.struct(
        F.col("idx").alias("_i"),
        col("id").cast("string").alias("id"),
        col("body").cast("string").alias("body"),
        col("createdAt").cast("timestamp").alias("createdAt"),
        col("updatedAt").cast("timestamp").alias("updatedAt"),
        F.struct(col("author").cast("string").alias("login")).alias("author"),
        F.coalesce(col("authorAssociation").cast("string"), F.lit("NONE")).alias("authorAssociation"),
        F.struct(F.coalesce(col("reactions_total").cast("bigint"), F.lit(0).cast("bigint")).alias("totalCount"))
        .alias("reactions"))
    return (comments.groupBy(*KEY).agg(F.array_sort(F.collect_list(s)).alias("_c"))
            .select(*KEY, F.transform("_c", lambda x: x.dropFields("_i")).alias("comments")))


def _nested_xrefs(xrefs: DataFrame) -> DataFrame:
    s = F.struct(F.col("idx").alias("_i"), F.col("dst").cast("bigint").alias("number"), "type", "title", "url",
                 F.col("author").cast("string").alias("author"))
    return (xrefs.groupBy("repo", F.col("src").alias("number")).agg(F.array_sort(F.collect_list(s)).alias("_x"))
            .select(*KEY, F.transform("_x", lambda x: x.dropFields("_i")).alias("cross_references")))


def assemble_issues(items: DataFrame, comments: DataFrame, xrefs: DataFrame,
                    fetch_status: DataFrame | None = None) -> DataFrame:
    """Nested issues: ``author{login}``, ``labels``, ``assignees``, ``comments``,
    ``number_of_comments = size(comments)``, ``cross_references``.

    ``fetch_status(repo, number, comments_ok, timeline_ok)`` marks failed child
    fetches; items whose flags are not both true are dropped.
    """
    it = items
    if fetch_status is not None:
        ok = fetch_status.where(F.col("comments_ok") & F.col("timeline_ok")).select(*KEY)
        it = it.join(ok, KEY, "left_semi")
    ct = f"array<{COMMENT_T}>"
    xt = f"array<{XREF_T}>"
    j = it.join(_nested_comments(comments), KEY, "left").join(_nested_xrefs(xrefs), KEY, "left")
    labels_t = "array<struct<name:string,color:string>>"
    assignees_t = "array<struct<login:string>>"
    extra = [c for c in ("mergeable", "merged", "merged_at", "base_ref", "head_ref", "item_type",
                         "pulled_date") if c in items.columns]
    return j.select(
        *KEY, *[c for c in ("pos", "page") if c in items.columns],
        "title", "body", "state", "createdAt", "updatedAt", "url",
        F.struct(F.coalesce(F.col("author"), F.lit("ghost")).alias("login")).alias("author"),
        (F.col("labels") if "labels" in items.columns else F.array().cast(labels_t)).alias("labels"),
        (F.col("assignees") if "assignees" in items.columns else F.array().cast(assignees_t)).alias("assignees"),
        F.coalesce(F.col("comments"), F.array().cast(ct)).alias("comments"),
        F.size(F.coalesce(F.col("comments"), F.array().cast(ct))).cast("bigint").alias("number_of_comments"),
        (F.col("reactionGroups") if "reactionGroups" in items.columns
         else F.array().cast("array<struct<content:string,users:struct<totalCount:bigint>>>")).alias("reactionGroups"),
        F.coalesce(F.col("cross_references"), F.array().cast(xt)).alias("cross_references"),
        *extra)
