"""Review log (recommendations): input checks, append, ordinals.

The reference stores reviews as a list inside each issue document; here they
are an append-only table keyed by ``(repo, number, seq)``. "Latest" is the
greatest ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, py_strip
from .windows import running_sum

KEY = ["repo", "number"]

# Allowed recommendation actions and levels.
RECOMMENDATIONS = [
    "close_completed", "close_merge", "close_not_planned", "close_invalid",
    "priority_high", "priority_medium", "priority_low", "needs_more_info",
]
LEVELS = ["low", "medium", "high"]
LEVEL_FIELDS = ["confidence", "severity", "frequency", "prevalence", "solution_complexity",
                "solution_risk"]
TEXT_FIELDS = ["summary", "rationale", "report"]
STRING_LIST_FIELDS = ["affected_packages", "affected_paths", "affected_components"]
# Ordinal words used in the append message.
ORDINALS = {1: "first", 2: "second", 3: "third", 4: "fourth", 5: "fifth"}

RECS_SCHEMA = (
    "repo string, number bigint, seq bigint, recommendation string, confidence string, "
    "summary string, rationale string, report string, severity string, frequency string, "
    "prevalence string, solution_complexity string, solution_risk string, "
    "affected_packages array<string>, affected_paths array<string>, "
    "affected_components array<string>, merge_with array<bigint>, "
    "relevant_issues array<struct<number:bigint,title:string,url:string>>, "
    "reviewer string, model_version string, review_timestamp timestamp, review_id string")


def _one_of(field: str, allowed: list[str]) -> Column:
    msg = f"{field} must be one of: {', '.join(sorted(allowed))}"
    c = F.col(field)
    return F.when(c.isNull() | ~c.isin(allowed), F.lit(msg))


def recommendation_errors(inputs: DataFrame) -> Column:
    """List of error messages for one input row (empty when valid)."""
    checks: list[Column] = [_one_of("recommendation", RECOMMENDATIONS)]
    checks += [_one_of(f, LEVELS) for f in LEVEL_FIELDS]
    checks += [F.when(is_blank(F.col(f)), F.lit(f"{f} must be a non-empty string")) for f in TEXT_FIELDS]
    checks.append(F.when(F.col("issue_number").isNull(), F.lit("issue_number must be an integer")))
    for f in STRING_LIST_FIELDS:
        c = F.col(f)
        checks.append(F.when(c.isNull(), F.lit(f"{f} must be a list"))
                      .when(~F.forall(c, lambda x: x.isNotNull()), F.lit(f"{f} must be a list of strings")))
    mw = F.col("merge_with")
    checks.append(F.when(mw.isNull(), F.lit("merge_with must be a list"))
                  .when(~F.forall(mw, lambda x: x.isNotNull()), F.lit("merge_with must be a list of integers")))
    if "relevant_issues" in inputs.columns:
        ri = F.col("relevant_issues")
        ok = F.forall(ri, lambda x: x.isNotNull() & x["number"].isNotNull() & x["title"].isNotNull()
                      & x["url"].isNotNull())
        checks.append(F.when(ri.isNotNull() & ~ok, F.lit(
            "relevant_issues must be a list of dictionaries with keys: number, title, url")))
    return F.array_compact(F.array(*checks))


def validate_recommendations(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("errors", recommendation_errors(inputs))


def ordinal(n: Column) -> Column:
    """W5 text: first..fifth, then ``<n>th``."""
    e = F.concat(n.cast("string"), F.lit("th"))
    for k in sorted(ORDINALS, reverse=True):
        e = F.when(n == k, F.lit(ORDINALS[k])).otherwise(e)
    return e


def with_ordinal(recs: DataFrame, dense_seq: bool = True) -> DataFrame:
    """Position of each review in its issue's log and its ordinal word.

    ``append_recommendations`` numbers reviews 1, 2, 3, ... per issue, so the
    position is ``seq`` itself: a narrow projection with no per-issue window
    (an issue with a huge review log is no hot task). ``dense_seq=False``
    ranks by ``seq`` with a window for logs numbered some other way."""
    if dense_seq:
        pos = F.col("seq").cast("int")
    else:
        pos = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))
    return recs.withColumn("position", pos).withColumn("ordinal", ordinal(F.col("position")))


def append_recommendations(issues: DataFrame, recs: DataFrame, inputs: DataFrame,
                           order_col: str = "input_pos") -> tuple[DataFrame, DataFrame]:
    """Check ``inputs`` and return ``(accepted, rejected)``.

    ``inputs`` carries ``repo, issue_number`` and the recommendation fields
    (FIXTURES A6) plus an ordering column. Accepted rows get trimmed text,
    ``relevant_issues`` defaulting to ``[]``, reviewer ``ai`` by default, a
    timestamp, a uuid and ``seq`` = prior reviews + position in the batch.
    Writing them is ``accepted.write.mode('append')``.
    """
    checked = validate_recommendations(inputs)
    known = issues.select("repo", F.col("number").alias("issue_number")).distinct()
    found = checked.join(known.withColumn("_found", F.lit(True)), ["repo", "issue_number"], "left")
    errors = F.when(F.size("errors") > 0, F.col("errors")).when(
        F.col("_found").isNull(),
        F.array(F.concat(F.lit("Issue #"), F.col("issue_number").cast("string"), F.lit(" not found"))))
    found = found.withColumn("errors", errors).drop("_found")
    rejected = found.where(F.col("errors").isNotNull())
    ok = found.where(F.col("errors").isNull()).drop("errors")

    # prior review counts only for the issues in this batch (the log can be large)
    batch_keys = ok.select("repo", F.col("issue_number").alias("number")).distinct()
    prior = (recs.join(batch_keys, KEY, "left_semi").groupBy(*KEY)
             .agg(F.count(F.lit(1)).alias("_prior")))
    # position inside the batch per issue: a running count, split by range so
    # a batch aimed mostly at one issue is not one task
    ok = running_sum(ok.withColumn("_one", F.lit(1).cast("bigint")), ["repo", "issue_number"], order_col,
                     "_one", "_k").drop("_one")
    ok = ok.join(prior.withColumnRenamed("number", "issue_number"), ["repo", "issue_number"], "left")
    ri_t = "array<struct<number:bigint,title:string,url:string>>"
    rel = (F.coalesce(F.col("relevant_issues").cast(ri_t), F.array().cast(ri_t))
           if "relevant_issues" in ok.columns else F.array().cast(ri_t))
    reviewer = F.coalesce(F.col("reviewer"), F.lit("ai")) if "reviewer" in ok.columns else F.lit("ai")
    model_v = F.col("model_version") if "model_version" in ok.columns else F.lit(None).cast("string")
    accepted = ok.select(
        "repo", F.col("issue_number").alias("number"),
        (F.coalesce(F.col("_prior"), F.lit(0)) + F.col("_k")).cast("bigint").alias("seq"),
        "recommendation", "confidence",
        *[py_strip(F.col(f)).alias(f) for f in TEXT_FIELDS],
        "severity", "frequency", "prevalence", "solution_complexity", "solution_risk",
        *STRING_LIST_FIELDS, F.col("merge_with").cast("array<bigint>").alias("merge_with"),
        rel.alias("relevant_issues"), reviewer.alias("reviewer"), model_v.alias("model_version"),
        F.current_timestamp().alias("review_timestamp"), F.expr("uuid()").alias("review_id"))
    return accepted, rejected
