"""Query tools over the issue table: lookups, filters, top-n, profiles.

Every operator is a lazy DataFrame transformation; "first" always means the
smallest storage position ``pos``. Top-n uses ``orderBy(..).limit(n)`` so the
plan is a ``TakeOrderedAndProject`` (per-partition top-n, then a merge of n
rows per partition) instead of a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import (difficulty, issue_type, norm_state, state_is, status_predicate,
                                    strict_status_predicate)
from .metrics import METRICS

KEY = ["repo", "number"]

_ORDERABLE = (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType,
              T.FloatType, T.DecimalType, T.BooleanType, T.TimestampType, T.TimestampNTZType,
              T.DateType)


def _check_limit(limit: int) -> None:
    if limit is None or limit < 0:
        raise ValueError("limit must be a non-negative integer")


def require_column(df: DataFrame, column: str) -> None:
    """P5: raise with the sorted column list when ``column`` is absent."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} in this table; it has {sorted(df.columns)}")


def status_filter(df: DataFrame, status: str | None) -> DataFrame:
    """P2."""
    return df.where(status_predicate(status))


def with_issue_type(df: DataFrame) -> DataFrame:
    """Adds ``issue_type`` (pr / issue)."""
    pr = F.col("pull_request") if "pull_request" in df.columns else None
    return df.withColumn("issue_type", issue_type("url", pr))


def list_filter(df: DataFrame, status: str = "all", type_: str = "all") -> DataFrame:
    """Status all/open/closed/merged x type all/issues/prs.

    ``merged`` = a pull request that is merged: state ``merged`` (GraphQL) or
    state ``closed`` with ``merged`` true (REST).
    """
    pr = F.col("pull_request") if "pull_request" in df.columns else None
    t = issue_type("url", pr)
    cond = F.lit(True)
    if status == "merged":
        merged = F.coalesce(F.col("merged"), F.lit(False)) if "merged" in df.columns else F.lit(False)
        cond = (t == "pr") & (state_is("merged") | (state_is("closed") & merged))
    elif status in ("open", "closed"):
        cond = state_is(status)
    elif status != "all":
        raise ValueError("status must be one of all, open, closed, merged")
    if type_ == "issues":
        cond = cond & (t == "issue")
    elif type_ == "prs":
        cond = cond & (t == "pr")
    elif type_ != "all":
        raise ValueError("type must be one of all, issues, prs")
    return df.where(cond)


def first_by_pos(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("pos").asc()).limit(1)


def get_issue(df: DataFrame, number: int, status: str | None = None,
              recs: DataFrame | None = None) -> DataFrame:
    """The first row with ``number``, if it passes the status check; with ``recs`` its
    whole reviews in order of ``seq`` (those of one issue), an empty list if none."""
    cols = [c for c in ("repo", "pos", "number", "summary", "conversation", "state") if c in df.columns]
    hit = first_by_pos(df.where(F.col("number") == F.lit(number)).select(*cols))
    hit = hit.where(status_predicate(status))
    if recs is not None:
        fields = ["seq", *[c for c in recs.columns if c not in (*KEY, "seq")]]
        agg = (recs.where(F.col("number") == F.lit(number)).groupBy(*KEY)
               .agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(a["seq"] < b["seq"], -1)
                                 .when(a["seq"] > b["seq"], 1).otherwise(0)).alias("recommendations")))
        whole = agg.schema["recommendations"].dataType
        hit = hit.join(agg, KEY, "left").withColumn(
            "recommendations", F.coalesce(F.col("recommendations"), F.array().cast(whole)))
    return hit


def pull_filter(df: DataFrame, include_closed: bool = True, item_types: str = "both") -> DataFrame:
    """The pull options as filters."""
    cond = F.lit(True)
    if not include_closed:
        cond = state_is("open")
    if item_types == "issues":
        cond = cond & (F.col("item_type") == "issue")
    elif item_types == "prs":
        cond = cond & (F.col("item_type") == "pull_request")
    elif item_types != "both":
        raise ValueError("item_types must be issues, prs or both")
    return df.where(cond)


def since_filter(df: DataFrame, start: str | None = None, limit: int | None = None) -> DataFrame:
    """Items updated at or after ``start``; optionally the first ``limit`` by update time."""
    out = df
    if start is not None:
        out = out.where(F.col("updatedAt") >= F.to_timestamp(F.lit(start)))
    if limit is not None:
        _check_limit(limit)
        out = out.orderBy(F.col("updatedAt").asc(), F.col("pos").asc()).limit(limit)
    return out


def select_numbers(df: DataFrame, numbers: list[int] | DataFrame) -> DataFrame:
    """Restrict to listed numbers (literal list -> pushed ``In``; table -> semi join)."""
    if isinstance(numbers, DataFrame):
        return df.join(numbers.select("number").distinct(), "number", "left_semi")
    return df.where(F.col("number").isin([int(n) for n in numbers]))


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P7 (re-aimed): per orderable column its type, non-null and null counts, min, max
    (as strings) and an approximate distinct count. One pass, one partial aggregate."""
    fields = [f for f in df.schema.fields
              if isinstance(f.dataType, _ORDERABLE) and (columns is None or f.name in columns)]
    aggs: list[Column] = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs += [F.count(c).alias(f"nn{i}"), F.min(c).cast("string").alias(f"mn{i}"),
                 F.max(c).cast("string").alias(f"mx{i}"), F.approx_count_distinct(c).alias(f"nd{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.col(f"nn{i}").alias("non_null"), (F.col("__n") - F.col(f"nn{i}")).alias("nulls"),
                     F.col(f"mn{i}").alias("min_value"), F.col(f"mx{i}").alias("max_value"),
                     F.col(f"nd{i}").alias("approx_distinct"))
            for i, f in enumerate(fields)]
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def sortable_columns(df: DataFrame) -> list[str]:
    """Names of orderable columns, sorted (schema-based, no data read)."""
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, _ORDERABLE))


def top_issues(df: DataFrame, column: str, limit: int = 10, descending: bool = True) -> DataFrame:
    """Top-n by any column; ties keep storage order in both directions; null keys dropped."""
    require_column(df, column)
    _check_limit(limit)
    c = F.col(column)
    dt = df.schema[column].dataType
    key = c if isinstance(dt, _ORDERABLE) else F.to_json(c)
    cols = [x for x in ("number", "title", "summary", "url") if x in df.columns]
    return (df.where(c.isNotNull())
            .orderBy(key.desc() if descending else key.asc(), F.col("pos").asc())
            .limit(limit).select(*cols))


# kinds of JSON values; values of one kind compare, truth values count as 0 and 1
_NUMBER, _TEXT, _LIST, _OBJECT = 1, 2, 4, 8


def _kind(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(0)).when(t == "STRING", F.lit(_TEXT))
            .when(t.startswith("ARRAY"), F.lit(_LIST)).when(t.startswith("OBJECT"), F.lit(_OBJECT))
            .otherwise(F.lit(_NUMBER)))


def _plain_text(v: Column) -> Column:
    """The value as text: True / False, numbers and strings as they are, containers as JSON."""
    return (F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(F.to_json(v)))
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))))


def top_issues_variant(df: DataFrame, column: str, limit: int = 10, descending: bool = True) -> DataFrame:
    """T1 over a VARIANT column of any values. Numbers and truth values compare as numbers
    (large integers exactly), strings by code point, lists of only numbers or only strings
    element by element. If the column holds values that do not compare with each other
    (kinds mixed, objects, lists of anything else), all compare as text. Nulls of both sorts
    are dropped, ties keep storage order. One aggregate over the column finds the kinds: a
    few bits per task. A VARIANT does not tell 1.0 from 1; a container's text is its JSON.
    """
    require_column(df, column)
    _check_limit(limit)
    v = F.col(column)
    some = df.where(v.isNotNull() & ~F.is_variant_null(v))
    elems = F.try_variant_get(v, "$", "array<variant>")
    # a null within a list compares with nothing else
    inner = F.coalesce(F.aggregate(F.transform(elems, lambda x: F.when(
        x.isNull() | F.is_variant_null(x), F.lit(16)).otherwise(_kind(x))), F.lit(0), lambda a, x: a.bitwiseOR(x)),
        F.lit(0))
    seen = some.agg(F.bit_or(_kind(v)).alias("kinds"), F.bit_or(inner).alias("inner")).first()
    kinds, within = seen.kinds or 0, seen.inner or 0
    if kinds == _NUMBER:
        keys = [F.coalesce(F.try_variant_get(v, "$", "double"),
                           F.try_variant_get(v, "$", "boolean").cast("double")),
                F.try_variant_get(v, "$", "decimal(38,0)")]
    elif kinds == _TEXT:
        keys = [F.variant_get(v, "$", "string")]
    elif kinds == _LIST and within in (0, _NUMBER, _TEXT):
        keys = [F.try_variant_get(v, "$", "array<string>" if within == _TEXT else "array<double>")]
    else:
        keys = [_plain_text(v)]
    cols = [x for x in ("number", "title", "summary", "url") if x in df.columns]
    return (some.orderBy(*[k.desc() if descending else k.asc() for k in keys], F.col("pos").asc())
            .limit(limit).select(*cols))


def first_without_recommendation(issues: DataFrame, recs: DataFrame,
                                 status: str | None = "open") -> DataFrame:
    """First issue (by pos) that has no review yet."""
    cand = issues.where(status_predicate(status)).join(recs.select(*KEY), KEY, "left_anti")
    cols = [c for c in ("number", "title", "summary", "url", "state", "pos") if c in issues.columns]
    return first_by_pos(cand.select(*cols))


def latest_recommendation(recs: DataFrame) -> DataFrame:
    """Per issue the review count and the latest review (max seq)."""
    fields = [c for c in recs.columns if c not in ("repo", "number")]
    return (recs.groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("recommendations_count"),
                 F.max_by(F.struct(*fields), F.col("seq")).alias("latest"))
            .select(*KEY, "recommendations_count", "latest.*"))


def with_difficulty(latest: DataFrame) -> DataFrame:
    """Difficulty of the latest review."""
    return latest.withColumn("difficulty", difficulty(F.col("solution_complexity"),
                                                      F.col("solution_risk")))


def issue_by_difficulty(issues: DataFrame, recs: DataFrame, level: str,
                        score_col: str = "total_emojis") -> DataFrame:
    """The reviewed issue of a difficulty with the highest engagement (ties: first stored)."""
    if level not in ("easy", "medium", "hard"):
        raise ValueError("difficulty must be one of: easy, hard, medium")
    lat = with_difficulty(latest_recommendation(recs)).where(F.col("difficulty") == level)
    cols = [c for c in ("pos", "title", "summary", "url", "state") if c in issues.columns]
    score = F.coalesce(F.col(score_col), F.lit(0)).cast("bigint") if score_col in issues.columns \
        else F.lit(0).cast("bigint")
    j = (issues.select(*KEY, *cols, score.alias("engagement_score"))
         .join(lat.select(*KEY, "difficulty", "solution_complexity", "solution_risk",
                          "recommendation", "recommendations_count"), KEY, "inner"))
    return j.orderBy(F.col("engagement_score").desc(), F.col("pos").asc()).limit(1)


def difficulty_answer(issues: DataFrame, recs: DataFrame, xrefs: DataFrame, level: str) -> DataFrame:
    """A17 with every field of the answer: also the reactions to the issue and to its
    conversation, and its references in order. Only the one issue's references are gathered."""
    best = issue_by_difficulty(issues, recs, level)
    emojis = {"issue_emojis": "body_emojis", "conversation_emojis": "comment_emojis"}
    zero = F.lit(0).cast("bigint")
    parts = issues.select(*KEY, F.col("pos").alias("_pos"), *[
        (F.coalesce(F.col(c), zero) if c in issues.columns else zero).alias(n) for n, c in emojis.items()])
    hit = (best.join(parts, (best.repo == parts.repo) & (best.number == parts.number) & (best.pos == parts._pos))
           .select(best["*"], *emojis))
    fields = [c for c in ("idx", "dst", "type", "title", "url") if c in xrefs.columns]
    refs = (xrefs.join(hit.select("repo", F.col("number").alias("src")), ["repo", "src"], "left_semi")
            .groupBy("repo", F.col("src").alias("number"))
            .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("cross_references")))
    whole = refs.schema["cross_references"].dataType
    return hit.join(refs, KEY, "left").withColumn(
        "cross_references", F.coalesce(F.col("cross_references"), F.array().cast(whole)))


def issue_metrics(df: DataFrame, number: int) -> DataFrame:
    """Metric and quartile columns of one issue."""
    cols = ["number"] + [c for m in METRICS for c in (m, f"{m}_quartile") if c in df.columns]
    return first_by_pos(df.where(F.col("number") == F.lit(number)).select("pos", *cols)).drop("pos")


def cross_referenced(issues: DataFrame, xrefs: DataFrame, number: int,
                     status: str | None = None) -> DataFrame:
    """References of one issue; with a status only those whose target has it.

    An unknown status returns nothing here (unlike ``status_filter``).
    """
    target = issues.where(F.col("number") == F.lit(number)).select(*KEY).distinct()
    refs = (xrefs.where(F.col("src") == F.lit(number))
            .join(target.withColumnRenamed("number", "src"), ["repo", "src"], "left_semi"))
    if not status:
        return refs
    # with a status, a reference needs a (truthy) number that names a stored issue
    refs = refs.where(F.col("dst").isNotNull() & (F.col("dst") != 0))
    states = (issues.select("repo", F.col("number").alias("dst"), norm_state().alias("_st"))
              .where(strict_status_predicate(status, F.col("_st"))).select("repo", "dst").distinct())
    return refs.join(states, ["repo", "dst"], "left_semi")


def linked_issues(issues: DataFrame, xrefs: DataFrame, number: int) -> DataFrame:
    """The full row of each referenced issue, in reference order."""
    refs = xrefs.where((F.col("src") == F.lit(number)) & F.col("dst").isNotNull() & (F.col("dst") != 0))
    hits = (refs.select("repo", F.col("idx").alias("ref_idx"), F.col("dst").alias("number"))
            .join(issues, KEY, "inner"))
    # first stored match per reference (numbers are normally unique, so this is cheap)
    w = Window.partitionBy("repo", "ref_idx").orderBy("pos")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def enrich_stats(df: DataFrame) -> DataFrame:
    """Total issues, with an embedding, with a summary (one pass)."""
    emb = F.count_if(F.col("embedding").isNotNull()) if "embedding" in df.columns else F.lit(0).cast("bigint")
    summ = F.count_if(F.col("summary").isNotNull()) if "summary" in df.columns else F.lit(0).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total"), emb.alias("with_embedding"), summ.alias("with_summary"))


def issue_tags(df: DataFrame, shown: int = 5) -> DataFrame:
    """Non-empty label names (first ``shown`` joined, plus how many more) and
    non-empty assignee logins, per issue."""
    empty = F.array().cast("array<string>")
    names = F.filter(F.coalesce(F.transform("labels", lambda x: x["name"]), empty),
                     lambda n: n.isNotNull() & (n != ""))
    logins = F.filter(F.coalesce(F.transform("assignees", lambda x: x["login"]), empty),
                      lambda n: n.isNotNull() & (n != ""))
    return df.select(
        "number",
        F.array_join(F.slice(names, 1, shown), ", ").alias("labels"),
        F.greatest(F.size(names) - shown, F.lit(0)).cast("bigint").alias("more_labels"),
        F.array_join(logins, ", ").alias("assignees"))
