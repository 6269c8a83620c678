"""Conversation text (F4 + W2) and embedding text (F5 + W3) per issue.

Both are prefix cuts over an issue's comments in order: keep comments while
the running length stays within a budget. The running length comes from
``windows.running_sum`` over keys and lengths alone (range-partitioned, so an
issue with a third of all comments is split over many tasks); texts are read
once, for the comments kept. Only those are gathered per issue, so for the
conversation the gathered array is bounded by the budget, not by the number of
comments (the embedding text also keeps blank comments, as line ends). Lengths are >= 0, so the running sum never decreases
and "while" equals "running sum <= budget".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .windows import running_sum

KEY = ["repo", "number"]


def body_reaction_groups(reactions: DataFrame) -> DataFrame:
    """Reaction groups of each issue body as an array in API order."""
    return (reactions.groupBy(*KEY)
            .agg(F.array_sort(F.collect_list(F.struct(
                X.emoji_order(F.col("content")).alias("o"), F.col("content"), F.col("count"))))
                .alias("_g"))
            .select(*KEY, F.transform("_g", lambda g: F.struct(
                g["content"].alias("content"), g["count"].alias("count"))).alias("reactionGroups")))


def _comment_emoji(comments: DataFrame) -> Column:
    """Per-comment emoji suffix: groups when present, else `` [👍 n]`` for a positive total."""
    fallback = F.when(F.coalesce(F.col("reactions_total"), F.lit(0)) > 0,
                      F.concat(F.lit(" [👍 "), F.col("reactions_total").cast("string"), F.lit("]"))
                      ).otherwise(F.lit(""))
    if "reactionGroups" not in comments.columns:
        return fallback
    g = X.counted_groups(comments, "reactionGroups")
    return F.when(F.coalesce(F.size(g), F.lit(0)) > 0, X.emoji_text(g)).otherwise(fallback)


def _within(lengths: DataFrame, limit: int) -> DataFrame:
    """Comments (``idx``) up to the first that passes ``limit``, that one marked
    ``_over``. ``lengths`` holds keys, ``idx`` and ``_len``, no texts."""
    run = running_sum(lengths, KEY, "idx", "_len", "_run").where(F.col("_run") - F.col("_len") <= limit)
    return run.select(*KEY, "idx", (F.col("_run") > limit).alias("_over"))


def _gather(kept: DataFrame, part: str, cut_flag: str) -> DataFrame:
    """Join kept parts in ``idx`` order; flag issues whose comments were cut. The parts
    are dealt as the join with the issues of one ``repo`` needs them, so they move once."""
    return (kept.repartition("number").groupBy(*KEY)
            .agg(F.array_sort(F.collect_list(F.when(~F.col(cut_flag), F.struct("idx", part))))
                 .alias("_parts"),
                 F.bool_or(F.col(cut_flag)).alias("_cut")))


def conversation(issues: DataFrame, comments: DataFrame, reactions: DataFrame | None = None,
                 column: str = "conversation") -> DataFrame:
    """Append the conversation text: title, ``author: body[emoji]``, then
    ``author: comment[emoji]`` parts joined by a blank line; blank parts are
    skipped; comments stop once their truncated lengths would pass 25,000."""
    c = comments.where(~X.is_blank(F.col("body")))
    t = X.truncate(F.col("body"), X.CONV_COMMENT_LIMIT)
    # the first comment over budget ends the list; everything after it is dropped
    kept = _within(c.select(*KEY, "idx", F.length(t).alias("_len")), X.CONV_COMMENTS_LIMIT)
    text = F.concat(F.coalesce(F.col("author"), F.lit("unknown")), F.lit(": "), X.py_strip(t), _comment_emoji(comments))
    parts = _gather(c.select(*KEY, "idx", text.alias("_part")).join(kept, [*KEY, "idx"]), "_part", "_over")

    iss = issues
    if reactions is not None:
        iss = iss.join(body_reaction_groups(reactions).withColumnRenamed("reactionGroups", "_bg"),
                       KEY, "left")
        body_emoji = X.emoji_text(F.col("_bg"))
    elif "reactionGroups" in issues.columns:
        body_emoji = X.emoji_text(X.counted_groups(issues, "reactionGroups"))
    else:
        body_emoji = F.lit("")
    title = X.py_strip(F.coalesce(F.col("title"), F.lit("")))
    body = F.col("body")
    body_part = F.when(~X.is_blank(body), F.concat(
        F.coalesce(F.col("author"), F.lit("unknown")), F.lit(": "),
        X.py_strip(X.truncate(body, X.CONV_BODY_LIMIT)), body_emoji))
    j = iss.join(parts, KEY, "left")
    comments_txt = F.array_join(F.transform(F.col("_parts"), lambda p: p["_part"]), "\n\n")
    text = F.concat_ws(
        "\n\n",
        F.when(F.length(title) > 0, title),
        body_part,
        F.when(F.coalesce(F.size("_parts"), F.lit(0)) > 0, comments_txt),
        F.when(F.coalesce(F.col("_cut"), F.lit(False)), F.lit(X.CONV_CUT_MARKER)))
    drop = ["_parts", "_cut"] + (["_bg"] if reactions is not None else [])
    return j.withColumn(column, text).drop(*drop)


def embedding_text(issues: DataFrame, comments: DataFrame, column: str = "embed_text") -> DataFrame:
    """Append the text that is embedded: ``title\\nbody\\ncomments`` (body cut at
    15,000; comments, blank ones included, while their raw lengths stay within
    8,000, then a marker), stripped; null when empty."""
    b = F.coalesce(F.col("body"), F.lit(""))
    kept = _within(comments.select(*KEY, "idx", F.length(b).alias("_len")), X.EMBED_COMMENTS_LIMIT)
    # a comment longer than the budget is never kept: its text need not be shuffled
    part = F.when(F.length(b) <= X.EMBED_COMMENTS_LIMIT, b)
    c = comments.select(*KEY, "idx", part.alias("_b")).join(kept, [*KEY, "idx"])
    parts = _gather(c, "_b", "_over")
    j = issues.join(parts, KEY, "left")
    joined = F.array_join(F.transform(F.coalesce(F.col("_parts"), F.array()), lambda p: p["_b"]), "\n")
    joined = F.when(F.coalesce(F.col("_cut"), F.lit(False)),
                    F.when(F.coalesce(F.size("_parts"), F.lit(0)) > 0,
                           F.concat(joined, F.lit("\n" + X.EMBED_CUT_MARKER)))
                    .otherwise(F.lit(X.EMBED_CUT_MARKER))).otherwise(joined)
    content = F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit("\n"),
                       X.truncate(F.coalesce(F.col("body"), F.lit("")), X.EMBED_BODY_LIMIT),
                       F.lit("\n"), joined)
    stripped = X.py_strip(content)
    return j.withColumn(column, F.when(F.length(stripped) > 0, stripped)).drop("_parts", "_cut")
