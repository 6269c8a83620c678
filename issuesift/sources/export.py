"""Sinks: open-issue export (S8) and graph layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def open_issues_export(issues: DataFrame) -> DataFrame:
    """S8 rows: ``{name: '#n', title, url, summary}`` of open issues (state compared
    case-insensitively, since ingest stores lower-case states)."""
    from ..functions.predicates import state_is

    return (issues.where(state_is("open"))
            .select(F.concat(F.lit("#"), F.col("number").cast("string")).alias("name"),
                    F.coalesce(F.col("title"), F.lit("")).alias("title"),
                    F.coalesce(F.col("url"), F.lit("")).alias("url"),
                    F.col("summary")))


def write_open_issues(issues: DataFrame, path: str) -> int:
    """Write the export as JSON lines; returns the row count, taken while writing."""
    seen = Observation()
    open_issues_export(issues).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_layout(layout: DataFrame, path: str) -> None:
    """``{issue_id, x, y}`` JSON lines."""
    (layout.select(F.col("number").cast("string").alias("issue_id"), "x", "y")
     .write.mode("overwrite").json(path))
