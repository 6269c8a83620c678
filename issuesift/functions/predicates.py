"""Row predicates and small classifiers shared by the query operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_state(col: str | Column = "state") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.coalesce(c, F.lit("")))


def case_variants(word: str) -> list[str]:
    """All upper/lower spellings of an ASCII word (``open`` -> 16 strings)."""
    out = [""]
    for ch in word:
        out = [p + c for p in out for c in {ch.lower(), ch.upper()}]
    return sorted(out)


def state_is(value: str, col: str | Column = "state") -> Column:
    """``lower(state) == value`` written as ``state IN (all spellings)``: the
    same rows for these ASCII words, but a filter Parquet can push down."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isin(case_variants(value))


def status_predicate(status: str | None, col: str | Column = "state") -> Column:
    """``open``/``closed`` (any case) select that state; anything else keeps every row."""
    s = (status or "").lower()
    if s in ("open", "closed"):
        return state_is(s, col)
    return F.lit(True)


def strict_status_predicate(status: str | None, col: str | Column = "state") -> Column:
    """Cross-reference variant: an unknown status matches nothing."""
    s = (status or "").lower()
    if s in ("open", "closed"):
        return state_is(s, col)
    return F.lit(False)


def issue_type(url: str | Column = "url", pull_request: Column | None = None) -> Column:
    """``pr`` for a truthy pull_request marker or a ``/pull/`` URL, else ``issue``."""
    u = F.col(url) if isinstance(url, str) else url
    e = F.when(F.coalesce(u, F.lit("")).contains("/pull/"), "pr").otherwise("issue")
    if pull_request is not None:
        e = F.when(pull_request.isNotNull() & (pull_request.cast("string") != ""), "pr").otherwise(e)
    return e


def difficulty(complexity: Column, risk: Column) -> Column:
    """easy = low and low; hard = any high; medium otherwise (also when missing)."""
    c = F.lower(F.coalesce(complexity, F.lit("")))
    r = F.lower(F.coalesce(risk, F.lit("")))
    return (F.when((c == "low") & (r == "low"), "easy")
            .when((c == "high") | (r == "high"), "hard")
            .otherwise("medium"))
