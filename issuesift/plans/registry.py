"""Registered queries (Spark) and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame with flat
columns; timestamps are rendered as ``yyyy-MM-dd HH:mm:ss`` strings and
doubles rounded to 6 places so the two engines can be compared by value.
The catalog modules imported at the bottom fill ``QUERIES`` / ``ORACLE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ts_str(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# RE2 form of the Python whitespace class (functions.text.PY_WS)
SQL_WS = ("[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
          "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_full_match({x}, '{SQL_WS}*'))"


def sql_trunc(x: str, n: int, suffix: str = "... [truncated]") -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '{suffix}' ELSE {x} END)"


from . import (catalog_core, catalog_pull, catalog_quality, catalog_sources, catalog_stream,  # noqa: E402,F401
               catalog_text, catalog_tools, catalog_vec)
