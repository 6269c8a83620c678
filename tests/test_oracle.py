"""Every registered query against its DuckDB oracle on the smallest driver data."""

import math

import duckdb
import pytest

import __spark_entry__ as se
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
ORACLE = se.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_is_registered_with_a_callable():
    qs = se.queries()
    assert len(qs) >= 80
    assert set(ORACLE) <= set(qs)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = se.queries()[name](spark, SF_SMALL)
    cols = df.columns
    srows = [tuple(_norm(x) for x in r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = [tuple(_norm(x) for x in r) for r in cur.fetchall()]
    assert sorted(cols) == sorted(dcols)
    si = sorted(range(len(cols)), key=lambda i: cols[i])
    di = sorted(range(len(dcols)), key=lambda i: dcols[i])
    s2 = sorted((tuple(r[i] for i in si) for r in srows), key=_key)
    d2 = sorted((tuple(r[i] for i in di) for r in drows), key=_key)
    assert len(s2) == len(d2)
    assert s2 == d2


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert df.columns == ["number", "title", "summary", "url"]
    assert len(rows) == 10
