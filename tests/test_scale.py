"""What a task holds and how often rows are sent must not grow with the collection."""

from __future__ import annotations

import datetime
import os
import re

import numpy as np
import pandas as pd
import pytest

from issuesift import fixtures as fx
from issuesift.operators import knn as K
from issuesift.operators import knn_cells as kc
from issuesift.operators.assemble import assemble_issues
from issuesift.plans import registry  # noqa: F401  (first: the catalogs register there)
from issuesift.plans import catalog_sources as cs
from issuesift.sources import pages as P


@pytest.fixture()
def orders(spark, tmpdir_path):
    """Five orders with up to three lines, in a folder of tables."""
    day = datetime.datetime(2024, 1, 1)
    rows = [(o, n + 1, 10 * o + n, o % 3, float(n + 1), 1.0, 0.0, 0.0, "ANR"[n], "OF"[n % 2], day + datetime.timedelta(days=n))
            for o in range(5) for n in range(o % 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(
        os.path.join(tmpdir_path, "lineitem.parquet"))
    spark.createDataFrame([(o, o, "FOP"[o % 3], 1.0, day, "1-URGENT") for o in range(5)], "o_orderkey long, o_custkey long, o_orderstatus string, "
                          "o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(os.path.join(tmpdir_path, "orders.parquet"))
    return tmpdir_path, rows


def _files(spark, path):
    return [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]


def test_landed_pages_are_compressed_and_whole(spark, orders):
    sf, rows = orders
    path = cs.comment_rows(spark, sf)
    assert _files(spark, path) and all(f.endswith(".gz") for f in _files(spark, path))
    got = P.read_comment_pages(spark, path, "r").select("number", "id", "body", "author", "authorAssociation", "reactions_total").collect()
    assert sorted(map(tuple, got)) == sorted(
        (r[0], str(r[0] * 1000 + r[1] * 10), f"part {r[2]}", f"s{r[3]}", "NONE" if r[1] == 1 else "CONTRIBUTOR", 0 if r[8] == "N" else int(r[4])) for r in rows)
    path = cs.timeline_rows(spark, sf)
    assert all(f.endswith(".gz") for f in _files(spark, path))
    got = P.read_timeline_pages(spark, path, "r", envelope=True).select("src", "dst", "type", "title", "author").collect()
    assert sorted(map(tuple, got)) == sorted(
        (r[0], r[2], "issue" if r[9] == "O" else "pr", f"part {r[2]}", f"s{r[3]}") for r in rows if r[8] != "A")


def test_children_are_sent_once(spark, orders):
    """The lines are dealt before texts are made of them, and lists made of them stay where they are."""
    sf, rows = orders
    docs = assemble_issues(fx.orders_issues(spark, sf), fx.orders_comments(spark, sf), fx.orders_xrefs(spark, sf))
    physical = docs._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(fixture/orders", physical)
    got = {r.number: r for r in docs.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for o in range(5):
        mine = sorted((r for r in rows if r[0] == o), key=lambda r: (r[10], r[1]))
        assert [c.body for c in got[o].comments] == [f"part {r[2]}" for r in mine]
        assert [c.id for c in got[o].comments] == [f"{o}-{r[1]}-{r[2]}-{r[3]}" for r in mine]
        assert [x.number for x in got[o].cross_references] == [r[2] for r in mine]
    places = {(r.number, r.idx) for r in fx.orders_comments(spark, sf).collect()}
    assert places == {(o, i) for o in range(5) for i in range(o % 4)}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("hi", [0, 1])
def test_a_block_pair_is_searched_in_tiles(monkeypatch, metric, hi):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6))
    v[40:60] = v[0]                                   # copies, in several tiles
    g = pd.DataFrame({"id": np.arange(90), "v": list(v), "blk": np.arange(90) % (hi + 1), "lo": 0, "hi": hi})
    run = K._pair_topk(4, metric)
    whole = run(g).sort_values(["q", "distance", "c"]).reset_index(drop=True)
    shapes, plain = [], K._distances
    monkeypatch.setattr(K, "TILE_ROWS", 16)
    monkeypatch.setattr(K, "_distances", lambda q, c, m: (shapes.append((len(q), len(c))), plain(q, c, m))[1])
    tiled = run(g.sample(frac=1, random_state=1)).sort_values(["q", "distance", "c"]).reset_index(drop=True)
    assert len(shapes) > 4 and max(max(s) for s in shapes) <= 16
    pd.testing.assert_frame_equal(whole, tiled)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_vectors_are_sent_to_few_cells_and_parts(spark, monkeypatch, metric):
    """Cells and tiles grow with the collection, so their number does not."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 12))
    monkeypatch.setattr(kc, "SPREAD", 4)
    monkeypatch.setattr(kc, "CELL_ROWS", 20)
    monkeypatch.setattr(kc, "VISITORS", 20)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "number long, embedding array<double>")
    got, did = kc.knn_cells(df, 3, metric, cell_rows=20)
    assert did["rows"] == 600 and did["cells"] <= 8
    if metric == "cosine":
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert sorted((r.q, r["rank"], r.c) for r in got.collect()) == sorted((i, r + 1, int(c)) for i in range(600) for r, c in enumerate(near[i]))
