"""Pivot-cell k-NN against all pairs, and how many pairs it looks at."""

from __future__ import annotations

import numpy as np
import pytest

from issuesift.operators import knn_cells as kc
from issuesift.operators.knn import knn_pairs

SCHEMA = "number long, embedding array<double>, d int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1) for i, v in enumerate(vectors)], SCHEMA).repartition(5)


def brute(vectors, k, metric):
    ids = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    if len(ids) < 2:
        return []
    v = np.array([vectors[i] for i in ids], float)
    if metric == "cosine":
        n = np.linalg.norm(v, axis=1, keepdims=True)
        u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    d = np.round(d, 9)
    out = []
    for r, i in enumerate(ids):
        order = sorted((d[r, s], j) for s, j in enumerate(ids) if j != i)[:k]
        out += [(i, rank, j, round(x, 6) + 0.0) for rank, (x, j) in enumerate(order, 1)]
    return sorted(out)


def rows(df):
    return sorted((r.q, r["rank"], r.c, round(round(r.distance, 9), 6) + 0.0) for r in df.collect())


def clustered(seed=0, clusters=30, each=40, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    centres *= 5 / np.linalg.norm(centres, axis=1, keepdims=True)
    return [c + 0.05 * rng.normal(size=dims) for c in centres for _ in range(each)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_clusters_need_few_pairs(spark, metric):
    vectors = clustered()
    got, did = kc.knn_cells(frame(spark, vectors), 4, metric, cells=60)
    assert rows(got) == brute(vectors, 4, metric)
    assert did["rows"] == len(vectors) and did["cells"] >= 60
    assert did["compared"] < 0.1 * len(vectors) ** 2


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_copies_zeros_nulls_and_tiny_cells(spark, metric, monkeypatch):
    monkeypatch.setattr(kc, "CELL_ROWS", 32)  # copies of one vector fill several tiles
    monkeypatch.setattr(kc, "VISITORS", 16)
    rng = np.random.default_rng(2)
    vectors = clustered(1, 4, 10, 5) + [np.ones(5)] * 90 + [2 * np.ones(5)] * 3 + [np.zeros(5)] * 3 + [None, []] + list(rng.normal(size=(20, 5)))
    got, did = kc.knn_cells(frame(spark, vectors), 3, metric, cells=6)
    assert rows(got) == brute(vectors, 3, metric)


def test_cells_follow_measured_sizes(spark):
    """One dense cluster holds most rows: it gets pivots of its own."""
    rng = np.random.default_rng(4)
    vectors = list(rng.normal(size=(900, 3)) * 0.2) + list(10 + rng.normal(size=(60, 3)) * 5)
    points = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>")
    made, placed = kc._cells(points, len(vectors), 3, 8, 64)
    assert len(made.pivots) > 8 and made.size.sum() == len(vectors) == placed.count()
    assert made.size.max() <= 4 * 64


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[0.0, 0.0], [0.0, 0.0]], [[1.0, 0.0], [0.0, 0.0], [1.0, 0.0]]])
def test_few_rows(spark, vectors):
    for metric in ("cosine", "euclidean"):
        assert rows(knn_pairs(frame(spark, vectors), 4, metric, method="cells")) == brute(vectors, 4, metric)


def test_wrong_settings(spark):
    df = frame(spark, [[1.0], [2.0]])
    with pytest.raises(ValueError):
        knn_pairs(df, method="tree")
    with pytest.raises(ValueError):
        kc.knn_cells(df, metric="hamming")
