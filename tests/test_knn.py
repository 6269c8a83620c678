"""Exact k-NN against brute force, similarity search, LSH and layout."""

import numpy as np
import pytest

from issuesift.operators import knn as K


def brute(vecs, ids, k, metric):
    V = np.array(vecs, dtype=float)
    out = {}
    for a in range(len(ids)):
        d = []
        for b in range(len(ids)):
            if ids[a] == ids[b]:
                continue
            if metric == "cosine":
                na, nb = np.linalg.norm(V[a]), np.linalg.norm(V[b])
                cos = V[a] @ V[b] / (na * nb) if na and nb else 0.0
                d.append((1 - cos, ids[b]))
            else:
                d.append((float(np.linalg.norm(V[a] - V[b])), ids[b]))
        d.sort()
        out[ids[a]] = d[:k]
    return out


def _frame(spark, n=300, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n, dim)).astype(np.float32)
    vecs[10] = vecs[11] = vecs[12] = vecs[13]       # exact duplicates
    vecs[20] = 0.0                                    # zero vector
    rows = [(int(i), int(i), f"t{i}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    rows.append((n, n, "no embedding", None))
    df = spark.createDataFrame(rows, "number long, pos long, title string, embedding array<float>")
    return df, [r[3] for r in rows[:-1]], [r[0] for r in rows[:-1]]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("blocks", [1, 4])
def test_knn_equals_brute_force(spark, metric, blocks):
    df, vecs, ids = _frame(spark)
    got = {}
    for r in K.knn_pairs(df, 4, metric, num_blocks=blocks).collect():
        got.setdefault(r.q, []).append((r.rank, r.c, r.distance))
    want = brute(vecs, ids, 4, metric)
    assert set(got) == set(want)
    for q, lst in got.items():
        lst.sort()
        assert [c for _, c, _ in lst] == [c for _, c in want[q]], q
        assert np.allclose([d for _, _, d in lst], [d for d, _ in want[q]], atol=1e-9)


def test_knn_lists_empty_when_too_few(spark):
    rows = [(i, i, f"t{i}", [1.0, float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "number long, pos long, title string, embedding array<float>")
    out = K.knn_neighbors(df, 4).collect()
    assert all(r.k4_distances == [] for r in out)


def test_knn_lists_titles(spark):
    df, vecs, ids = _frame(spark, n=40)
    out = {r.number: r.k4_distances for r in K.knn_neighbors(df, 4).collect()}
    assert out[40] == []
    assert len(out[0]) == 4 and out[0][0].title == f"t{out[0][0].issue_number}"


def test_similar_issues(spark):
    rows = [(1, 1, "a", "open", [1.0, 0.0]), (2, 2, "b", "closed", [0.9, 0.1]), (3, 3, "c", "open", [0.0, 1.0]),
            (4, 4, "d", "open", [1.0, 0.0]), (5, 5, "e", "open", None)]
    df = spark.createDataFrame(rows, "number long, pos long, title string, state string, embedding array<float>")
    got = [(r.number, round(r.similarity, 6)) for r in K.similar_issues(df, 1, 0.5).collect()]
    assert got == [(4, 1.0), (2, round(0.9 / np.hypot(0.9, 0.1), 6))]
    assert [r.number for r in K.similar_issues(df, 1, 0.5, status="OPEN").collect()] == [4]
    assert K.similar_issues(df, 5).count() == 0
    assert K.similar_issues(df, 99).count() == 0
    with pytest.raises(ValueError):
        K.similar_issues(df, 1, limit=-1)


def test_cosine_zero_and_length(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    out = [r.c for r in df.select(K.cosine(df.a, df.b).alias("c")).collect()]
    assert out == [0.0, None]


def test_lsh_and_layout_shapes(spark):
    df, vecs, ids = _frame(spark, n=80)
    pairs = K.knn_lsh(df, 4, bucket_length=2.0, block_rows=16).collect()
    assert pairs and all(r.q != r.c and r.rank <= 4 for r in pairs)
    exact = brute(vecs, ids, 80, "cosine")
    for r in pairs:   # every reported distance is the exact distance of that pair
        d = dict((c, x) for x, c in exact[r.q])[r.c]
        assert abs(d - r.distance) < 1e-9
    lay = K.layout_2d(df, 10.0).collect()
    assert len(lay) == 80 and all(r.x is not None for r in lay)
