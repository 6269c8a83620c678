import numpy as np
from pyspark.sql import functions as F

from issuesift.llm import topk


def test_index_is_exact(monkeypatch):
    monkeypatch.setattr(topk, "SEGMENT", 8)
    rng = np.random.default_rng(1)
    for n, d, low in ((500, 16, 50), (300, 3, 2), (45, 8, 1), (10, 4, 9)):
        v = rng.integers(-low, low + 1, (n, d))
        ids = rng.permutation(n).astype(np.int64)
        index = topk.Index(ids, v)
        for i in range(0, n, 17):
            at, score = index.search(int(ids[i]), v[i], 10)
            want = sorted((-int(v[i] @ v[j]), int(ids[j])) for j in range(n) if j != i)[:10]
            assert [(-int(s), int(ids[a])) for a, s in zip(at, score, strict=True)] == want
        assert len(index.search(-1, np.zeros(d, np.int64), 3)[0]) == 3


def test_query_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(9000, 6)).round(2)
    v[100:400] = v[100]  # a large group of copies: ties by id
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(9000)]
    odd = [(14, None, 1), (21, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (9107, [float("nan")] * 6, 1), (9114, [float("inf")] * 6, 1), (None, [1.0] * 6, 1)]
    rows = [r for r in rows if r[0] not in (14, 21)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("id") % 700 == 0).collect()))
    ids = [i for i in range(9000) if i not in (14, 21)]
    whole = np.floor(v * 1024).astype(np.int64)
    want = []
    for q in range(0, 9000, 700):
        s = whole @ whole[q]
        best = sorted((-int(s[i]), i) for i in ids if i != q)[:10]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(best)]
    assert got == sorted(want)


def test_few_rows_and_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (3, [0.5], 1)], kind)
    assert sorted(map(tuple, topk.exact_top_k(one, F.col("id") == 0).collect())) == [(0, 1, 3, 524288)]
    assert topk.exact_top_k(one.where("vec_id = 9"), F.col("id") == 0).count() == 0
    assert topk.exact_top_k(one, F.col("id") == 9).count() == 0
