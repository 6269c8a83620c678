import numpy as np
from pyspark.sql import functions as F

from issuesift.llm import embedding_dedup as ed

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.93):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[n] = (label, np.array(v) / np.linalg.norm(v))
    links = {n: [m for m in ok if m != n and ok[m][0] == ok[n][0] and len(ok[m][1]) == len(ok[n][1]) and ok[m][1] @ ok[n][1] >= threshold] for n in ok}
    out = []
    for n, (i, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        comp = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        out.append((i, len(links.get(n, [])), comp, comp is not None and comp == i))
    return sorted(map(str, out))


def test_links_and_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "TILE", 32)
    monkeypatch.setattr(ed, "PER_PIVOT", 40)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):  # chains of close vectors, some wide
        at = rng.normal(size=5)
        for _ in range(25):
            at = at + rng.normal(size=5) * 0.18
            rows.append((len(rows) * 3 % 1009, [float(x) for x in at], c % 3))
    rows += [(5000 + i, rows[0][1], 0) for i in range(120)]  # a hot group of copies
    rows += [(6000, [2 * x for x in rows[0][1]], 0), (6001, rows[0][1], None), (6002, None, 0), (6003, [0.0] * 5, 0), (6004, [1.0, None, 0.0, 0.0, 0.0], 0),
             (6005, [float("nan")] * 5, 0), (None, rows[0][1], 0), (6006, [1.0, 2.0], 0), (6007, [1.0, 2.0], 0), (6008, [], 0)]
    df = spark.createDataFrame(rows, KIND).withColumn("rep", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("n", F.lit(3))
    got = sorted(str(tuple(r)) for r in ed.near_duplicates(df).collect())
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)]
    got = sorted(map(tuple, ed.near_duplicates(spark.createDataFrame(rows, KIND)).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert ed.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    none = spark.createDataFrame([(4, None, 1)], KIND)
    assert [tuple(r) for r in ed.near_duplicates(none).collect()] == [(4, 0, 4, True)]
