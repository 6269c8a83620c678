"""Metrics, quartile labels and the exact quantile search."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from issuesift.functions.quantiles import exact_quantiles
from issuesift.operators.metrics import QUARTILE_LABELS, add_metrics, add_quartiles

ISSUE_T = ("repo string, number long, pos long, createdAt timestamp, updatedAt timestamp, "
           "reactions_total long")


def qcut_labels(values):
    s = pd.Series(values, dtype="float64")
    try:
        return list(pd.qcut(s, q=4, labels=QUARTILE_LABELS, duplicates="raise").astype(object)
                    .where(s.notna(), None))
    except ValueError:
        return ["Top25%"] * len(values)


@pytest.mark.parametrize("seed,kind", [(1, "float"), (2, "int"), (3, "ties"), (4, "const")])
def test_quartiles_equal_pandas_qcut(spark, seed, kind):
    rng = np.random.default_rng(seed)
    n = 3000
    if kind == "float":
        v = rng.exponential(2.0, n)
    elif kind == "int":
        v = rng.integers(0, 50, n).astype(float)
    elif kind == "ties":
        v = np.where(rng.random(n) < 0.8, 0.0, rng.integers(1, 5, n))
    else:
        v = np.full(n, 7.0)
    vals = [None if i % 97 == 0 else float(x) for i, x in enumerate(v)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(vals)], "i long, m double")
    got = {r.i: r.m_quartile for r in add_quartiles(df, ["m"]).select("i", "m_quartile").collect()}
    want = qcut_labels(vals)
    mism = [i for i in range(n) if got[i] != want[i] and vals[i] is not None]
    assert not mism
    assert all(got[i] is None for i in range(n) if vals[i] is None)


def test_exact_quantiles_equal_numpy_on_skewed_doubles(spark):
    rng = np.random.default_rng(9)
    # a third of all rows share one value; the rest are continuous
    v = np.concatenate([np.full(20000, 1.5), rng.lognormal(0, 2, 40000)])
    df = spark.createDataFrame([(float(x),) for x in v], "x double").repartition(8)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, accuracy=1000)["x"]
    want = np.quantile(v, probs)
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_exact_quantiles_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.0, 0.5, 1.0])["x"] is None


def test_metrics_edge_cases(spark):
    issues = spark.createDataFrame([
        ("r", 1, 1, "2024-01-01 00:00:00", "2024-01-01 23:59:59", None),   # age 0
        ("r", 2, 2, "2024-01-05 00:00:00", "2024-01-01 00:00:00", 4),      # negative age, REST total
        ("r", 3, 3, "2024-01-01 00:00:00", "2024-01-11 00:00:01", None),   # 10 days
    ], "repo string, number long, pos long, c string, u string, reactions_total long").select(
        "repo", "number", "pos", F.to_timestamp("c").alias("createdAt"), F.to_timestamp("u").alias("updatedAt"),
        "reactions_total")
    comments = spark.createDataFrame([
        ("r", 3, 0, None, 5), ("r", 3, 1, [("HEART", 2), ("EYES", 1)], 9), ("r", 3, 2, [("EYES", 0)], 0),
    ], "repo string, number long, idx long, reactionGroups array<struct<content:string,count:bigint>>, "
       "reactions_total long")
    reactions = spark.createDataFrame([("r", 1, "THUMBS_UP", 2), ("r", 1, "EYES", 1), ("r", 2, "EYES", 0)],
                                      "repo string, number long, content string, count long")
    m = {r.number: r for r in add_metrics(issues, comments, reactions).collect()}
    assert (m[1].age_days, m[1].body_emojis, m[1].comment_count, m[1].engagements_per_day) == (0, 3, 0, 0.0)
    assert (m[2].age_days, m[2].body_emojis, m[2].engagements_per_day) == (-4, 4, 0.0)
    assert (m[3].age_days, m[3].comment_count, m[3].comment_emojis, m[3].total_emojis) == (10, 3, 8, 8)
    assert m[3].engagements == 11 and m[3].engagements_per_day == pytest.approx(1.1)


def test_exact_quantiles_narrow_until_bands_are_small(spark, monkeypatch):
    from issuesift.functions import quantiles

    monkeypatch.setattr(quantiles, "BAND_ROWS", 20)
    rng = np.random.default_rng(9)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    columns = {"wide": rng.normal(size=4000) * 10.0 ** rng.integers(-9, 9, 4000), "ties": rng.integers(0, 3, 4000).astype(float),
               "one": np.full(4000, 7.0), "near": 1.0 + rng.integers(0, 2, 4000) * 2.0 ** -52, "apart": np.repeat([1.0, 5.0], 2000)}
    rows = list(zip(*[[float(x) for x in c] for c in columns.values()], strict=True))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    got = exact_quantiles(df, list(columns), probs, accuracy=50)
    for c, v in columns.items():
        assert np.allclose(got[c], np.quantile(v, probs), rtol=1e-12, atol=0), c
