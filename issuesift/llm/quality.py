"""Quality classifier: ridge regression on random Fourier features.

Every text becomes ``STATS`` document statistics. Random Fourier features of
the standardised statistics approximate a Gaussian kernel; each partition sums
its part of the normal equations, the sums are added by feature row, and the
driver solves one fixed-size ridge system. An isotonic curve, fitted on counts
per score bin of all labelled training rows, turns scores into probabilities.

Defined cases: null and empty texts have all statistics 0 and are scored like
any other; repeated labels of one document count as 1 if any is; null labels
are skipped; without training rows every score is 0.0 and raw is null; repeated rows are
scored alike; other columns are not read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import bin_of, calibrated, isotonic
from .common import slices, stage
from .toxicity import labelled

STATS = ("log_words", "log_chars", "word_len", "word_len_sd", "distinct", "top_word", "repeat_next", "lines_distinct",
         "upper", "digit", "symbol", "symbol_next", "sentence_end", "pipe", "exclaim", "non_ascii")
FEATURES = 128
_KIND = np.zeros(256, np.uint8)  # 0 lower-case letter and the like
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"#$%&*+/<=>@[]^_`{}~\\",
                             b".?;:", b"|", b"!", bytes(range(128, 256))), 1):
    _KIND[list(_bytes)] = _k


def statistics(text: str | None) -> list[float]:
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATS)
    kinds = _KIND[np.frombuffer(text.encode(), np.uint8)]
    n = len(kinds)
    share = np.bincount(kinds, minlength=9) / n
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    uses = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    marks = kinds == 4
    k = len(words)
    return [float(np.log1p(k)), float(np.log1p(n)), float(sizes.mean()), float(min(sizes.std(), 50.0)), len(uses) / k ** 0.9,
            max(uses.values()) / k, sum(map(operator.eq, words, words[1:])) / k, len(set(lines)) / len(lines),
            share[1], share[2], share[4], float((marks[1:] & marks[:-1]).mean()) if n > 1 else 0.0, share[5], share[6],
            share[7], share[8]]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``doc_id``, ``x``: the statistics of every row, in the order of STATS;
    and ``row``, the value of ``row_col``, if one is named."""
    own = [] if row_col is None else ["row"]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *(F.col(f"`{row_col}`").alias(c) for c in own))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(x, pa.list_(pa.float64()))],
                                             ["doc_id", *own, "x"])

    return rows.mapInArrow(stats, f"{kinds}x array<double>")


class Features:
    """Random Fourier features of standardised statistics, plus a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, width: float = 2.0, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, sd
        self.w = rng.normal(0.0, 1.0 / (width * np.sqrt(len(mean))), (len(mean), FEATURES))
        self.b = rng.uniform(0.0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8.0, 8.0)
        return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def fit(train: DataFrame, ridge: float = 1e-3) -> tuple[Features, np.ndarray] | None:
    """Features and weights from rows ``x``, ``label``."""
    parts = [f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(STATS))]
    got = train.agg(F.count(F.lit(1)), *parts).first()
    if not got[0]:
        return None
    d = len(STATS)
    mean, sd = np.array(got[1:d + 1], float), np.array(got[d + 1:], float)
    features = Features(mean, np.where(sd > 1e-9, sd, 1.0))
    size = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = features(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         ["i", "row"])

    rows = train.select("x", "label").mapInArrow(partial, "i int, row array<double>")
    added = rows.groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(size + 1)]).alias("row"))
    m = np.array([r["row"] for r in sorted(added.collect(), key=lambda r: r["i"])])
    weights = np.linalg.solve(m[:, :size] + ridge * got[0] / FEATURES * np.eye(size), m[:, size])
    return features, weights


def score_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, row_col: str | None = None) -> DataFrame:
    """Score every row of ``docs``; learn from labels of rows where
    ``may_learn`` (an expression over ``doc_id``) is true. Returns ``doc_id``,
    ``raw``, ``score`` (0 to 1) and ``predicted`` (score >= threshold); and
    ``row``, the value of ``row_col``, if one is named."""
    own = [] if row_col is None else ["row"]
    stats = stage(document_statistics(docs, id_col, text_col, row_col), "quality-stats").select("doc_id", "x", *own)
    marks = labelled(labels, label_col).where(may_learn)
    model = fit(stats.join(marks, "doc_id").select("x", "label"))
    if model is None:
        out = stats.select("doc_id", *own, F.lit(None).cast("double").alias("raw"), F.lit(0.0).alias("score"))
    else:
        features, weights = model
        kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in stats.schema if f.name != "x")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = features(_matrix(batch.column(1))) @ weights
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(raw, pa.float64())], ["doc_id", *own, "raw"])

        raw = stats.mapInArrow(score, f"{kinds}raw double").withColumn("bin", bin_of(F.col("raw"), -0.5, 1.5))
        raw = stage(raw, "quality-raw")
        curve = isotonic(raw.join(marks, "doc_id").select("bin", "label"))
        out = raw.select("doc_id", *own, "raw", calibrated(F.col("bin"), curve).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
