"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic
text. A text is read through windows of one word each; a window's distance is
its compressed length under the ordinary dictionary less that under the toxic
one, which has the ordinary one's content behind its own, so that ordinary
words compress alike and only toxic content tells. A text's raw score adds up what windows gain beyond a threshold of one
byte, per square root of its windows, and an isotonic curve fitted on all
labelled training rows turns it into a probability.

Only a few words of a toxic text are toxic, so the toxic dictionary is trained
on those windows of toxic texts that ordinary texts hardly have: present in a
minimum share of the toxic texts and ``CONTRAST`` times as frequent there.
The dictionaries are trained on a bounded sample of labelled rows
(``max_toxic``, ``max_ordinary`` documents by hash order); the curve on all.

Defined cases: null and empty texts have no windows and a raw score of 0;
repeated labels of one document count as toxic if any is; null labels are
skipped; without toxic or without ordinary training rows every score is 0.0;
repeated rows are scored alike; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import bin_of, calibrated, isotonic
from .common import slices, stage

LETTERS = re.compile(r"[^\W\d_]+")
#: Follows every window, as zstandard finds no match in the last eight bytes.
PAD = b"0123456789abcdefghijklmnopqrstuv"
CONTRAST = 20.0
TOXIC_DICT, ORDINARY_DICT = 2048, 65536
RAW_MAX = 8.0
CACHE = 300_000


def windows(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves
        return b"".join(samples)[-size:]


class Distance:
    """Distance of a window between two dictionaries; remembers windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        def compressor(content: bytes):
            content += PAD
            params = zstandard.ZstdCompressionParameters.from_level(
                9, source_size=64, dict_size=len(content), min_match=3, write_content_size=False,
                write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(compression_params=params, dict_data=kept)

        self.ordinary, self.toxic, self.seen = compressor(ordinary), compressor(toxic + ordinary), {}

    def __call__(self, word: str) -> int:
        d = self.seen.get(word)
        if d is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            w = b" " + word.encode() + b" " + PAD
            gain = len(self.ordinary.compress(w)) - len(self.toxic.compress(w)) - 1
            d = min(max(gain, 0), 8)
            if len(word) < 64:
                self.seen[word] = d
        return d


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id``, ``label``: one 0/1 label per document."""
    return (labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def train(docs: DataFrame, marks: DataFrame, max_toxic: int = 3000, max_ordinary: int = 6000) -> tuple[bytes, bytes] | None:
    """The ordinary and the toxic dictionary, from ``docs`` (``doc_id``,
    ``text``) with ``marks`` (``doc_id``, ``label``)."""
    order = F.xxhash64("doc_id", F.lit(3))
    pick = [marks.where(f"label = {k}").orderBy(order, "doc_id").limit(n) for k, n in ((1, max_toxic), (0, max_ordinary))]
    sample = docs.join(stage(pick[0].unionByName(pick[1]), "toxicity-sample"), "doc_id").select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            held: dict[tuple[str, int], list[int]] = {}
            ordinary: list[str] = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = windows(text)
                for w, c in Counter(w for w in ws if len(w) <= 40).items():
                    at = held.setdefault((w, label), [0, 0])
                    at[0] += 1
                    at[1] += c
                if not label and ws:
                    step = max(8, len(ws) // 24)
                    ordinary += [" ".join(ws[i:i + 8])[:400] for i in range(0, len(ws), step)][:25]
            words = [*(w for w, _ in held), *ordinary]
            kinds = [*(k for _, k in held), *[2] * len(ordinary)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(kinds, pa.int32()),
                 pa.array([*(v[0] for v in held.values()), *[1] * len(ordinary)], pa.int64()),
                 pa.array([*(v[1] for v in held.values()), *[1] * len(ordinary)], pa.int64())],
                ["word", "kind", "docs", "uses"])

    counted = stage(sample.mapInArrow(count, "word string, kind int, docs long, uses long"), "toxicity-counts")
    n = sample.groupBy("label").count().collect()
    n_toxic, n_ordinary = (next((r["count"] for r in n if r["label"] == k), 0) for k in (1, 0))
    if not n_toxic or not n_ordinary:
        return None
    by = counted.where("kind < 2").groupBy("word").agg(
        F.sum(F.when(F.col("kind") == 1, F.col("docs")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("kind") == 0, F.col("docs")).otherwise(0)).alias("o"),
        F.sum(F.when(F.col("kind") == 1, F.col("uses")).otherwise(0)).alias("uses"))
    telling = (by.where((F.col("t") >= max(3, 0.0045 * n_toxic))
                        & (F.col("t") / n_toxic >= CONTRAST * (F.col("o") + 0.5) / n_ordinary))
               .orderBy(F.desc("t"), "word").limit(4000).collect())
    rng = random.Random(1)
    scale = min(1.0, 200_000 / max(1, sum(r["uses"] for r in telling)))
    toxic = [r["word"] for r in telling for _ in range(max(1, int(r["uses"] * scale)))]
    rng.shuffle(toxic)
    ordinary = [r["word"] for r in counted.where("kind = 2").orderBy("word").limit(150_000).collect()]
    rng.shuffle(ordinary)
    return (_dictionary(ORDINARY_DICT, [f" {w} ".encode() for w in ordinary]),
            _dictionary(TOXIC_DICT, [f" {' '.join(toxic[i:i + 6])} ".encode() for i in range(0, len(toxic), 6)]))


def raw_scores(docs: DataFrame, model: tuple[bytes, bytes], id_col: str = "doc_id", text_col: str = "text",
               row_col: str | None = None) -> DataFrame:
    """``doc_id``, ``raw``: the uncalibrated score of every row; and ``row``, the
    value of ``row_col``, if one is named."""
    own = [] if row_col is None else ["row"]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *(F.col(f"`{row_col}`").alias(c) for c in own))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*model)
        for batch in slices(batches, 1):
            raw = []
            for text in batch.column(1).to_pylist():
                ws = windows(text)
                raw.append(sum(map(distance, ws)) / (len(ws) + 1) ** 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(raw, pa.float64())],
                                             ["doc_id", *own, "raw"])

    return rows.mapInArrow(score, f"{kinds}raw double")


def score_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "toxic", row_col: str | None = None) -> DataFrame:
    """Score every row of ``docs``; learn from labels of rows where
    ``may_learn`` (an expression over ``doc_id``) is true. Returns ``doc_id``,
    ``raw``, ``score`` (0 to 1) and ``predicted`` (score >= 0.5); and ``row``,
    the value of ``row_col``, if one is named."""
    marks = labelled(labels, label_col).where(may_learn)
    own = [] if row_col is None else ["row"]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *(F.col(f"`{row_col}`").alias(c) for c in own))
    model = train(rows, marks)
    if model is None:
        out = rows.select("doc_id", *own, F.lit(0.0).alias("raw"), F.lit(0.0).alias("score"))
    else:
        raw = stage(raw_scores(rows, model, row_col=own[0] if own else None), "toxicity-raw").withColumn("bin", bin_of(F.col("raw"), 0.0, RAW_MAX))
        curve = isotonic(raw.join(marks, "doc_id").select("bin", "label"))
        out = raw.select("doc_id", *own, "raw", calibrated(F.col("bin"), curve).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
