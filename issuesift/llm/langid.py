"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text of it. A text is
parsed against an automaton greedily: each phrase is the longest match of the
training text from here on. The language that needs the fewest phrases,
normalised by the logarithm of its training length, wins.

The automata are a bounded fit: per language ``max_docs`` labelled documents in
hash order, a window of at most ``window`` characters of each, ``budget`` bytes
in all. Only that sample goes to the driver and the workers; every text is
parsed whole. Parsing runs in lanes of ``LANE`` bytes in lock step; a phrase
ends with its lane, which costs every language the same.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any training text all are; ties go to the smaller language; one
learned language gets score 1; repeated rows are predicted alike; other
columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LANE = 128
BATCH = 2_000_000  # bytes parsed together, about


def classes() -> np.ndarray:
    """Byte to class: 0 for what parts words, the bytes of letters apart."""
    kind = np.zeros(256, np.int64)
    letters = [*range(ord("a"), ord("z") + 1), *range(128, 256)]
    kind[letters] = np.arange(1, len(letters) + 1)
    return kind


def to_classes(data: bytes) -> np.ndarray:
    """Classes of lower-cased UTF-8, runs of separators as one."""
    kind = classes()[np.frombuffer(data, np.uint8)]
    keep = kind > 0
    keep[1:] |= kind[:-1] > 0
    return kind[keep]


class Automaton:
    """Suffix automaton of a class sequence, as a transition table whose last
    two columns are bytes no training text has, and padding."""

    def __init__(self, text: np.ndarray, width: int):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text.tolist():
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        n = len(nxt)
        table = np.full((n, width + 2), -1, np.int32)
        rows = np.repeat(np.arange(n), [len(d) for d in nxt])
        cols = np.fromiter((c for d in nxt for c in d), np.int64, len(rows))
        table[rows, cols] = np.fromiter((v for d in nxt for v in d.values()), np.int64, len(rows))
        table[:, width + 1] = np.arange(n)
        self.width = width + 2
        # states are kept multiplied by the width, ready to be added to
        self.table = np.where(table < 0, -1, table * self.width).ravel().astype(np.int32)
        self.root = np.maximum(self.table[:self.width], 0)
        self.norm = math.log2(max(len(text), 2))

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases in each column of ``lanes`` (one row per step)."""
        state = np.zeros(lanes.shape[1], np.int32)
        count = np.zeros(lanes.shape[1], np.int32)
        for step in lanes:
            to = self.table.take(state + step)
            miss = to < 0
            count += miss
            state = np.where(miss, self.root.take(step), to)
        return count + 1


class Parser:
    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        texts = {k: to_classes(samples[k]) for k in self.langs}
        used = np.unique(np.concatenate(list(texts.values())))
        self.code = np.full(256, len(used), np.int32)
        self.code[used] = np.arange(len(used))
        self.pad = len(used) + 1
        self.automata = [Automaton(self.code[texts[k]], len(used)) for k in self.langs]

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Normalised phrases of each text (rows) in each language."""
        if len(texts) == 1 and len(texts[0]) > 4 * BATCH:  # bounded memory: costs of parts add up
            return sum(self.costs([texts[0][i:i + BATCH]]) for i in range(0, len(texts[0]), BATCH))
        seqs = [self.code[to_classes(t)] for t in texts]
        n_lanes = [-(-len(s) // LANE) for s in seqs]
        at = np.concatenate([[0], np.cumsum(n_lanes)])
        lanes = np.full((at[-1], LANE), self.pad, np.int32)
        flat = lanes.ravel()
        for s, k in zip(seqs, at, strict=False):
            flat[k * LANE:k * LANE + len(s)] = s
        lanes = np.ascontiguousarray(lanes.T)
        owner = np.repeat(np.arange(len(texts)), n_lanes)
        return np.stack([np.bincount(owner, a.phrases(lanes), len(texts)) * a.norm for a in self.automata], axis=1)


@functools.lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, bytes], ...]) -> Parser:
    return Parser(dict(samples))


def train(docs: DataFrame, max_docs: int = 96, window: int = 2048, budget: int = 49_152) -> dict[str, bytes]:
    """Training text per language, from rows ``doc_id``, ``text``, ``lang``."""
    known = docs.where("lang is not null and doc_id is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    first = (known.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))  # equal texts take one seat
             .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_docs).drop("_r"))
    seat = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - window, F.lit(1))) + 1
    part = F.substring("text", seat.cast("int"), F.lit(window)).alias("text")
    picked = known.select("doc_id", "lang", "h", part).join(stage(first, "lang-sample"), ["doc_id", "lang", "h"])
    out: dict[str, bytes] = {}
    seen: set[tuple[str, int]] = set()
    for r in sorted(picked.select("lang", "h", "doc_id", "text").collect(), key=tuple):
        if (r["lang"], r["h"]) not in seen:  # equal texts teach once
            seen.add((r["lang"], r["h"]))
            out[r["lang"]] = (out.get(r["lang"], b"") + b" " + r["text"].lower().encode())[:budget]
    return {k: v for k, v in out.items() if len(to_classes(v)) > 1}


def predict_language(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", **settings) -> DataFrame:
    """Predict the language of every row; learn from rows where ``may_learn``
    (an expression over ``doc_id``) is true and the language is known. Returns
    ``doc_id``, ``lang_pred`` and ``score`` (0 to 1: how much more phrases the
    second language needs)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    known = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                        F.col(f"`{lang_col}`").cast("string").alias("lang"))
    samples = tuple(sorted(train(known.where(may_learn), **settings).items()))
    if not samples:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(samples)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ok = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            part: list[int] = []
            size = 0
            for n, i in enumerate(ok):
                part.append(i)
                size += len(texts[i])
                if size >= BATCH or n == len(ok) - 1 or len(texts[ok[n + 1]]) >= BATCH:
                    cost = model.costs([texts[j].lower().encode() for j in part])
                    best = cost.argmin(axis=1)
                    low = cost[np.arange(len(part)), best]
                    cost[np.arange(len(part)), best] = np.inf
                    second = cost.min(axis=1)
                    sure = np.where(np.isinf(second), 1.0, second / np.maximum(second + low, 1e-9)) if cost.shape[1] > 1 else np.ones(len(part))
                    for j, b, s in zip(part, best.tolist(), sure.tolist(), strict=True):
                        lang[j], score[j] = model.langs[b], s
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
