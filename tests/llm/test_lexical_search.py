"""Ranked lexical search against scores of every document, in plain Python."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from issuesift.llm.lexical_search import Shard, ranked_search, split_terms

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(items, docs, k):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in terms:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def run(spark, items, docs, **settings):
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int")
    return sorted(map(tuple, ranked_search(i, d, **settings).collect()), key=str)


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Übung", "ñ", "A1"]
    return [(i, " ".join(words[int(rng.paretovariate(0.6)) % len(words)] for _ in range(rng.randrange(30)))) for i in range(n)]


@pytest.mark.parametrize("query_terms", [65_536, 20])
def test_against_brute_force(spark, query_terms):
    rng = random.Random(1)
    docs = corpus(rng, 700) + [(None, "w3 w3"), (5, "w7, W7; übung Übung"), (5, None), (6, "--- "), (7, "w1-W1_w2"), (9, "w5 " * 40_000)]
    docs += [(1000 + i, "w2 w40 same text") for i in range(200)]
    items = [(100 + i, t) for i, t in corpus(rng, 12)] + [(1, None), (2, "nowhere"), (3, "W40 w40 same"), (3, "W40 w40 same")]
    assert run(spark, items, docs, k=7, query_terms=query_terms) == brute(items, docs, 7)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, "a")], [(1, None), (2, "  ")]) == []
    assert run(spark, [(1, "a b")], [(1, "b")]) == brute([(1, "a b")], [(1, "b")], 20)  # one document: weight floor(1000 ln(4/3))


def test_terms():
    text = "Ab-c9_D é\u0000x\ty" + "Z"
    assert [t.decode() for t in split_terms(text.encode())] == TERM.findall(text.translate(LOWER))


@pytest.mark.parametrize("seed", range(8))
def test_best_positions_stop_early_and_miss_nothing(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms, k = 2000, 12, 5
    dense = np.where(rng.random((n_terms, n_docs)) < 0.4, (1000 * rng.random((n_terms, n_docs)) ** 6).astype(int) + 1, 0)
    if seed % 2:  # correlated lists, many equal impacts
        dense = np.where(dense > 0, (dense.max(axis=0) // 50 + 1)[None, :], 0)
    term, doc = np.nonzero(dense)
    shard = Shard(n_docs, n_terms, term, doc, dense[term, doc])
    terms, weight = np.array([0, 3, 7]), np.array([5, 2, 1])
    scores = weight @ dense[terms]
    kth = np.sort(scores)[-k]
    found, got, read = shard.search(terms, weight, k)
    assert (got == scores[found]).all() and set(np.flatnonzero(scores >= max(1, kth))) <= set(found)
    last_read = threshold_reads(dense[terms], weight, scores, k)
    assert read <= last_read
    found, got, read_above = shard.search(terms, weight, k, above=int(scores.max()))
    assert set(found) == set(np.flatnonzero(scores == scores.max())) and read_above <= read
    assert shard.search(terms, weight, k, above=int(scores.max()) * 10)[2] == 0


def threshold_reads(dense, weight, scores, k):
    """Positions read when the bound is that of the last-read positions, in the same rounds."""
    order = np.argsort(-dense, axis=1, kind="stable")
    seen, upto, step = set(), 0, 16
    size = (dense > 0).sum(axis=1)
    while True:
        for t in range(len(dense)):
            seen |= set(order[t][upto:min(upto + step, size[t])].tolist())
        upto += step
        bound = sum(w * dense[t][order[t][upto - 1]] if upto <= size[t] else 0 for t, w in enumerate(weight))
        best = np.sort(scores[list(seen)])[::-1]
        if upto >= size.max() or len(best) >= k and bound < best[k - 1]:
            return int(np.minimum(size, upto).sum())
        step *= 2
