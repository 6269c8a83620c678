import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from issuesift.llm import suffix_lm
from issuesift.llm.common import held_out, split_words
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents


def learn():
    return ~held_out(F.col("doc_id"), 5, 1)


def check_base(got, rows):
    learned = [(i, t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for _, t in learned for w in [*split_words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, t in rows:
        tokens = [*split_words(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.setdefault(i, []).append((len(tokens), sum(counts[w] > 0 for w in tokens), n, pytest.approx(base)))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) in want[r.doc_id]
        assert r.score <= 1e-9


def test_whole_table_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = suffix_lm.score_texts(docs, learn()).withColumn("out", ~learn()).collect()
    check_base(got, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.score - r.base_score for r in got) > 0
    assert sum(r.score - r.base_score for r in got if r.out) > 0


def test_edge_cases(spark):
    rows = [(i, "The cat sat on the mat . " * (i % 5) + ("rare%d" % i), "en", "s", 0) for i in range(40)]
    rows += [(100, None, None, None, 0), (101, "", None, None, 0), (5, rows[5][1], None, None, 0), (None, "the cat", None, None, 0),
             (102, "x" * 100_000, None, None, 0), (103, "unseen words é", None, None, 0)]
    docs = documents(spark, rows).withColumn("word", F.lit("w")).withColumn("c", F.lit(1))
    check_base(suffix_lm.score_texts(docs, learn()).collect(), [(r[0], r[1]) for r in rows])
    assert suffix_lm.score_texts(documents(spark, []), learn()).count() == 0
    alone = suffix_lm.score_texts(docs, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == pytest.approx(0) and r.score == pytest.approx(0) for r in alone)


def test_every_state_is_a_distribution(spark):
    text = ["a b a b a c", "b a b a b", "a b c a b c a b c"] * 30 + ["z1", "z2 a b"]
    docs = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(text)])
    tree, rarer = suffix_lm.train(docs.select("doc_id", "text"))
    assert tree.root.sum() == pytest.approx(1)
    assert {r.word for r in rarer.collect()} == {"z1", "z2"}
    n = tree.n_symbols
    assert (tree.one.rest < 1).any()
    for older in range(n):
        for newer in range(n):
            total = sum(10 ** tree.logs(np.array([len(tree.words), older, newer, s]))[-1] for s in range(n))
            assert total == pytest.approx(1)


def test_slices_cover_the_batch():
    import pyarrow as pa

    from issuesift.llm.common import slices

    texts = ["a" * 10, None, "b" * 100, "", "c" * 5, "d" * 5, "é" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    for size in (1, 9, 12, 1000):
        parts = list(slices([batch, batch.slice(0, 0)], 1, size))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= size for p in parts)


def brute_scores(texts):
    """Scores by a tree of tuples, and the symbols of its longest context."""
    docs = [["<", *split_words(t), ">"] for t in texts]
    uni = Counter(w for d in docs for w in d[1:])
    total = sum(uni.values()) + 0.5 * (len(uni) + 1)
    p = {(w,): (c + 0.5) / total for w, c in uni.items()}
    rests, k = {}, 1
    while True:
        grams = Counter(tuple(d[i:i + k + 1]) for d in docs for i in range(len(d) - k))
        totals = Counter(tuple(d[i:i + k]) for d in docs for i in range(len(d) - k))
        moves = {}
        for g, c in grams.items():
            if c >= 3 and (k == 1 or g[1:-1] in rests):
                moves.setdefault(g[:-1], {})[g] = c
        passed = False
        for g, nexts in moves.items():
            whole = totals[g] + 8.0
            rest = (whole - sum(nexts.values())) / whole
            now = {x: c / whole + rest * p[x[1:]] for x, c in nexts.items()}
            gain = sum(c * math.log(now[x] / p[x[1:]]) for x, c in nexts.items()) + (totals[g] - sum(nexts.values())) * math.log(rest)
            if gain >= 10.0:
                passed = True
                rests[g] = rest
                p.update(now)
        if not passed:
            break
        k += 1
    out = []
    for d in docs:
        score = 0.0
        for i in range(1, len(d)):
            q = p[(d[i],)]
            for m in range(1, i + 1):
                g = tuple(d[i - m:i])
                if g not in rests:
                    break
                q = p.get((*g, d[i]), rests[g] * q)
            score += math.log10(q)
        out.append(score)
    return out, k - 1


def test_variable_contexts_against_brute_force_with_and_without_joins(spark, monkeypatch):
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 60)):
            seed = zlib.crc32(" ".join(words[-rng.choice([2, 3, 4]):]).encode())
            words.append(f"w{seed % 5}" if rng.random() < 0.9 else f"r{rng.randint(0, 60)}")
        texts.append(" ".join(words))
    texts += ["one two three four five six seven"] * 20 + ["zero two three four five six eight"] * 20
    want, longest = brute_scores(texts)
    assert longest > 2
    docs = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    for hot in (suffix_lm.HOT, 40, 0):
        monkeypatch.setattr(suffix_lm, "HOT", hot)
        got = {r.doc_id: r.score for r in suffix_lm.score_texts(docs, F.lit(True)).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want)


def test_limits_do_not_grow_with_the_input(spark):
    rows = [(i, "filler " * 60_000, None, None, 0) for i in range(100)] + [(200 + i, "left right", None, None, 0) for i in range(5)]
    got = {r.doc_id: r for r in suffix_lm.score_texts(documents(spark, rows), F.lit(True)).collect()}
    assert got[200].train_tokens > 6_000_000
    assert got[200].score > got[200].base_score + 6


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    data = b" ab  c\td\x0be" + b"x" * 300 + b" ab " + b"y" * 40
    hashes, starts = suffix_lm.hash_words(data)
    words = data.split()
    assert [data[a:].split()[0] for a in starts] == words and len(set(hashes.tolist())) == len(set(words))
    for piece in (1, 7, 64):
        monkeypatch.setattr(suffix_lm, "PIECE", piece)
        assert suffix_lm.hash_words(data)[0].tolist() == hashes.tolist()


def test_grams_are_held_once_when_they_are_sent():
    rng = np.random.default_rng(5)
    for n in (2, 3):
        keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
        table = np.column_stack([suffix_lm._mix(keys), keys, keys][:n])
        picks = [rng.integers(0, len(keys), 25_000) for _ in range(8)]
        held = [(table[x], np.full(len(x), 2)) for x in picks]
        size = sum(a.nbytes + c.nbytes for a, c in held)
        tracemalloc.start()
        sent = suffix_lm._sent(held, 4)
        batches = [next(sent)]
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        batches += sent
        assert not held and most < 2.5 * size
        got = pa.Table.from_batches(batches)
        grams, counts = suffix_lm.unpacked(got.column("grams"), "<u8").reshape(-1, n), suffix_lm.unpacked(got.column("counts"), "<i8")
        want = Counter(np.concatenate(picks).tolist())
        place = {k: i for i, k in enumerate(keys.tolist())}
        assert {place[k]: c for k, c in zip(grams[:, 1].tolist(), counts.tolist())} == {i: 2 * c for i, c in want.items()}


def test_what_a_task_holds_does_not_change_scores(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{zlib.crc32(str(i // 3 + k // 4).encode()) % 9}" for k in range(rng.randint(0, 40))) for i in range(200)]
    docs = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    want = {r.doc_id: r.score for r in suffix_lm.score_texts(docs, F.lit(True)).collect()}
    monkeypatch.setattr(suffix_lm, "HELD", 3)
    got = {r.doc_id: r.score for r in suffix_lm.score_texts(docs, F.lit(True)).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([want[i] for i in range(len(texts))])
