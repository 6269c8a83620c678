import random

import numpy as np
from pyspark.sql import functions as F

from issuesift.llm import ngram_join as nj
from issuesift.llm.components import components
from tests.llm.helpers import documents


def shingles(text):
    w = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    near = [[m for m in range(len(rows)) if sets[n] and sets[m] and 100 * len(sets[n] & sets[m]) >= 75 * len(sets[n] | sets[m])] for n in range(len(rows))]
    out = []
    for n, r in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        out.append((r[0], len(sets[n]), min(ids) if ids else None))
    return sorted(map(str, out))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(words) for _ in range(60)]
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        if rng.random() < 0.4:
            text += passage
        rows.append(text)
        for _ in range(rng.choice([0, 0, 1, 4, 12])):  # copies, some beyond the similarity
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(text)
    rng.shuffle(rows)
    return [(i * 7 % 1009, " ".join(t) if i % 3 else "\t" + "  ".join(t).upper(), "en", "s", 0) for i, t in enumerate(rows)]


def test_components_against_brute_force(spark):
    rows = corpus(1) + corpus(2)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    rows += [(5000, None, None, None, 0), (5001, "", None, None, 0), (5002, "a b", None, None, 0), (5003, "A  B", None, None, 0), (5004, "a b c d", None, None, 0),
             (3, rows[3][1], None, None, 0), (None, rows[4][1], None, None, 0), (None, "only here", None, None, 0)]
    rows += [(6000 + i, rows[0][1], None, None, 0) for i in range(60)]
    docs = documents(spark, rows).withColumn("class", F.lit(1)).withColumn("token", F.lit(1)).withColumn("n", F.lit(0))
    got = sorted(str(tuple(r)) for r in nj.near_duplicates(docs.repartition(5)).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert nj.near_duplicates(documents(spark, [])).count() == 0
    got = nj.near_duplicates(documents(spark, [(1, None, None, None, 0), (2, " ", None, None, 0)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2)]


def test_prefixes_share_enough_at_every_pair_of_levels(monkeypatch):
    rng = np.random.default_rng(4)
    freq = rng.integers(0, 4, nj.SKETCH) * (rng.random(nj.SKETCH) < 0.2)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = rng.integers(0, 1 << 60, n).astype(np.uint64)
        y = np.concatenate([x[rng.random(n) < 0.93], rng.integers(0, 1 << 60, int(rng.integers(0, 5))).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if not len(y) or 100 * len(np.intersect1d(x, y)) < 75 * len(np.union1d(x, y)):
            continue
        for forced in range(1, nj.LEVELS + 1):
            (ax, sx, lx), (ay, sy, ly) = (nj.prefix(s, freq, 75, 100, 10.0) for s in (x, y))
            m = min(lx, ly)
            shared = np.intersect1d(x[ax[sx < m]], y[ay[sy < m]])
            assert len(shared) >= m
            monkeypatch.setattr(nj, "LEVELS", forced)
        monkeypatch.undo()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {200: 199}


def test_texts_are_shingled_together(monkeypatch):
    read, calls = nj.read_words, []
    monkeypatch.setattr(nj, "read_words", lambda texts: calls.append(len(texts)) or read(texts))
    texts = [r[1] for r in corpus(3)] + [None, "", " \t", "a b", "A  B", "a b c d e", "x " * 40, "end"]
    got = nj.Shingler(5)(texts)
    assert calls == [len(texts)]
    want = [shingles(x) for x in texts]
    for s in got:
        assert s.dtype == np.uint64 and (s[1:] > s[:-1]).all()
    assert [len(s) for s in got] == [len(s) for s in want]
    assert [[len(np.intersect1d(x, y)) for y in got] for x in got[-30:]] == [[len(x & y) for y in want] for x in want[-30:]]


def test_shingles_beyond_the_first_level_make_no_pairs_between_components(spark, monkeypatch):
    staged, stage = {}, nj.stage

    def counted(df, name, *codec):
        out = stage(df, name, *codec)
        staged[name] = out.count()
        return out

    monkeypatch.setattr(nj, "stage", counted)
    rows = [(1, c, 20, 1, 2) for c in range(30)] + [(100 + c // 2, c, 20, 0, 2) for c in range(2)]
    posts = spark.createDataFrame(rows, "token long, class long, n long, from_level long, level long")
    parts = spark.createDataFrame([(c, c) for c in range(30)], "class long, part long")
    docs = documents(spark, [(c, f"text {c}", None, None, 0) for c in range(30)]).select("doc_id", "text")
    of = spark.createDataFrame([(c, c) for c in range(30)], "class long, doc_id long")
    assert nj._across(posts, parts, docs, of, 5, 75, 100).count() == 0
    assert staged["ngram-mixed"] == 2  # the level-1 shingle of two classes, not the one of 30
