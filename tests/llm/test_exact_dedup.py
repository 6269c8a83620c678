"""Exact deduplication against a dictionary of normalised texts."""

from __future__ import annotations

import hashlib
import random
import string

from issuesift.llm.exact_dedup import HEAD, exact_duplicates

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    return groups


def check(spark, rows, id_type="long", digest=True):
    got = exact_duplicates(spark.createDataFrame(rows, f"doc_id {id_type}, text string"), digest=digest).collect()
    groups = expected(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        if r.text_sha256 is None:
            assert not digest and (r.keep_id, r.group_size, r.kept) == (r.doc_id, 1, True)
            continue
        ids = by_hash[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.doc_id in ids and r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        kept.setdefault(r.text_sha256, []).extend([r.doc_id] if r.kept else [])
    if digest:
        assert len(kept) == len(groups)
    assert all(len(k) == 1 for k in kept.values())
    assert all(k[0] == max((i for i in by_hash[h] if i is not None), default=None) for h, k in kept.items())
    return got


def test_cases(spark):
    long = "word " * HEAD
    rows = [(1, None), (2, ""), (3, "Ab c"), (4, "aB C"), (5, "ab d"), (6, long + "x"), (7, long + "y"), (8, long + "X"),
            (9, "É"), (10, "é"), (None, "ab c"), (None, "only"), (None, "only"), (11, "twice"), (11, "TWICE"), (12, "alone here"),
            (13, "a\u0000b"), (14, "A\u0000b"), (15, " \n")]
    got = check(spark, rows)
    assert sum(r.kept for r in got) == 12
    check(spark, rows, digest=False)


def test_hash_only_of_shared_texts(spark):
    rows = [(i, "x" * i) for i in range(1, 200)] + [(1000, "x" * 7)]
    got = check(spark, rows, digest=False)
    hashed = [r.doc_id for r in got if r.text_sha256]
    assert {7, 1000} <= set(hashed) and len(hashed) < 20  # the bitmap admits few others


def test_random_texts_and_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("aAbBé ") for _ in range(rng.randrange(4)))) for i in range(1500)]
    rows += [(10_000 + i, "the same long text " * 20) for i in range(700)]
    rng.shuffle(rows)
    check(spark, rows)
    check(spark, [(str(i), t) for i, t in rows], "string", digest=False)


def test_empty_table_and_other_columns(spark):
    assert check(spark, []) == []
    df = spark.createDataFrame([(1, "a", 5, "x", 2, True), (2, "A", 6, "y", 3, False)],
                               "doc_id long, text string, length int, head string, row int, maybe boolean")
    got = exact_duplicates(df.withColumnRenamed("doc_id", "key"), id_col="key", digest=True)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [(1, 2, 2, False), (2, 2, 2, True)]
