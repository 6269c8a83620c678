import pytest

from issuesift.llm import mixing
from tests.llm.helpers import DOCS, documents


def water_fill(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, budget * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def corpus(spark, n=400):
    rows = [(i, " ".join(f"w{j}" for j in range((i * 37) % 300)), "en",
             None if i % 17 == 0 else "big" if i % 3 == 0 else f"s{i % 5}", 0) for i in range(n)]
    rows += [(1000, None, "en", "big", 0), (1001, "", "en", "empty", 0), (5, rows[5][1], "en", rows[5][3], 0)]
    return spark.createDataFrame(rows, DOCS)


def test_targets_words_taken_and_caps(spark):
    got = mixing.mix(corpus(spark), block=16).taken().collect()
    sizes, target, taken = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size
    assert len(got) == 403
    assert target == pytest.approx(water_fill(sizes))
    for s in sizes:
        assert taken[s] == int(target[s] + 1e-9)
    assert all(r.source_size == sizes[r.source] for r in got)


def test_the_mix_does_not_depend_on_partitioning(spark):
    docs = corpus(spark)
    a, b = (sorted(map(str, mixing.mix(d, block=16).taken().collect())) for d in (docs, docs.repartition(7, "n_chars", "text")))
    assert a == b


def test_slots_follow_the_shares_closely(spark):
    m = mixing.mix(corpus(spark), block=8)
    order = sorted((r.slot, r.source or "") for r in m.slots.select("slot", "source").distinct().collect())
    share = {}
    for _, s in order:
        share[s] = share.get(s, 0) + 1
    seen = dict.fromkeys(share, 0)
    for i, (_, s) in enumerate(order[:len(order) * 9 // 10], 1):
        seen[s] += 1
        assert abs(seen[s] - i * share[s] / len(order)) < 16


def test_mixed_documents_hold_the_words_taken(spark):
    docs = corpus(spark).withColumn("size", mixing.F.lit(1)).withColumn("copy", mixing.F.lit(2)).withColumn("_take", mixing.F.lit(3))
    out = mixing.mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    want = {}
    for r in mixing.mix(docs, block=16).taken().collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    empty = documents(spark, [])
    assert mixing.mix(empty).taken().count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    blank = documents(spark, [(1, None, "en", None, 0), (2, " \t", None, "a", 0)])
    assert [(r.size, r.taken) for r in mixing.mix(blank).taken().collect()] == [(0, 0), (0, 0)]
