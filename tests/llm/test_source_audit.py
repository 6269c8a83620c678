"""The source audit against counts in plain Python."""

from __future__ import annotations

import random
import re
import string
from collections import Counter

from issuesift.llm.source_audit import _count_words, audit_sources, group_terms

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, smoothing=5, top=50):
    docs, uses, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        for t, n in found.items():
            docs.setdefault(lang, Counter())[t] += 1
            uses.setdefault((lang, source), Counter())[t] += n
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, d in docs.get(lang, Counter()).items() if d >= min_docs}
        sources = sorted(s for x, s in groups if x == lang)
        own = {s: {t: uses.get((lang, s), Counter())[t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}

        def share(c):
            n = sum(c.values()) + smoothing * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + smoothing) // n for t in kept}
        p, q = {s: share(own[s]) for s in sources}, share(whole) if kept else {}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, values, limit in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, x[2], -x[0], i) for i, x in enumerate(sorted(values)[:limit], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, source string, rank int")


def test_against_brute_force_in_small_blocks_and_tiles(spark):
    rng = random.Random(5)
    words = ["ab", "Ab", "c-d", "d.", "e1e", "É", "é!", "ñu", "x", "don't", "7", "--", " z", "q\u0000r"]
    rows = []
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(8)))
        rows.append((text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "é", "E", None])))
    rows += [("only here", "fr", "a"), (None, "fr", "b"), ("", "xx", "a")] + [("hot hot cold", "en", "a")] * 200
    for settings in ({"tile_terms": 3, "sources": 2, "block_bytes": 200}, {}):
        got = audit_sources(frame(spark, rows), min_docs=7, **settings)
        assert sorted(map(tuple, got.collect())) == brute(rows, 7)


def test_kept_terms_and_occurrences(spark):
    rows = [("a-a A, b", "en", "s"), ("a", "en", "s"), (None, None, None), ("b " * 50_000, "en", "t"), ("b, b; c c, -c-", "de", "s")]
    for block_bytes in (10, 1_000_000):
        counts, kept, groups = group_terms(frame(spark, rows), 2, block_bytes=block_bytes)
        assert sorted(map(tuple, kept.select("lang", "term", "lang_uses").collect())) == [("en", "a", 4), ("en", "b", 50_001)]
        assert sorted((r.lang, r.source, r.term, r.uses) for r in counts.collect()) == [
            ("en", "s", "a", 4), ("en", "s", "b", 1), ("en", "t", "b", 50_000)]
        assert sorted(map(tuple, groups.collect())) == [("", ""), ("de", "s"), ("en", "s"), ("en", "t")]


def test_top_ranks_ties_and_no_kept_terms(spark):
    rows = [(" ".join(chr(97 + i) for i in range(26)), "en", "a")] * 3 + [("z", "en", "b")] * 3
    got = sorted(map(tuple, audit_sources(frame(spark, rows), min_docs=2, top=4).collect()))
    assert got == brute(rows, 2, top=4)
    assert [r[3] for r in got if r[1:3] == ("a", "term")] == ["a", "b", "c", "d"]
    rare = sorted(map(tuple, audit_sources(frame(spark, rows), min_docs=99).collect()))
    assert rare == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_empty_table(spark):
    assert audit_sources(frame(spark, [])).collect() == []
    assert audit_sources(frame(spark, [(None, None, None)])).collect() == []


def test_chunks_of_a_slice_are_counted_together():
    rng = random.Random(3)
    letters = [chr(b).encode() for b in range(128)] + ["é".encode(), "\u3000".encode(), "\x85".encode(), b" ", b" ", b"\n"]
    texts = [b"".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)] + [b"", b" \t", b"aB Ab ab", b""]
    for given in (texts, [b""], [b" ", b""], [b"a"], [b"", b"a A"]):
        words, chunks, uses, sizes = _count_words(given)
        assert len(set(words.to_pylist())) == len(words)
        found = zip(words.take(chunks).to_pylist(), uses.tolist())
        for text, size in zip(given, sizes.tolist()):
            assert dict(next(found) for _ in range(size)) == Counter(text.lower().split())
        assert next(found, None) is None
