"""Near-duplicate documents: an n-gram Jaccard join with adaptive multi-match
prefixes.

A document's set holds its distinct shingles of ``width`` words. All sets are
ordered by one global order, rare shingles first as far as a fixed-size count
sketch can tell. Two sets with Jaccard >= t share at least ``l`` shingles in
their level-``l`` prefixes, the first ``n - ceil(t n) + l`` shingles. Each
document picks its level by estimated cost: a longer prefix reads more
postings, but candidates must then share more of it. A pair is compared at the
lower of the two levels, for which the longer prefix holds what is needed.

Shared prefix shingles also bound the rest: what two sets share beyond their
prefixes is limited by the longer remainder, so a candidate needs as many
shared prefix shingles as make the similarity possible (``_needed``).

Equal sets are one class, joined once. A large group of near copies must not
cost quadratic work, so candidates come in two rounds. First every class is
held against a few classes it shares most prefix shingles with (the first of a
posting list; in long lists, others of a small random block); verified links
form components. Then every class is held against each other component that
any member makes a candidate; against a large component in tiles that report
one link per class, not all pairs. Pairs inside a component are not looked at,
as they cannot change it; every component is exact.

Very frequent shingles are salted by the sketch's estimate before postings are
dealt out. Shingles are 64-bit hashes.

Defined cases: a document of fewer words than ``width`` has its whole sequence
as one shingle; null texts and texts without words have an empty set and link
with nothing; repeated rows are documents of the same class; a null id gets
the least id of its component, or null; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stage
from .components import components
from .suffix_lm import read_words

SKETCH = 1 << 17
LEVELS = 4
BITMAP = 1 << 25  # bits, of the classes whose sets are asked for
LONG_LIST, BLOCK, SALTS = 32, 16, 2  # of round 1
FEW, TILE = 64, 256  # of round 2
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hashed(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from every place of ``words`` on."""
    n = max(0, len(words) - k + 1)
    s = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        s = _mix(s * _PRIME + words[i:i + n])
    return s


class Shingler:
    """The sorted distinct shingle hashes of texts, hashed together."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        words, sizes = read_words(texts)
        every, stops = _hashed(words, self.width), np.cumsum(sizes)
        new = np.ones(len(every), bool)
        spans = list(zip((stops - sizes).tolist(), stops.tolist()))
        for a, b in spans:
            every[a:max(a, b - self.width + 1)].sort()
        new[1:] = every[1:] != every[:-1]
        out = []
        for a, b in spans:
            if b - a < self.width:  # the whole sequence, if any
                out.append(_hashed(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
                continue
            new[a] = True
            out.append(every[a:b - self.width + 1][new[a:b - self.width + 1]])
        return out


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def _sets(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id``, ``class``, ``n`` of every document, and the sketch: how many
    documents hold a shingle of each of ``SKETCH`` hash buckets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(width), np.zeros(SKETCH, np.int64)
        names = ["doc_id", "class", "n", "bucket", "count"]
        for batch in slices(batches, 1):
            cls, n = [], []
            sets = shingles(batch.column(1).to_pylist())
            counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            for s in sets:
                cls.append(_class_of(s) if len(s) else None)
                n.append(len(s))
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), none, none], names)
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), docs_type), none, none, pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names)

    docs_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    both = stage(docs.mapInArrow(read, f"doc_id {kind}, class long, n long, bucket long, count long"), "ngram-sets")
    sketch = np.zeros(SKETCH, np.int64)
    at, counts = both.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("c")).toArrow().columns
    sketch[at.to_numpy()] = counts.to_numpy()
    return both.where("bucket is null").select("doc_id", "class", "n"), sketch


def _frequency(sketch: np.ndarray) -> np.ndarray:
    """Per bucket, how far its count is above what chance alone gives: 0 for
    buckets that may hold rare shingles only, else a power of two."""
    mean = sketch.mean()
    return np.floor(np.log2(1 + np.maximum(0, sketch - mean) / (4 * np.sqrt(mean) + 1))).astype(np.int64)


def prefix(s: np.ndarray, freq: np.ndarray, num: int, den: int, unit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a sorted set: positions of its prefix in the global order, from which
    level each belongs to it, and the level chosen."""
    n = len(s)
    f = freq[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.argsort(f.astype(np.int8), kind="stable")  # equally frequent ones by hash
    need = -(-num * n // den)
    base = n - need + 1
    most = min(LEVELS, need)
    first = f[order[:base + most - 1]]
    others = np.where(first > 0, np.exp2(first) * unit, 0.1)
    reads = np.cumsum(others)[base - 1:]
    level = 1 + int(np.argmin(reads + n * reads / np.arange(1, most + 1)))
    at = order[:base + level - 1]
    return at, np.maximum(0, np.arange(len(at)) - base + 1), level


def _postings(docs: DataFrame, sketch: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """``token``, ``class``, ``n``, ``from_level``, ``level``, ``freq``: prefix
    postings of shingles that at least two classes may share."""
    freq, unit = _frequency(sketch), float(4 * np.sqrt(sketch.mean()) + 1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in slices(batches, 0):
            tokens, owners, metas, done = [], [], [], set()
            for s in shingles(batch.column(0).to_pylist()):
                if not len(s) or (cls := _class_of(s)) in done:
                    continue
                done.add(cls)
                at, since, level = prefix(s, freq, num, den, unit)
                tokens.append(s[at].view(np.int64))
                owners.append(np.full(len(at), cls, np.int64))
                metas.append((((len(s) << 3) + level << 3) + since << 6) + freq[(s[at] & np.uint64(SKETCH - 1)).astype(np.int64)])
            cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, owners, metas)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cat], ["token", "class", "meta"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of postings sorted by token and class: each once, those of shingles
        with one class left out, but for salted ones."""
        held = np.zeros((3, 0), np.int64)
        open_token: int | None = None  # of a group already passed on in part
        last = (None, None)

        def out(rows: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[keep]), pa.int64()) for r in rows], ["token", "class", "meta"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
            if not held.shape[1] and last == (rows[0, 0], rows[1, 0]):
                new[0] = False
            rows = rows[:, new]
            if not rows.shape[1]:
                continue
            token = rows[0]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sizes = np.diff(np.append(first, len(token)))
            multi = np.repeat(sizes > 1, sizes) | (rows[2] & 63 > 0) | (token == open_token if open_token is not None else False)
            last = (token[-1], rows[1, -1])
            if multi[-1]:
                open_token, held = token[-1], np.zeros((3, 0), np.int64)
            else:  # may go on in the next batch
                open_token, held = None, rows[:, -1:]
            yield out(rows, multi)

    sent = docs.select("text").mapInArrow(post, "token long, class long, meta long")
    salt = F.expr("pmod(xxhash64(class), shiftleft(1L, cast(meta & 63 as int)))")
    dealt = sent.withColumn("salt", salt).repartition("token", "salt").drop("salt").sortWithinPartitions("token", "class")
    kept = dealt.mapInArrow(shared, "token long, class long, meta long")
    meta = F.col("meta")
    return stage(kept.select("token", "class", F.shiftright(meta, 12).alias("n"), F.shiftright(meta, 6).bitwiseAND(7).alias("from_level"),
                             F.shiftright(meta, 9).bitwiseAND(7).alias("level")), "ngram-postings")


def _needed(nx: str, ny: str, level: str, num: int, den: int) -> str:
    """Shared shingles two level prefixes need for the similarity: the overlap
    it asks for, less the most that can lie beyond the prefixes."""
    return (f"greatest({level}, cast(ceil({num} * ({nx} + {ny}) / {num + den}) as long) "
            f"- greatest(cast(ceil({num} * {nx} / {den}) as long), cast(ceil({num} * {ny} / {den}) as long)) + {level})")


def _near(posts: DataFrame, num: int, den: int) -> DataFrame:
    """Round 1: a few pairs ``x``, ``y`` per class that are likely similar."""
    first = posts.groupBy("token").agg(F.min(F.struct("class", "n", "level", "from_level")).alias("f"), F.count(F.lit(1)).alias("size"))
    fits = (f"{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) and a.from_level < least(a.level, b.level) "
            "and b.from_level < least(a.level, b.level)")
    a, b = posts.alias("a"), first.select("token", "f.*").alias("b")
    star = a.join(b, F.col("a.token") == F.col("b.token")).where("a.class <> b.class").where(fits)
    # long lists: all pairs of random blocks of about BLOCK classes, over an eighth of the shingles
    long_lists = first.where(F.col("size") > LONG_LIST).where("pmod(xxhash64(token), 8) = 0").select("token", "size")
    blocks = F.expr(f"shiftleft(1L, cast(ceil(log2(size / {BLOCK})) as int))")
    dealt = posts.join(long_lists, "token").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    dealt = stage(dealt.withColumn("block", F.pmod(F.xxhash64("class", "salt"), blocks)).drop("size"), "ngram-blocks")
    a, b = dealt.alias("a"), dealt.alias("b")
    key = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("token", "salt", "block")]
    block = a.join(b, key).where("a.class < b.class").where(fits)
    picked = None
    for pairs, most in ((star, 1), (block, 3)):
        counted = pairs.groupBy(F.col("a.class").alias("x"), F.col("b.class").alias("y")).agg(
            F.count(F.lit(1)).alias("c"), F.min(F.expr(_needed("a.n", "b.n", "least(a.level, b.level)", num, den))).alias("needed"))
        # blocks count an eighth of the shingles: half of what is needed of those
        counted = counted.where("c >= needed" if pairs is star else "16 * c >= needed")
        best = Window.partitionBy("x").orderBy(F.desc("c"), "y")
        top = counted.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).select("x", "y")
        picked = top if picked is None else picked.union(top)
    return picked.distinct()


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """32-bit words of a bitmap of fixed size, from rows ``h``."""
    bits = np.zeros(BITMAP // 32, np.int64)
    word = hashes.selectExpr(f"pmod(h, {BITMAP}L) as b").selectExpr("shiftright(b, 5) as w", "shiftleft(1L, cast(b & 31 as int)) as b")
    at, words = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().columns
    bits[at.to_numpy()] = words.to_numpy()
    return bits.astype("<u4")


def _hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.astype(np.int64) % BITMAP
    return (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def _sets_of(docs: DataFrame, of: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """``class``, ``s`` (its shingles), of the classes ``asked`` for at least.
    ``of``: ``doc_id`` and ``class`` of one document of every class. Two bitmaps,
    of ids and of classes, say which texts to shingle and which sets to send
    on, so no text is shuffled; a chance hit adds a set that nothing asks for."""
    asked = stage(asked.select("class").distinct().join(of, "class"), "ngram-asked")
    ids, classes = _bitmap(asked.select(F.xxhash64("doc_id").alias("h"))), _bitmap(asked.select(F.col("class").alias("h")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, done = Shingler(width), set()
        for batch in batches:
            take = pa.array(np.flatnonzero(_hits(ids, batch.column(1).to_numpy(zero_copy_only=False))), pa.int64())
            for part in slices([pa.RecordBatch.from_arrays([batch.column(0).take(take)], ["text"])], 0):
                sets = shingles(part.column(0).to_pylist())
                cls = np.array([_class_of(s) if len(s) else 0 for s in sets], np.int64)
                on = [i for i in np.flatnonzero(_hits(classes, cls)) if not (cls[i] in done or done.add(cls[i]))]
                yield pa.RecordBatch.from_arrays([pa.array(cls[on], pa.int64()), pa.array([sets[i].view(np.int64) for i in on], pa.list_(pa.int64()))],
                                                 ["class", "s"])

    return stage(docs.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(read, "class long, s array<long>"), "ngram-asked-sets")


def _similar(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (``x``, ``y``) of classes that are similar enough."""
    a, b = sets.select(F.col("class").alias("x"), F.col("s").alias("sx")), sets.select(F.col("class").alias("y"), F.col("s").alias("sy"))
    same = F.size(F.array_intersect("sx", "sy"))
    return (pairs.select("x", "y").join(a, "x").join(b, "y")
            .where(den * same >= num * (F.size("sx") + F.size("sy") - same)).select("x", "y").distinct())


def _tile(num: int, den: int):
    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """For every class on the left one similar class on the right, if any."""
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            size = np.array([len(v) for v in right["s"]])
            token = np.concatenate(right["s"].to_list())
            owner = np.repeat(np.arange(len(size)), size)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            for x, sx in zip(left["class"], left["s"], strict=True):
                sx = np.sort(np.asarray(sx))
                lo, hi = np.searchsorted(token, sx), np.searchsorted(token, sx, side="right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                same = np.bincount(owner[at], minlength=len(size))
                ok = np.flatnonzero(den * same >= num * (len(sx) + size - same))
                if len(ok):
                    out.append((x, right["class"].iloc[ok[0]]))
        return pd.DataFrame(out, columns=["x", "y"]).astype("int64")
    return join


def _across(posts: DataFrame, parts: DataFrame, docs: DataFrame, of: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Round 2: links ``x``, ``y`` between components (``parts``: ``class``,
    ``part``, of all classes), for every class that has one to a component."""
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sized = parts.join(sizes, "part", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    # similar sets share enough of their level-1 prefixes (``_needed``), whatever their levels;
    # shingles further on, the more frequent ones, would only make more pairs
    placed = posts.where("from_level = 0").join(sized, "class")
    mixed = placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
    placed = stage(placed.join(mixed, "token"), "ngram-mixed")
    there = placed.groupBy("token", "part", "members").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    a, b = placed.alias("a"), there.alias("b")
    near = f"{den} * b.hi >= {num} * a.n and {den} * a.n >= {num} * b.lo"
    met = (a.join(b, F.col("a.token") == F.col("b.token")).where("struct(a.members, a.part) < struct(b.members, b.part)").where(near)
           .groupBy(F.col("a.class").alias("x"), F.col("b.part").alias("part"))
           .agg(F.count(F.lit(1)).alias("c"), F.first("a.n").alias("n"), F.first("b.members").alias("members"), F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi")))
    met = met.withColumn("lo", F.greatest("lo", F.ceil(F.lit(num) * F.col("n") / F.lit(den)))).withColumn(
        "hi", F.least("hi", F.floor(F.lit(den) * F.col("n") / F.lit(num)))).where("lo <= hi")
    # the bound has one peak at equal sizes, so its least value is at an end, but for rounding
    fewest = F.least(F.expr(_needed("n", "lo", "1", num, den)), F.expr(_needed("n", "hi", "1", num, den)))
    met = stage(met.where(F.col("c") >= fewest - 1).select("x", "part", "members"), "ngram-met")
    asked = met.select(F.col("x").alias("class")).union(parts.join(met.select("part").distinct(), "part", "left_semi").select("class"))
    sets = _sets_of(docs, of, asked, width)
    few, many = met.where(F.col("members") <= FEW), met.where(F.col("members") > FEW)
    pairs = few.join(parts.withColumnRenamed("class", "y"), "part").select("x", "y")
    one = _similar(pairs, sets, num, den)

    zero, unit = F.lit(0).cast("long"), F.lit(1).cast("long")
    tiles = many.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("ta"), F.ceil(F.max("members") / TILE).alias("tb"))
    tiles = stage(tiles, "ngram-tiles")
    left = (many.select(F.col("x").alias("class"), "part").join(tiles, "part").withColumn("a", F.pmod(F.xxhash64("class"), F.col("ta")))
            .withColumn("b", F.explode(F.sequence(zero, F.col("tb") - unit))))
    right = (parts.join(tiles, "part").withColumn("b", F.pmod(F.xxhash64("class", F.lit(1)), F.col("tb")))
             .withColumn("a", F.explode(F.sequence(zero, F.col("ta") - unit))))
    key = ("part", "a", "b")
    left, right = (x.join(sets, "class").select(*[F.col(c).alias(c) for c in (*key, "class", "s")]).groupBy(*key) for x in (left, right))
    two = left.cogroup(right).applyInPandas(_tile(num, den), "x long, y long")
    return one.union(two)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row; documents
    link when ``den * |intersection| >= num * |union|``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    every, sketch = _sets(rows, width)
    of = stage(every.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id")), "ngram-classes")
    posts = _postings(rows, sketch, width, num, den)

    near = stage(_near(posts, num, den), "ngram-near")
    asked = near.select(F.col("x").alias("class")).union(near.select("y"))
    links = stage(_similar(near, _sets_of(rows, of, asked, width), num, den), "ngram-links")
    joined = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    parts = of.select("class").join(joined.withColumnRenamed("node", "class"), "class", "left").select(
        "class", F.coalesce("component", "class").alias("part"))
    more = stage(_across(posts, stage(parts, "ngram-parts"), rows, of, width, num, den), "ngram-links")
    final = components(links.unionByName(more).select(F.col("x").alias("u"), F.col("y").alias("v")))

    named = of.join(final.withColumnRenamed("node", "class"), "class", "left").withColumn("part", F.coalesce("component", "class"))
    named = stage(named.select("class", "doc_id", "part"), "ngram-named")
    least = named.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    per_class = stage(named.join(least, "part").select("class", "component_id"), "ngram-components")
    return every.join(per_class, "class", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
