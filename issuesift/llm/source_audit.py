"""Source divergence audit: how the terms of each source differ from those of
the other sources of its language and of the language as a whole.

Chunk factorisation: a task counts the white-space chunks of each document, a
slice of documents at once, and sums them over a block of documents, so what is shuffled, by chunk, is one row
for each block, distinct chunk and language, with the occurrences per group
packed; no chunk has more rows than there are blocks and languages. All rows of
a chunk meet in order; its terms are cut once and joined to them. A term with a
chunk in ``min_docs`` documents of a block and language is kept for certain;
one whose chunks together have fewer is not. For those in between the distinct
documents are counted one by one (a chunk that is rare in its block carries
the numbers of its documents). Which terms can reach the bound is told by sums
per hash, so rare terms leave before their strings are shuffled.

Distances of sources are sums over all kept terms of a language; terms are
dealt into tiles by hash, and a tile compares two blocks of at most about
``SOURCES`` sources as dense matrices. A source without a term has the share of
the count 0 there.

Defined cases: null text, lang and source are empty strings; groups without
terms, and languages without kept terms, occur with distances 0; repeated rows
are documents of their own; an empty table gives no rows; other columns are not
read. A very long text is a block of its own. Ties rank by the item's bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, admit, slices, stage

#: Bytes of text in a block, and in a slice of it whose chunks are found together.
BLOCK, SLICE = 32_000_000, 2_000_000
#: Kept terms in a tile, sources in a block of sources.
TILE, SOURCES = 2048, 256
#: Up to so many (language, source) groups reach the counts by broadcast.
BROADCAST_GROUPS = 50_000
SCALE = 1_000_000_000
#: All but letters (of ASCII, and all beyond ASCII) part the terms of a chunk.
_PART = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTED = pa.schema([("chunk", pa.binary()), ("lang", pa.string()), ("docs", pa.int64()), ("members", pa.binary()), ("packed", pa.binary())])
_CUT = pa.schema([*list(_COUNTED)[1:], ("times", pa.int64()), ("term", pa.string())])
_UNPACKED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("grp", pa.int64()), ("uses", pa.int64())])
#: Occurrences in a group, named by a hash.
_USE = np.dtype([("grp", "<i8"), ("uses", "<i8")])


def _schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int64(): 'long'}).get(f.type, str(f.type))}" for f in schema)


def _binary(parts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values of ``lengths`` bytes, cut from ``parts`` one after the other."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(parts))])


def _count_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct chunks of all texts; by text and chunk the chunk's place
    there and its occurrences; and how many such rows each text has."""
    data = b"\n".join(texts).translate(_LOWER)
    a = np.frombuffer(data, np.uint8)
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = (a != 32) & ((a - np.uint8(9)) > 4)  # all but white space of ASCII
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    first, length = edge[::2], edge[1::2] - edge[::2]
    found = _binary(a[letter[1:-1]], length).dictionary_encode()
    n = max(1, len(found.dictionary))
    stop = np.cumsum([len(x) + 1 for x in texts])
    key = np.repeat(np.arange(len(texts)) * n, np.diff(np.searchsorted(first, stop), prepend=0)) + found.indices.to_numpy()
    key.sort()
    start = np.flatnonzero(np.diff(key, prepend=-1))
    uses, key = np.diff(start, append=len(key)), key[start]
    return found.dictionary, (key % n).astype(np.int32), uses.astype(np.int32), np.bincount(key // n, minlength=len(texts))


class _Block:
    """Documents whose chunks are counted together."""

    def __init__(self) -> None:
        self.size, self.found, self.groups = 0, 0, {}
        self.group, self.number, self.words, self.chunks, self.uses, self.sizes = [], [], [], [], [], []

    def add(self, number: int, langs: list[str], groups: list[int], texts: list[bytes]) -> None:
        words, chunks, uses, sizes = _count_words(texts)
        self.size += sum(map(len, texts))
        self.group += [self.groups.setdefault(x, len(self.groups)) for x in zip(langs, groups)]
        self.number += range(number, number + len(texts))
        self.words.append(words)
        self.chunks.append(chunks + np.int32(self.found))
        self.uses.append(uses)
        self.sizes.append(sizes)
        self.found += len(words)

    def counted(self, min_docs: int) -> Iterator[pa.RecordBatch]:
        """A row for each chunk and language: documents, their numbers (8 bytes
        each) unless there are ``min_docs``, and the occurrences per group."""
        words = pa.concat_arrays(self.words).dictionary_encode()
        size, uses = np.concatenate(self.sizes), np.concatenate(self.uses)
        chunk = words.indices.to_numpy()[np.concatenate(self.chunks)]
        words = words.dictionary
        self.words, self.chunks, self.uses = [], [], []
        if not len(chunk):
            return
        n = len(self.groups)
        named = sorted(self.groups)  # groups of a language stand together
        place = np.empty(n, np.int64)
        place[[self.groups[g] for g in named]] = np.arange(n)
        langs = sorted({g[0] for g in named})
        lang_of = np.array([langs.index(g[0]) for g in named])
        key = chunk.astype(np.int64) * n + np.repeat(place[self.group], size)
        del chunk
        by = np.argsort(key)
        key = key[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, docs = key[first], np.diff(first, append=len(key))
        packed = np.empty(len(key), _USE)
        packed["grp"], packed["uses"] = np.array([g[1] for g in named], np.int64)[key % n], np.add.reduceat(uses[by], first, dtype=np.int64)
        row = key // n * len(langs) + lang_of[key % n]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        docs = np.add.reduceat(docs, start)
        few = docs < min_docs
        members = np.repeat(np.array(self.number, ">i8"), size)[by][np.repeat(few, docs)]
        yield from pa.Table.from_arrays(
            [words.take(pa.array(row[start] // len(langs))), pa.array(langs, pa.string()).take(pa.array(row[start] % len(langs))),
             pa.array(docs), _binary(members, np.where(few, 8 * docs, 0)), _binary(packed, _USE.itemsize * np.diff(start, append=len(row)))],
            schema=_COUNTED).to_batches(50_000)


def _count_chunks(min_docs: int, block_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Block(), TaskContext.get().partitionId() << 40
        for batch in slices(batches, 2, min(SLICE, block_bytes)):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            if block.group and block.size + sum(map(len, texts)) > block_bytes:
                yield from block.counted(min_docs)
                block = _Block()
            block.add(number, batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts)
            number += len(texts)
        if block.group:
            yield from block.counted(min_docs)

    return count


def _cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their chunk, each once for every term of the chunk with
    the term's ``times`` in it. A chunk is cut where its first row stands."""
    chunk, terms = None, {}
    for batch in batches:
        codes = pc.run_end_encode(batch.column(0))
        rows, found, times, at = [], [], [], 0
        for c, end in zip(codes.values.to_pylist(), codes.run_ends.to_pylist()):
            if c != chunk:
                chunk, terms = c, Counter(c.translate(_PART).split())
            for t, m in terms.items():
                rows += range(at, end)
                found += [t] * (end - at)
                times += [m] * (end - at)
            at = end
        if rows:
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns[1:], pa.array(times, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], schema=_CUT)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, times, packed) to a row per group."""
    for batch in batches:
        packed = batch.column(3).to_pylist()
        uses = np.frombuffer(b"".join(packed), _USE)
        rows = np.repeat(np.arange(batch.num_rows), [len(x) // _USE.itemsize for x in packed])
        which = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(uses["grp"].copy()),
                                          pa.array(uses["uses"] * batch.column(2).to_numpy()[rows])], schema=_UNPACKED)


def _named_groups(rows: DataFrame) -> tuple[DataFrame, Column]:
    """(lang, source, grp) of all groups, and ``grp`` as a column of ``rows``: a
    hash under which no two groups fall together."""
    for seed in range(9):
        grp = F.xxhash64(F.lit(seed), "lang", "source")
        groups = stage(rows.select("lang", "source", grp.alias("grp")).distinct(), "audit-groups")
        n, distinct = groups.agg(F.count("*"), F.count_distinct("grp")).first()
        if n == distinct:
            return groups, grp
    raise ValueError("groups cannot be told apart by their hash")


def group_terms(docs: DataFrame, min_docs: int, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, kept, groups): ``lang``, ``source``, ``term``, ``uses``,
    ``lang_uses`` of the kept terms where they occur; ``lang``, ``term``,
    ``lang_uses`` of the kept terms, those in at least ``min_docs`` distinct
    documents of the language; the ``lang``, ``source`` that occur in ``docs``."""
    names = ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in names))
    groups, grp = _named_groups(rows)
    counted = rows.select("lang", grp.alias("grp"), "text").mapInArrow(_count_chunks(min_docs, block_bytes), _schema(_COUNTED))
    cut = counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_cut_chunks, _schema(_CUT))
    cut = stage(cut, "audit-terms", "zstd").withColumn("key", F.xxhash64("lang", "term"))

    able = F.sum("docs") >= min_docs
    able = stage(cut.groupBy("key").agg(able.alias("able")).where("able").select("key"), "audit-able")
    cut = stage(admit(cut, able, able.count()).where("maybe").drop("key", "maybe"), "audit-frequent", "zstd")
    whole = cut.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.max("docs").alias("most"))
    whole = whole.where(F.col("docs") >= min_docs).select("lang", "term", (F.col("most") >= min_docs).alias("sure"), F.monotonically_increasing_id().alias("id"))
    whole = stage(whole, "audit-bounds")
    member = F.explode(F.expr("transform(sequence(0, length(members) div 8 - 1), i -> substring(members, cast(8 * i + 1 as int), 8))"))
    unsure = cut.where("length(members) >= 8").join(whole.where("not sure").drop("sure"), ["lang", "term"])
    distinct = unsure.select("id", member.alias("member")).distinct().groupBy("id").count().where(F.col("count") >= min_docs).select("id")
    kept = whole.where("sure").unionByName(whole.join(distinct, "id", "left_semi"), allowMissingColumns=True).select("lang", "term")
    kept = stage(kept, "audit-kept")
    uses = cut.join(kept, ["lang", "term"]).select("lang", "term", "times", "packed").mapInArrow(_unpack, _schema(_UNPACKED))
    uses = stage(uses.groupBy("lang", "term", "grp").agg(F.sum("uses").alias("uses")), "audit-uses")
    kept = stage(uses.groupBy("lang", "term").agg(F.sum("uses").alias("lang_uses")), "audit-whole")
    near = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    counts = uses.join(kept, ["lang", "term"]).join(near.drop("lang"), "grp").select("lang", "source", "term", "uses", "lang_uses")
    return stage(counts, "audit-counts"), kept, groups.select("lang", "source")


def share(count: str, n: str, v: str, smoothing: int) -> Column:
    """1 + floor(SCALE * (count + smoothing) / (n + smoothing * v)), exact."""
    return F.expr(f"1L + (({SCALE}BD * (cast({count} as decimal(20,0)) + {smoothing})) div (cast({n} as decimal(20,0)) + {smoothing} * cast({v} as decimal(18,0))))")


def _tile_distances(key: tuple, counts: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences over a tile's terms for the pairs of two
    blocks of sources (each unordered pair once)."""
    lang, _tile, lo, hi = key
    sources = sources.drop_duplicates("source").reset_index(drop=True)
    zero = sources["p0"].to_numpy(np.int64)
    place = {s: i for i, s in enumerate(sources["source"])}
    term, names = pd.factorize(counts["term"])
    p = np.repeat(zero[:, None], len(names), axis=1)
    p[counts["source"].map(place).to_numpy(np.int64), term] = counts["p"].to_numpy(np.int64)
    absent = int(sources["v_tile"].iloc[0]) - len(names) if len(sources) else 0
    part = sources["part"].to_numpy()
    left = np.flatnonzero(part == lo)
    out = []
    for i in left:
        others = np.flatnonzero(part == hi)
        if lo == hi:
            others = others[others > i]
        if len(others):
            f = np.abs(p[others] - p[i]).sum(axis=1) + absent * np.abs(zero[others] - zero[i])
            out.append(pd.DataFrame({"a": sources["source"].iloc[i], "b": sources["source"].to_numpy()[others], "value": f}))
    found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []})
    return pd.DataFrame({"lang": lang, "a": found["a"].astype(object), "b": found["b"].astype(object), "value": found["value"].astype(np.int64)})


def _distances(counts: DataFrame, groups: DataFrame, kept: DataFrame, tile_terms: int, sources: int) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source), ``value``."""
    deal = groups.groupBy("lang").agg(F.count("*").alias("s"), F.max("v").alias("v")).select(
        "lang", F.ceil(F.col("s") / sources).alias("parts"), F.greatest(F.lit(1), F.ceil(F.col("v") / tile_terms)).alias("tiles"))

    def meet(df: DataFrame) -> DataFrame:
        """Each row once for every pair of blocks of sources that holds its own."""
        own = F.pmod(F.xxhash64("source"), F.col("parts")).alias("part")
        df = df.select("*", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return df.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("other", "parts")

    tile = F.pmod(F.xxhash64("term"), F.col("tiles"))
    sized = kept.join(deal, "lang").groupBy("lang", tile.alias("tile")).agg(F.count("*").alias("v_tile"))
    tiles = deal.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).join(
        sized, ["lang", "tile"], "left").select("lang", "tile", "parts", F.coalesce("v_tile", F.lit(0)).alias("v_tile"))
    right = meet(groups.select("lang", "source", F.coalesce("p0", F.lit(0)).alias("p0")).join(tiles, "lang"))
    left = meet(counts.select("lang", "source", "term", "p").join(deal, "lang").withColumn("tile", tile).drop("tiles"))
    key = ["lang", "tile", "lo", "hi"]
    right = right.select(*(F.col(c).alias(f"of_{c}") for c in key), "source", "p0", "v_tile", "part")
    sums = left.groupBy(key).cogroup(right.groupBy([f"of_{c}" for c in key])).applyInPandas(_tile_distances, "lang string, a string, b string, value long")
    sums = sums.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit_sources(docs: DataFrame, min_docs: int = 30, smoothing: int = 5, top: int = 50,
                  tile_terms: int = TILE, sources: int = SOURCES, block_bytes: int = BLOCK, **columns: str) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: per group
    its distance to every other source of the language (part ``pair``) and the
    ``top`` terms whose share is most above the language's (part ``term``).
    Kept are the terms of at least ``min_docs`` documents of a language."""
    counts, kept, groups = group_terms(docs, min_docs, block_bytes=block_bytes, **columns)
    whole = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_uses").alias("lang_n"))
    own = counts.groupBy("lang", "source").agg(F.sum("uses").alias("n"))
    groups = groups.join(whole, "lang", "left").join(own, ["lang", "source"], "left").select(
        "lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "n", "lang_n")))
    groups = stage(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "n", "v", smoothing))), "audit-sized")
    near = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    counts = counts.join(near, ["lang", "source"]).select(
        "lang", "source", "term", share("uses", "n", "v", smoothing).alias("p"), share("lang_uses", "lang_n", "v", smoothing).alias("q"))

    pair = _distances(counts, groups, kept, tile_terms, sources).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    term = counts.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(w)) for x in (pair, term)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
