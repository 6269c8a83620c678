"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the words and the end of a text; a text's history starts at a lead.
The tree's root is the smoothed unigram distribution. A node is a context of
one or more symbols; its next-symbol distribution is smoothed by its parent's,
the context without its oldest symbol. A context stays if its counts diverge
from the parent's prediction: the log-likelihood it gains must reach
``MIN_GAIN``. Contexts and transitions need ``MIN_COUNT`` occurrences, whatever
the size of the input. Contexts lengthen symbol by symbol under those that
stay, until none does. A token is scored at the longest suffix of its history
that is in the tree. The probabilities of all words (with one share for unseen
ones) sum to one in every state.

A token's log probability is its root's plus a term for every gram (run of
symbols) of the tree that ends at it or before it, so a text's score is a sum
of terms over its grams. Grams have 64-bit hashes. Their terms are a table: the
``HOT`` most frequent go to the workers, the others reach the texts by a join,
as the counts of rarer words do (frequent words: ``FREQUENT`` of all tokens). Both
travel packed: a row has all that a slice of texts has or asks for in a bucket
of hashes, so a bucket is a bounded group of few rows. Bit sets of bounded size only spare rows that the joins would drop.

Defined cases: null and empty texts are one end token; repeated rows are scored
(and learned) each; a null id is never held out by its hash; without training
rows every token has probability 1; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stage

FREQUENT = 1e-6  # of all tokens: words whose counts go to the workers
MIN_COUNT = 3
MIN_GAIN = 10.0  # nats
STRENGTH = 8.0  # of the parent's distribution, in tokens
HOT = 2_000_000  # grams whose terms go to the workers
BITS = 28  # log2 of the largest bit set
SLICE = 8_000_000  # bytes of text counted together, about
PIECE = 100_000  # bytes hashed together, about
PACKED = 500_000  # rows packed together at most
HELD = 1_000_000  # grams held by a task before they are sent, about
GROUP = 250_000  # tokens whose grams are a bucket
ASKED = 4_000_000  # bytes of text whose questions are a bucket; half of it asks together
LEAD, FIN, RARE = (np.uint64(x) for x in (0x6C62272E07BB0142, 0x27D4EB2F165667C5, 0x165667B19E3779F9))
_ODD, _MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTERS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def _longer(gram: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of a gram followed by a symbol."""
    return _mix(gram * _ODD + symbol)


def _find_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and lengths of the words of ``data``. A word is hashed by
    its length and eight letters at a time, one of over 64 bytes by BLAKE2."""
    found, at = [], 0
    while at < len(data):
        stop = at + PIECE
        if stop < len(data):  # up to white space
            space = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, PIECE, at)])
            while not len(space) and stop < len(data):  # one long word
                space = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, min(PIECE, len(data) - stop), stop)]) + stop - at
                stop += PIECE
            stop = at + int(space[-1]) + 1 if len(space) else len(data)
        a = np.frombuffer(data[at:stop] + bytes(8), np.uint8)
        space = np.ones(len(a) - 6, bool)
        space[1:-1] = (a[:-8] == 32) | ((a[:-8] - np.uint8(9)) < 5)
        edge = np.flatnonzero(space[1:] != space[:-1])
        first, size = edge[::2], edge[1::2] - edge[::2]
        eight = np.ndarray(len(a) - 7, "<u8", a, strides=(1,))
        h, left, on = size.astype(np.uint64), size, np.arange(len(size))
        for k in range(0, 64, 8):
            h[on] = _longer(h[on], eight[first[on] + k] & _LETTERS[np.minimum(left, 8)])
            on = on[left > 8]
            left = size[on] - k - 8
        for i in np.flatnonzero(size > 64):
            word = data[at + first[i]:at + first[i] + size[i]]
            h[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        found.append((h, first + at, size))
        at += len(a) - 8
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of lower-cased ``data``."""
    return _find_words(data)[:2]


def _laid_out(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts with ``sizes`` words, every text from its lead to its
    end, and every symbol's place in its text (0: the lead)."""
    total = sizes + 2
    begin = np.cumsum(total) - total
    place = np.arange(total.sum()) - np.repeat(begin, total)
    symbols = np.empty(len(place), np.uint64)
    symbols[begin], symbols[begin + total - 1] = LEAD, FIN
    inner = np.ones(len(place), bool)
    inner[begin] = inner[begin + total - 1] = False
    symbols[inner] = words
    return symbols, place


def _joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The lower-cased texts as one, and their ends."""
    low = [(x or "").encode().lower() for x in texts]  # bytes: A-Z only
    return b"\n".join(low), np.cumsum([len(x) + 1 for x in low])


def read_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each."""
    data, ends = _joined(texts)
    words, starts = hash_words(data)
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def read_symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return _laid_out(*read_words(texts))


@dataclass
class Bits:
    """A set of hashes that may hold more: two bits for each."""

    log2: int
    words: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        on = np.arange(len(keys))
        for slot in (lambda k: k >> np.uint64(64 - self.log2), lambda k: k & np.uint64((1 << self.log2) - 1)):
            at = slot(keys[on])
            on = on[(self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0]
        out = np.zeros(len(keys), bool)
        out[on] = True
        return out


def bits(keys: DataFrame) -> Bits:
    """The set of the column ``key``, of a size by its rows up to ``BITS``."""
    log2 = min(BITS, max(12, (16 * keys.count()).bit_length()))
    slot = F.explode(F.array(F.shiftrightunsigned("key", 64 - log2), F.col("key").bitwiseAND(F.lit((1 << log2) - 1))))
    got = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    words = np.zeros(1 << log2 - 6, np.uint64)
    words[got.column("at").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return Bits(log2, words)


def unigrams(docs: DataFrame) -> DataFrame:
    """``word``, ``c`` over the texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE // 2):
            data, _ = _joined(batch.column(0).to_pylist())
            hashes, starts, sizes = _find_words(data)
            _, first, c = np.unique(hashes, return_index=True, return_counts=True)
            words = [data[a:a + n].decode() for a, n in zip(starts[first].tolist(), sizes[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(c, pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Nodes:
    """Contexts of one length: the weight each leaves to its parent."""

    rest: np.ndarray


@dataclass
class Tree:
    """What goes to the workers: the frequent words and grams."""

    words: dict[bytes, int]  # frequent words; then come the end and all rarer words
    hashes: np.ndarray  # of the symbols as next ones
    counts: np.ndarray
    root: np.ndarray
    total: float  # N + (V + 1) / 2
    tokens: int
    longest: int = 0  # symbols of the longest gram
    known: Bits | None = None  # all grams with a term
    order: np.ndarray | None = None  # of the frequent words by hash
    keys: np.ndarray | None = None  # sorted hashes of the frequent ones
    own: np.ndarray | None = None  # their terms for their last symbol
    after: np.ndarray | None = None  # and for the symbol after it
    one: Nodes | None = None

    @property
    def n_symbols(self) -> int:
        return len(self.words) + 2

    def symbols(self, texts: list[list[bytes]]) -> np.ndarray:
        """The texts' symbols, every text between two ends."""
        end, rare, get = len(self.words), len(self.words) + 1, self.words.get
        flat = [end]
        for words in texts:
            flat += [get(w, rare) for w in words]
            flat.append(end)
        return np.array(flat, np.int64)

    def grams(self, symbols: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per length, the grams that may have terms: where they end, their
        hashes, whether they are frequent, and the frequent ones' terms."""
        gram, hit = symbols, None
        for length in range(1, self.longest + 1):
            ok = place >= length - 1
            if length > 1:
                gram = np.concatenate([gram[:1], _longer(gram[:-1], symbols[1:])])
            if length > 2:  # the tree has a gram's suffix, too
                ok &= hit
            at = np.flatnonzero(ok)
            at = at[self.known.has(gram[at])]
            hit = np.zeros(len(place), bool)
            hit[at] = True
            key = gram[at]
            hot, own, after = np.zeros(len(at), bool), np.zeros(len(at)), np.zeros(len(at))
            if len(self.keys):
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hot = self.keys[i] == key
                own, after = np.where(hot, self.own[i], 0.0), np.where(hot, self.after[i], 0.0)
            yield at, key, hot, own, after

    def logs(self, s: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol s[1:] by the frequent grams."""
        end = len(self.words)
        before = np.cumsum(s[1:] == end) - (s[1:] == end)  # ends before each
        at = np.arange(1, len(s)) + before
        symbols = np.full(at[-1] + 1, LEAD)
        symbols[at] = self.hashes[s[1:]]
        lead = symbols == LEAD
        place = np.arange(len(symbols))
        place -= np.maximum.accumulate(np.where(lead, place, 0))
        out = np.zeros(len(symbols) + 1)
        for where, _, _, own, after in self.grams(symbols, place):
            out[where] += own
            out[where + 1] += after
        return np.log10(self.root[s[1:]]) + out[at]


@dataclass
class Wanted:
    """Which grams of one length are counted: those that may be transitions of
    ``contexts`` or lengthen one of them."""

    contexts: Bits
    grams: Bits

    def has(self, prefix: np.ndarray, suffix: np.ndarray, length: int) -> np.ndarray:
        ok = self.contexts.has(prefix)
        ok[ok] = self.grams.has(suffix[ok])
        if length > 2:
            ok[~ok] = self.contexts.has(suffix[~ok])
        return ok


def packed(log2: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[list[pa.Array]]:
    """Rows of sorted ``keys`` as few: per bucket (the first ``log2`` bits of a
    key) its number and the bytes of each of ``columns``."""
    for i in range(0, len(keys), PACKED):
        bucket = (keys[i:i + PACKED] >> np.uint64(64 - log2)).astype(np.int32)
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        yield [pa.array(bucket[cut[:-1]]), *(as_bytes(x[i:i + PACKED], cut) for x in columns)]


def as_bytes(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The bytes of ``values[cut[i]:cut[i + 1]]``."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * width).astype(np.int32)), pa.py_buffer(values)])


def unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def n_bits(size: int, each: int) -> int:
    """log2 of the number of buckets of about ``each`` units."""
    return min(30, max(1, (int(size) // each).bit_length()))


def _summed(grams: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, grams and summed counts. Grams of two columns are pairs,
    whose key follows from both symbols; the third column is the key."""
    keys = _longer(grams[:, 0], grams[:, 1]) if grams.shape[1] == 2 else grams[:, 2]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    return keys[first], grams[order[first]], np.add.reduceat(c[order], first) if len(first) else c


def _sent(held: list[tuple[np.ndarray, np.ndarray]], log2: int) -> Iterator[pa.RecordBatch]:
    """Rows of the grams and counts in ``held``, which is emptied before they
    are sorted: a task holds them once."""
    grams, c = (np.concatenate(x) for x in zip(*held))
    held.clear()
    keys, grams, c = _summed(grams, c)
    for columns in packed(log2, keys, grams, c):
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "grams", "counts"])


def _seen(docs: DataFrame, length: int, wanted: Wanted, before: tuple[Wanted, Bits] | None, log2: int) -> DataFrame:
    """``key``, ``context`` (without the newest symbol), ``suffix`` (without the
    oldest), ``c`` of the wanted grams of ``length`` symbols. ``before``: what
    was wanted one symbol shorter, and what of it has ``MIN_COUNT``. Grams
    counted in a slice of texts travel packed, by ``log2`` bits of their key."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, before))
    n = 2 if length == 2 else 3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, before = shared.value
        held, n_held = [], 0
        for batch in slices(batches, 0, SLICE // 8):
            symbols, place = read_symbols(batch.column(0).to_pylist())
            part, shorter = symbols, None
            for _ in range(length - 2):
                part, shorter = np.concatenate([part[:1], _longer(part[:-1], symbols[1:])]), part
            at = np.flatnonzero(place >= length - 1)
            at = at[wanted.has(part[at - 1], part[at], length)]
            if before is not None:  # a gram is no more frequent than its prefix
                old, enough = before
                at = at[enough.has(part[at - 1]) | ~old.has(shorter[at - 2], shorter[at - 1], length - 1)]
            keys, first, c = np.unique(_longer(part[at - 1], symbols[at]), return_index=True, return_counts=True)
            at = at[first]
            held.append((np.column_stack([part[at - 1], part[at], keys][:n]), c.astype(np.int64)))
            n_held += len(at)
            if n_held >= HELD:
                yield from _sent(held, log2)
                n_held = 0
        if held:
            yield from _sent(held, log2)

    def add(bucket: pa.Table) -> pa.Table:
        keys, grams, c = _summed(unpacked(bucket.column("grams"), "<u8").reshape(-1, n), unpacked(bucket.column("counts"), "<i8"))
        enough = c >= MIN_COUNT
        return pa.table([*(pa.array(x[enough].view(np.int64)) for x in (keys, grams[:, 0], grams[:, 1])), pa.array(c[enough])],
                        ["key", "context", "suffix", "c"])

    rows = docs.select("text").mapInArrow(count, "bucket int, grams binary, counts binary")
    return rows.groupBy("bucket").applyInArrow(add, "key long, context long, suffix long, c long")


def _hashed(vocabulary: DataFrame) -> DataFrame:
    """``key``, ``c`` of the words."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = hash_words(" ".join(batch.column(0).to_pylist()).encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1)], ["key", "c"])

    return vocabulary.select("word", "c").mapInArrow(add, "key long, c long")


def grow(docs: DataFrame, vocabulary: DataFrame, n_docs: int, total: float) -> tuple[DataFrame | None, int]:
    """``key``, ``own``, ``after`` (log10 terms), ``c``, ``length`` of the
    tree's grams, and the symbols of the longest (None, 0 without any)."""
    spark = docs.sparkSession
    ends = spark.createDataFrame([(int(x.view(np.int64)), n_docs) for x in (LEAD, FIN)], "key long, c long")
    contexts = stage(_hashed(vocabulary.where(F.col("c") >= MIN_COUNT)).unionByName(ends.where(F.col("c") >= MIN_COUNT)), "lm-grams")
    grams = contexts.withColumn("p", (F.col("c") + 0.5) / F.lit(float(total)))
    terms, length, before, log2 = None, 1, None, n_bits(total, GROUP)
    while True:
        length += 1
        may = bits(contexts.select("key"))
        wanted = Wanted(may, may if length == 2 else bits(grams.select("key")))
        seen = stage(_seen(docs, length, wanted, before, log2), "lm-seen")
        before = wanted, bits(seen.select("key"))
        counted = stage(seen.join(contexts.select(F.col("key").alias("context"), F.col("c").alias("total")), "context")
                      .join(grams.select(F.col("key").alias("suffix"), F.col("p").alias("parent")), "suffix").drop("suffix"), "lm-moves")
        whole = F.col("total") + F.lit(STRENGTH)
        rests = counted.groupBy("context").agg(F.sum("c").alias("kept"), F.max("total").alias("t")).select(
            "context", "kept", "t", ((F.col("t") + F.lit(STRENGTH) - F.col("kept")) / (F.col("t") + F.lit(STRENGTH))).alias("rest"))
        rests = stage(rests, "lm-rests")
        moves = counted.join(rests, "context").withColumn("p", F.col("c") / whole + F.col("rest") * F.col("parent"))
        gain = F.sum(F.col("c") * F.ln(F.col("p") / F.col("parent"))) + F.max((F.col("t") - F.col("kept")) * F.ln("rest"))
        nodes = moves.groupBy("context").agg(gain.alias("gain"), F.max("rest").alias("rest"), F.max("t").alias("c"))
        nodes = stage(nodes.where(F.col("gain") >= MIN_GAIN).drop("gain"), "lm-nodes")
        if nodes.isEmpty():
            return terms, 0 if terms is None else length - 1
        moves = stage(moves.join(nodes.select("context"), "context", "left_semi").select(
            "key", "c", "p", (F.log10(F.col("p") / F.col("parent")) - F.log10("rest")).alias("own")), "lm-moves")
        discard(counted, rests)
        more = moves.select("key", "own", F.lit(0.0).alias("after"), "c", F.lit(length).alias("length")).unionByName(nodes.select(
            F.col("context").alias("key"), F.lit(0.0).alias("own"), F.log10("rest").alias("after"), "c", F.lit(length - 1).alias("length")))
        terms = more if terms is None else terms.unionByName(more)
        grams = moves.select("key", "p")
        old_contexts = contexts
        contexts = seen.join(nodes.select(F.col("context").alias("suffix")), "suffix", "left_semi").select("key", "c")
        contexts = stage(contexts, "lm-contexts")
        discard(seen, old_contexts)


def learn(docs: DataFrame) -> tuple[Tree, DataFrame, DataFrame | None]:
    """The workers' part of the tree, the counts of the other words (``word``,
    ``c``) and the terms of the other grams (``gram``, ``term``), from ``text``."""
    vocabulary = stage(unigrams(docs), "lm-unigrams")
    n_docs = docs.count()
    n_words, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n_words + n_docs, v + (n_docs > 0)
    least = max(MIN_COUNT, n * FREQUENT)
    t = vocabulary.where(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words = {w.encode(): i for i, w in enumerate(t.column("word").to_pylist())}
    c = t.column("c").to_numpy().astype(float)
    total = n + 0.5 * (v + 1)
    rare = total - (c + 0.5).sum() - (n_docs + 0.5 if n_docs else 0.0)
    counts = np.concatenate([c, [n_docs, n_words - c.sum()]])
    root = np.concatenate([(c + 0.5) / total, [(n_docs + 0.5) / total if n_docs else 1.0, rare / total]])
    hashes = np.append(hash_words(b" ".join(words))[0], [FIN, RARE])
    tree = Tree(words, hashes, counts, root, total, n, order=np.argsort(hashes[:-2]))
    rarer = vocabulary.where(F.col("c") < least)
    terms, tree.longest = grow(docs, vocabulary, n_docs, total) if n_docs else (None, 0)
    if terms is None:
        return tree, rarer, None
    terms = stage(terms.groupBy("key").agg(F.sum("own").alias("own"), F.sum("after").alias("after"), F.max("c").alias("c"),
                                           F.min("length").alias("length")), "lm-terms")
    tree.known = bits(terms.select("key"))
    # the least count above which the workers get all grams; counts beyond 2^16 as one
    sizes = terms.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).count().toArrow().sort_by([("c", "descending")])
    fit = np.cumsum(sizes.column("count").to_numpy()) <= HOT
    hot = int(sizes.column("c").to_numpy()[fit].min()) if fit.any() else 1 << 62
    t = terms.where(F.col("c") >= hot).toArrow()
    keys = t.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    own, after, length = (t.column(x).to_numpy() for x in ("own", "after", "length"))
    tree.keys, tree.own, tree.after = keys[order], own[order], after[order]
    tree.one = Nodes(10 ** after[length == 1])
    return tree, rarer, terms.where(F.col("c") < hot).select(F.col("key").alias("gram"), (F.col("own") + F.col("after")).alias("term"))


def train(docs: DataFrame) -> tuple[Tree, DataFrame]:
    """The workers' part of the tree and the counts of the other words."""
    return learn(docs)[:2]


def _asked(words: np.ndarray) -> np.ndarray:
    """Keys under which the counts of words are asked for (their own are those
    of grams of one symbol)."""
    return _mix(words ^ RARE)


def _renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _asked(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1)], ["key", "c"])


def score_texts(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row; learn from rows where ``may_learn`` (an expression over
    ``doc_id``) is true. Returns ``doc_id``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (smoothed unigrams) and ``score``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    tree, rarer, colder = learn(rows.where(may_learn))
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    log2 = n_bits(size, ASKED)
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "bucket", "keys", "texts", "uses"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per text with what frequent words and grams give, and rows
        that ask for the other words and grams of a slice of texts, named by
        the slice's first row."""
        t = shared.value
        row = TaskContext.get().partitionId() << 40
        rare = len(t.words) + 1
        base = np.log10(np.append(t.root[:rare], 0.5 / t.total))
        frequent = t.hashes[t.order]
        for batch in slices(batches, 1, ASKED // 2):
            words, n_words = read_words(batch.column(1).to_pylist())
            n = batch.num_rows
            owner = np.repeat(np.arange(n), n_words)
            got = np.full(len(words), rare)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
                got = np.where(frequent[at] == words, t.order[at], rare)
            is_rare = got == rare
            root = np.bincount(owner, base[got], n) + base[rare - 1]
            known = np.bincount(owner, ~is_rare, n).astype(np.int64) + int(t.counts[rare - 1] > 0)
            score, keys, whose = root.copy(), [_asked(words[is_rare])], [owner[is_rare]]
            if t.longest:
                place_owner = np.repeat(np.arange(n), n_words + 2)
                for at, key, hot, own, after in t.grams(*_laid_out(words, n_words)):
                    score += np.bincount(place_owner[at], own + after, n)
                    keys.append(key[~hot])
                    whose.append(place_owner[at[~hot]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0), pa.array(n_words + 1), pa.array(known), pa.array(root), pa.array(score),
                 *(pa.nulls(n, x) for x in (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names)
            keys, whose = np.concatenate(keys), np.concatenate(whose)
            order = np.argsort(keys, kind="stable")
            keys, whose = keys[order], whose[order]
            new = np.ones(len(keys), bool)  # equal words and grams of a text are asked for once
            new[1:] = (keys[1:] != keys[:-1]) | (whose[1:] != whose[:-1])
            first = np.flatnonzero(new)
            uses = np.diff(first, append=len(keys))
            for columns in packed(log2, keys[first], keys[first], whose[first].astype(np.uint32), uses.astype(np.uint32)):
                k = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, row)), pa.nulls(k, batch.column(0).type),
                     *(pa.nulls(k, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), *columns], names)
            row += n

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        keys, texts, uses = unpacked(asked.column("keys"), "<u8"), unpacked(asked.column("texts"), "<u4"), unpacked(asked.column("uses"), "<u4")
        have = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(have)
        at = order[np.minimum(np.searchsorted(have, keys, sorter=order), len(have) - 1)] if len(have) else np.zeros(len(keys), int)
        hit = have[at] == keys if len(have) else np.zeros(len(keys), bool)
        ends = np.cumsum(pc.binary_length(asked.column("texts")).to_numpy() // 4)
        cut = np.append(0, np.cumsum(hit))[np.append(0, ends)]
        value = table.column("value").to_numpy()[at[hit]] * uses[hit] if len(have) else np.zeros(0)
        words = table.column("known").to_numpy()[at[hit]] * uses[hit].astype(np.int64) if len(have) else np.zeros(0, np.int64)
        return pa.table([asked.column("row"), as_bytes(texts[hit], cut), as_bytes(words, cut), as_bytes(value, cut)], ["row", "texts", "known", "value"])

    def add(answers: pa.Table) -> pa.Table:
        texts, known, value = (unpacked(answers.column(i), k) for i, k in ((1, "<u4"), (2, "<i8"), (3, "<f8")))
        n = int(texts.max()) + 1 if len(texts) else 0
        log, term = (np.bincount(texts, np.where(x, value, 0.0), n) for x in (known > 0, known == 0))
        first = answers.column(0)[0].as_py()
        return pa.table([pa.array(np.arange(first, first + n), pa.int64()), pa.array(log, pa.float64()),
                         pa.array(np.bincount(texts, known, n).astype(np.int64)), pa.array(term, pa.float64())], ["row", "log", "known", "term"])

    part = stage(rows.mapInArrow(read, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, "
                                       "bucket int, keys binary, texts binary, uses binary"), "lm-parts")
    known = _hashed(rarer).mapInArrow(_renamed, "key long, c long").select(
        "key", F.lit(1).cast("long").alias("known"), F.log10((F.col("c") + 0.5) / 0.5).alias("value"))
    if colder is not None:
        known = known.unionByName(colder.select(F.col("gram").alias("key"), F.lit(0).cast("long").alias("known"), F.col("term").alias("value")))
    known = known.withColumn("bucket", F.shiftrightunsigned("key", 64 - log2).cast("int"))
    asked = part.where("bucket is not null").select("bucket", "row", "keys", "texts", "uses")
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "row long, texts binary, known binary, value binary")
    more = answers.groupBy("row").applyInArrow(add, "row long, log double, known long, term double")
    out = part.where("n_tokens is not null").select(*names[:6]).join(more, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                      F.lit(int(tree.tokens)).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"),
                      (F.col("score") + log + F.coalesce("term", F.lit(0.0))).alias("score"))
