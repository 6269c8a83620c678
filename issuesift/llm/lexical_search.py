"""Ranked lexical search by the Best Position Algorithm.

Every term of a query has a list of documents by descending impact. The lists
are read side by side; a document met for the first time is looked up in all
of them at once (direct access). In each list the best position is the end of
the unbroken run of documents already seen, whether by reading or by lookup; no
unseen document scores more than the impacts at the best positions together.
As that is at most the bound of the last-read positions, the search stops
earlier; it stops when the bound is strictly below the k-th best score, so that
documents of equal score are all seen.

A scan of the corpus keeps, per document, its number of terms and the counts of
the queries' terms (a table); a scan of that table builds the impact lists of
one bounded shard of documents after the other, runs all queries against each,
and carries the best ``k`` of every query along, whose k-th score bounds the
next shards. Only the best ``k`` a task and query are shuffled. Queries are
taken in blocks of about ``QUERY_TERMS`` (query, term) pairs, each block
against all documents, so what a task holds does not grow with their number.

Defined cases: null and empty texts have no terms and count nowhere; a query
without terms in the corpus has no results; repeated rows are documents (or
queries) of their own; documents without an id come last among ties; empty
tables give no rows; other columns are not read. A very long text is one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stage

#: (query, term) pairs of a block of queries, about.
QUERY_TERMS = 65_536
#: Cells (documents x terms) of a shard's table of impacts, and most documents of a shard.
SHARD_CELLS, SHARD_DOCS = 8_000_000, 4096
#: Positions that the first round reads of each list; each further round reads twice as many.
FIRST_ROUND = 16
#: Scores are w * (SCALE * tf div (1000 * tf + 12 * m)).
SCALE = 1_000_000_000
#: Bytes of a text that are no part of a term become blanks, A-Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_terms(text: bytes | None) -> list[bytes]:
    """Terms: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        found = [Counter(split_terms(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())),
             pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["item_id", "terms", "uses"])


def _forward(vocabulary: dict[bytes, int]):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in slices(batches, 1):
            size, terms, tfs = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = split_terms(text)
                c = Counter(map(get, words))
                c.pop(None, None)
                size.append(len(words))
                terms.append(np.fromiter(c, np.int32, len(c)))
                tfs.append(np.fromiter(c.values(), np.int64, len(c)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"])

    return index


class Shard:
    """Impact lists of some documents: ``order[t]`` are the documents of term
    ``t`` by descending impact, ``impact[t]`` their impacts (both padded), and
    ``direct[t, d]`` is the impact of any document."""

    def __init__(self, n_docs: int, n_terms: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        by = np.lexsort((doc, -impact, term))
        term, doc, impact = term[by], doc[by], impact[by]
        size = np.bincount(term, minlength=n_terms)
        rank = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
        longest = int(size.max()) if len(term) else 0
        self.n_docs, self.size = n_docs, size
        self.order = np.full((n_terms, longest + 1), n_docs, np.int32)
        self.impact = np.zeros((n_terms, longest + 1), np.int32)
        self.direct = np.zeros((n_terms, n_docs), np.int32)
        self.order[term, rank], self.impact[term, rank], self.direct[term, doc] = doc, impact, impact

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, above: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, positions read): every document among the best
        ``k`` of these with a score of at least ``above`` and above 0, ties
        included, and perhaps others."""
        has = self.size[terms] > 0
        terms, weight = terms[has], weight[has]
        lists = np.arange(len(terms))
        bound = int(weight @ self.impact[terms, 0].astype(np.int64)) if len(terms) else 0
        if bound <= 0 or bound < above:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        width = int(self.size[terms].max()) + 1
        order, impact = self.order[terms, :width], self.impact[terms, :width]
        seen = np.zeros(self.n_docs + 1, bool)
        seen[self.n_docs] = True  # what pads the lists
        score = np.zeros(self.n_docs + 1, np.int64)
        upto, step, read = 0, FIRST_ROUND, 0
        while True:
            block = order[:, upto:upto + step]
            read += int((block < self.n_docs).sum())
            upto += block.shape[1]
            new = np.unique(block[~seen[block]])
            seen[new] = True
            score[new] = weight @ self.direct[np.ix_(terms, new)].astype(np.int64)
            if upto >= width:
                break
            unseen = ~seen[order[:, upto:]]  # all before are seen
            best = np.where(unseen.any(axis=1), upto + unseen.argmax(axis=1), width - 1)
            bound = int(weight @ impact[lists, best].astype(np.int64))
            full = score[score > 0]
            kth = int(np.partition(full, len(full) - k)[len(full) - k]) if len(full) >= k else 0
            if bound <= 0 or bound < max(kth, above):
                break
            step *= 2
        found = np.flatnonzero(score >= max(1, above))
        return found, score[found], read


def _search(queries: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int, n: int, length: int, k: int, id_type: pa.DataType):
    """``queries``: (number, terms, weights), the weight times its uses."""
    docs = max(64, min(SHARD_DOCS, SHARD_CELLS // max(1, n_terms)))
    schema = pa.schema([("query", pa.int64()), ("doc_id", id_type), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, above = schema.empty_table(), np.zeros(len(queries), np.int64)

        def run(rows: pa.Table) -> None:
            nonlocal best
            ids, m = rows.column(0).combine_chunks(), 75 + 25 * rows.column(1).to_numpy() * n // length
            lists = rows.column(2).combine_chunks()
            doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            term = lists.flatten().to_numpy(zero_copy_only=False)
            tf = rows.column(3).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            shard = Shard(rows.num_rows, n_terms, term, doc, SCALE * tf // (1000 * tf + 12 * m[doc]))
            rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
            which, where, scores = [], [], []
            for i, (_, terms, weight) in enumerate(queries):
                found, score, _ = shard.search(terms, weight, k, int(above[i]))
                first = np.lexsort((rank[found], -score))[:k]
                which.append(np.full(len(first), i))
                where.append(found[first])
                scores.append(score[first])
            new = pa.Table.from_arrays([pa.array(np.concatenate(which), pa.int64()), ids.take(pa.array(np.concatenate(where), pa.int64())),
                                        pa.array(np.concatenate(scores), pa.int64())], schema=schema)
            both = pa.concat_tables([best, new])
            both = both.take(pc.sort_indices(both, [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
            q = both.column(0).to_numpy()
            size = np.bincount(q, minlength=len(queries))
            place = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
            best = both.filter(pa.array(place < k)).combine_chunks()
            last = np.flatnonzero(place == k - 1)
            above[q[last]] = both.column(2).to_numpy()[last]

        held, n_held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, docs):
                part = batch.slice(at, docs)
                if n_held and n_held + part.num_rows > docs:
                    run(pa.Table.from_batches(held))
                    held, n_held = [], 0
                held.append(part)
                n_held += part.num_rows
        if n_held:
            run(pa.Table.from_batches(held))
        number = np.array([x[0] for x in queries], np.int64)
        if best.num_rows:
            yield from best.set_column(0, "query", pa.array(number[best.column(0).to_numpy()], pa.int64())).to_batches()

    return search


def _ranked(docs: DataFrame, block: list, k: int) -> DataFrame | None:
    """``query``, ``doc_id``, ``score``: the best ``k`` of every task, for one block of queries."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    for row in block:
        for t in row["terms"]:
            vocabulary.setdefault(bytes(t), len(vocabulary))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    index = stage(docs.mapInArrow(_forward(vocabulary), f"doc_id {id_type}, n long, terms array<int>, tfs array<long>").where("n > 0"), "search-index")
    n, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return None
    df = index.select(F.explode("terms").alias("term")).groupBy("term").count()
    weight = dict(df.select("term", F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("count") + 1).cast("double")))).collect())
    queries = []
    for row in block:
        terms = [(vocabulary[bytes(t)], u) for t, u in zip(row["terms"], row["uses"])]
        used = sorted((t, u * weight[t]) for t, u in terms if weight.get(t))
        if used:
            queries.append((row["query"], np.array([t for t, _ in used]), np.array([w for _, w in used], np.int64)))
    if not queries:
        return None
    id_arrow = spark.createDataFrame([], docs.select("doc_id").schema).toArrow().schema.field(0).type
    return index.mapInArrow(_search(queries, len(vocabulary), n, length, k, id_arrow), f"query long, doc_id {id_type}, score long")


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 20, item_col: str = "item_id", item_text: str = "text",
                  id_col: str = "doc_id", text_col: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """The ``k`` best documents for each row of ``items``: ``item_id``,
    ``rank`` (from 1), ``doc_id``, ``score``."""
    items = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    item_type, id_type = items.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    cut = items.mapInArrow(_query_terms, f"item_id {item_type.simpleString()}, terms array<binary>, uses array<long>")
    queries = stage(cut.withColumn("query", F.monotonically_increasing_id()), "search-queries")
    total = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).cast("long")).first()[0]
    blocks = -(-total // query_terms)
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "terms", "uses").collect()
        part = _ranked(docs, block, k) if block else None
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = stage(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "search-best")
    return best.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
