"""Packing without padding: power-of-two decomposition of documents.

A document of ``n`` tokens is cut into pieces of the longest length and then
into pieces whose lengths are the binary digits of the rest, longest first.
Each piece is a sequence of its own, so no sequence crosses documents and none
is padded; sequences of one length form a bucket a batch can be drawn from.

Defined cases: null and empty texts hold only the end token; repeated rows are
separate documents with sequences of their own; an empty table gives no
pieces; other columns are not read. A very long text is cut like any other.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

CELLS = 1 << 16
BLANK = 50_000
#: Cuts of the byte-level vocabulary; fixed values of that public format.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _plain(spec: dict) -> Callable[[str], list[int]]:
    """The vocabulary of ``spec`` in ``tiktoken``: its ids are merge ranks."""
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.cache
def encoder(path: str, added: bool = False) -> Callable[[str], list[int]]:
    """Text to ids by the byte-level BPE vocabulary file at ``path`` (the JSON
    form of the ``tokenizers`` library), without special tokens around it. An
    added token within a text is its own id if ``added`` (what ``tokenizers``
    does by itself), else ordinary text. ``tiktoken`` gives the same ids four
    times as fast, but knows no added tokens and overflows its stack on very
    long runs of white space: texts with either go to ``tokenizers``."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = not added
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = _plain(spec)
    tokens = [t["content"] for t in spec.get("added_tokens", [])]
    del spec  # some 100 MB as Python objects

    def encode(text: str) -> list[int]:
        # a run of 2 * BLANK - 1 characters fills one of these cells
        blank = len(text) >= BLANK and any(text[i:i + BLANK].isspace() for i in range(0, len(text), BLANK))
        if blank or any(t in text for t in tokens):
            return whole.encode(text, add_special_tokens=False).ids
        return plain(text)

    return encode


def cut(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              max_len: int = 1024, end_id: int = 0, added: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (32-bit
    little-endian), ``doc_tokens``. ``max_len`` is a power of two; ``added``
    as in ``encoder``."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    ids_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added)
        for batch in slices(batches, 1):
            ids = batch.column(0)
            which, start, length, data, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = encode(text) if text else []
                tokens.append(end_id)
                raw, at = np.array(tokens, "<u4").tobytes(), 0
                for k in cut(len(tokens), max_len):
                    which.append(i)
                    start.append(at)
                    length.append(k)
                    data.append(raw[4 * at:4 * (at + k)])
                    total.append(len(tokens))
                    at += k
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(which, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(data, pa.binary()), pa.array(total, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return rows.mapInArrow(pieces, f"doc_id {ids_type.simpleString()}, start long, length long, ids binary, doc_tokens long")


def sequences(pieces: DataFrame) -> DataFrame:
    """Give every piece its sequence (``sequence_id``, ``offset`` 0): ids grow
    by length bucket, then by cell, and are unique without a global count.
    Whatever other columns ``pieces`` has travel along, so drop those not
    needed first."""
    cell = F.pmod(F.xxhash64("doc_id", "start"), F.lit(CELLS))
    w = Window.partitionBy("length", "_cell").orderBy("doc_id", "start", "doc_tokens")
    bucket = F.round(F.log2("length")).cast("long")
    number: Column = bucket * (1 << 56) + F.col("_cell") * (1 << 40) + F.row_number().over(w) - 1
    return (pieces.withColumn("_cell", cell).withColumn("sequence_id", number)
            .withColumn("offset", F.lit(0).cast("long")).drop("_cell"))


def pack(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """Pack ``docs``: one row per sequence, with its token ids."""
    return sequences(decompose(docs, tokenizer, **settings))
