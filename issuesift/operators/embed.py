"""Embedding (E1) and completion (E2) plug-ins with a content-hash cache.

The reference calls a remote model per issue. Here the work is a batch:

1. keys ``model:sha256(content)`` on the unsanitised text (F6), deduplicated;
2. the cache table ``(key, value)`` is joined (J9): hits are reused,
   misses (``left_anti``) go to the model -- each distinct text once;
3. the model runs inside tasks: the default embedder is a function of the
   text alone (signed md5 token hashing, L2 normalised), so a cached vector and
   a new one of the same key are equal; a custom one is any pandas function
   applied to parts of the Arrow batches, bounded in rows and bytes;
4. misses that failed on long content retry with the sanitised first line (F7);
5. what a model returns is written once to the shared checkpoint folder and
   read from there, so reading the result does not call the model again; the
   new cache rows are returned for the caller to append to the cache.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, is_blank, sanitize, title_fallback
from ..session import scratch_path

KEY = ["repo", "number"]
EMBED_T = "array<float>"
#: Rows and bytes of text a model is given at once.
PART_ROWS, PART_BYTES = 1000, 4_000_000
#: How hard stored texts are compressed.
TEXT_LEVEL = 9
#: Row ids that may be sent to every task.
FEW_ROWS = 500_000
#: Tokens whose places a task remembers.
PLACES_KEPT = 200_000
_TOKEN = re.compile(rb"[a-z0-9]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def cache_lookup(keys: DataFrame, cache: DataFrame | None, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split distinct ``key`` rows into (hits with ``value``, misses)."""
    k = keys.select("key", *[c for c in keys.columns if c != "key"]).dropDuplicates(["key"])
    if cache is None:
        return k.limit(0).withColumn(value_col, F.lit(None)), k
    c = cache.select("key", F.col(value_col)).dropDuplicates(["key"])
    return k.join(c, "key", "inner"), k.join(c, "key", "left_anti")


class _Places(dict):
    """Where a token counts: ``2 * bucket``, plus 1 for a negative sign. The bucket is
    its md5's first 7 hex digits modulo ``dims``, the sign + if the 8th is below 8."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, token: bytes) -> int:
        if len(self) >= PLACES_KEPT:
            self.clear()
        digest = hashlib.md5(token).hexdigest()
        place = self[token] = int(digest[:7], 16) % self.dims * 2 + (digest[7] >= "8")
        return place


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts of at most ``PART_ROWS`` rows and about
    ``PART_BYTES`` of column ``text``, so that what a task holds beside the batch
    follows neither the batch's rows nor their lengths."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, start = np.cumsum(size), 0
        while start < batch.num_rows:
            done = upto[start - 1] if start else 0
            stop = max(start + 1, min(start + PART_ROWS, int(np.searchsorted(upto, done + PART_BYTES, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def _hashing_embedder(texts: DataFrame, dims: int) -> DataFrame:
    """Default local embedder over a ``(key, text)`` frame -> ``(key, value)``.
    The tokens of a text are counted where it is read: nothing is shuffled, and a
    task holds the vectors of one part. A text without tokens has the zero vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(dims)
        for part in _parts(batches, 1):
            v = np.zeros((part.num_rows, dims))
            for row, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                at = [places[t] for t in _TOKEN.findall(text.translate(_LOWER))] if text else []
                if at:
                    signs = np.bincount(at, minlength=2 * dims)
                    v[row] = signs[::2] - signs[1::2]
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)
            offsets = pa.array(np.arange(0, v.size + 1, dims), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], ["key", "value"])

    return texts.select("key", "text").mapInArrow(run, f"key string, value {EMBED_T}")


def _written(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """``df`` computed once, into the shared checkpoint folder."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _written_texts(df: DataFrame, name: str, texts: list[str]) -> DataFrame:
    """``_written``, with columns ``texts`` side by side in one array: what they share
    (a body is part of its conversation) is then compressed away."""
    packed = "_texts"
    while packed in df.columns:
        packed += "_"
    stored = _written(df.select(*[c for c in df.columns if c not in texts], F.array(*texts).alias(packed)), name, TEXT_LEVEL)
    return stored.select(*[F.col(packed)[texts.index(c)].alias(c) if c in texts else F.col(c) for c in df.columns])


def _first_rows(keyed: DataFrame, cache: DataFrame | None, row: str) -> tuple[DataFrame, DataFrame]:
    """``cache_lookup`` without dealing out the texts: the hits, and of ``keyed``
    (``key``, ``row``, texts) one row of each key the cache lacks. Rows are chosen by
    ``row``, which tells them apart; only where both the rows taken and those left
    are many do the texts move."""
    hits, misses = cache_lookup(keyed.select("key", row), cache)
    taken = _written(misses.select(row), "taken")
    spare = _written(keyed.select(row).join(taken, row, "left_anti"), "spare")
    if spare.count() <= FEW_ROWS:
        return hits, keyed.join(F.broadcast(spare), row, "left_anti")
    return hits, keyed.join(F.broadcast(taken) if taken.count() <= FEW_ROWS else taken, row, "left_semi")


def _model(fn: Callable[[pd.Series], pd.Series], kind: pa.DataType):
    """``fn`` over the texts of ``(key, text)`` batches, a part at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1):
            made = pa.Array.from_pandas(pd.Series(fn(part.column(1).to_pandas())), type=kind)
            yield pa.RecordBatch.from_arrays([part.column(0), made], ["key", "value"])
    return run


def embed_texts(texts: DataFrame, embedder: Callable[[pd.Series], pd.Series] | None = None,
                dims: int = 256) -> DataFrame:
    """Run the embedder over ``(key, text)``; a pandas embedder returns a list of
    floats per text, or None for a failure."""
    if embedder is None:
        return _hashing_embedder(texts, dims)
    return texts.select("key", "text").mapInArrow(_model(embedder, pa.list_(pa.float32())), f"key string, value {EMBED_T}")


def embed_issues(df: DataFrame, text_col: str = "embed_text", cache: DataFrame | None = None,
                 embedder: Callable[[pd.Series], pd.Series] | None = None, model: str = "local-hash",
                 dims: int = 256, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Append ``embedding`` (null for blank text) and return
    ``(issues_with_embedding, new_cache_rows)``. ``row`` names a column that tells the
    rows of a stored ``df`` apart: texts are then read where they are stored."""
    t = F.col(text_col)
    keyed = df.withColumn("_key", F.when(~is_blank(t), cache_key(t, model)))
    texts = keyed.where(F.col("_key").isNotNull()).select(F.col("_key").alias("key"), t.alias("raw"), *([row] if row else []))
    hits, misses = cache_lookup(texts, cache) if row is None else _first_rows(texts, cache, row)
    todo = misses.select("key", sanitize(F.col("raw")).alias("text"), "raw").where(F.length("text") > 0)
    new = _written(embed_texts(todo.select("key", "text"), embedder, dims), "embedded")
    if embedder is not None:
        # failed long texts retry with their first line
        failed = new.where(F.col("value").isNull()).select("key").join(todo, "key")
        retry_in = failed.select("key", title_fallback(F.col("raw")).alias("text")).where(F.col("text").isNotNull())
        retry = _written(embed_texts(retry_in, embedder, dims), "embedded")
        new = new.unionByName(retry).where(F.col("value").isNotNull())
    values = hits.select("key", F.col("value").cast(EMBED_T).alias("value")).unionByName(
        new.select("key", F.col("value").cast(EMBED_T).alias("value")))
    out = keyed.join(values.withColumnRenamed("key", "_key"), "_key", "left").withColumnRenamed("value", "embedding")
    return out.drop("_key"), new.select("key", F.col("value").cast(EMBED_T).alias("value"))


# ---------------------------------------------------------------- E2
# The head of the prompt; the whole prompt is the cache key, so another head has other keys.
PROMPT_HEAD = "Summarise this issue in three sentences: the problem, where the discussion stands, how engaged people are.\n\n"
# The fields a prompt shows.
PROMPT_FIELDS = ["number", "url", "title", "conversation", "author", "updatedAt", "labels", "state",
                 "age_days", "age_days_quartile", "comment_count", "comment_count_quartile", "engagements",
                 "engagements_quartile", "engagements_per_day", "engagements_per_day_quartile", "body_emojis",
                 "body_emojis_quartile", "comment_emojis", "comment_emojis_quartile", "total_emojis",
                 "total_emojis_quartile"]


def prompt_text(df: DataFrame, head: str = PROMPT_HEAD) -> DataFrame:
    """F8: compact JSON of 22 issue fields after the prompt's head.
    (The reference escapes non-ASCII as ``\\uXXXX``; this keeps UTF-8.)"""
    fields = []
    for f in PROMPT_FIELDS:
        if f == "labels":
            v = (F.transform("labels", lambda x: x["name"]) if "labels" in df.columns
                 else F.array().cast("array<string>"))
        elif f in df.columns:
            v = F.col(f)
        else:
            v = F.lit(None).cast("string")
        fields.append(v.alias(f))
    js = F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"})
    return df.withColumn("prompt", F.concat(F.lit(head), js, F.lit("\n")))


def summarize(df: DataFrame, completer: Callable[[pd.Series], pd.Series] | None = None,
              cache: DataFrame | None = None, model: str = "local-none",
              head: str = PROMPT_HEAD) -> tuple[DataFrame, DataFrame]:
    """``summary`` from a completion plug-in over F8 prompts, cached by
    prompt key; without a completer every summary is null (as without an API key)."""
    base = df.drop("summary") if "summary" in df.columns else df
    p = prompt_text(base, head).withColumn("_key", cache_key(F.col("prompt"), model))
    if completer is None:
        return p.withColumn("summary", F.lit(None).cast("string")).drop("prompt", "_key"), \
            p.limit(0).select(F.col("_key").alias("key"), F.lit(None).cast("string").alias("value"))
    hits, misses = cache_lookup(p.select(F.col("_key").alias("key"), F.col("prompt")), cache)

    made = misses.select("key", "prompt").mapInArrow(_model(completer, pa.string()), "key string, value string")
    new = _written(made, "completed")
    new = new.where(F.col("value").isNotNull())
    values = hits.select("key", F.col("value").cast("string")).unionByName(new)
    out = p.join(values.withColumnRenamed("key", "_key"), "_key", "left").withColumnRenamed("value", "summary")
    return out.drop("prompt", "_key"), new
