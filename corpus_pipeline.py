"""The corpus pipeline: documents in, packed training sequences out.

Stages: toxic documents go, documents of low quality go, of every group of
near duplicates one document stays, the sources are mixed to their target
weights, and the mix is packed. Each stage reads what the one before it wrote;
all but the last return the columns of ``documents``. A document the mix takes
twice is two rows of the last stages' input, one it takes in part is cut.

Defined cases: decisions are taken on texts, so rows with null or repeated ids
are judged like any other; null and empty texts are of no group and pass the
third stage, and take no words of the mix; other columns travel along and may
have any name; empty tables pass every stage; without labels to learn from, the
first two stages keep all. Very long texts are read whole, a slice of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuesift.llm import mixing, ngram_join, packing, quality, toxicity
from issuesift.llm.common import BITS_A_KEY, WORD, admit, held_out, stage, table
from issuesift.llm.queries import tokenizer_path
from issuesift.session import ensure_checkpoint_dir, ship_package

#: Bits of the bitmap for each key whose rows may be dropped.
SPARE_BITS = 32


def _ready(fn: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the package shipped to the executors first."""
    @functools.wraps(fn)
    def ready(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    return ready


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row's text, and that column's name. The
    decisions of a stage follow from texts alone, so equal texts share a key,
    and rows without an id or with a repeated one are told apart."""
    key = "text_key"
    while key in docs.columns:
        key += "_"
    return docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")))), key


def _told_apart(keyed: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely none of ``keys`` (distinct and staged), and the
    others. A bitmap of the keys reaches the rows, so no text is shuffled; the
    others are the rows of ``keys`` and about one in ``SPARE_BITS`` of all."""
    names = keyed.columns
    packed = keyed.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(key).alias("key"))
    rows = admit(packed, keys.select(F.xxhash64(key).alias("key")), SPARE_BITS // BITS_A_KEY * keys.count())
    return tuple(rows.where(c).select(*[F.col("row")[c].alias(c) for c in names]) for c in (~F.col("maybe"), F.col("maybe")))


def _without(keyed: DataFrame, key: str, rejected: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key is not among the ``row`` of ``rejected``. Only the texts of
    rows that may be among them are shuffled."""
    gone = stage(rejected.select(F.col("row").alias(key)).distinct(), "rejected")
    others, maybe = _told_apart(keyed, key, gone)
    return others.unionByName(maybe.join(gone, key, "left_anti")).select(columns)


@_ready
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = _keyed(docs)
    scored = toxicity.score_toxicity(keyed, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0), row_col=key)
    return _without(keyed, key, scored.where("predicted = 1"), docs.columns)


@_ready
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = _keyed(docs)
    scored = quality.score_quality(keyed, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0), row_col=key)
    return _without(keyed, key, scored.where("predicted = 0 and raw is not null"), docs.columns)  # null: nothing to learn from


@_ready
def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the least id stays (a row without an id only
    where none has one; of equal ids the least in the other columns). Rows
    without words are in no group and stay."""
    keyed, key = _keyed(docs)
    groups = ngram_join.near_duplicates(keyed, id_col=key).where("n_shingles > 0")
    groups = stage(groups.select(key, F.col("component_id").alias("group_key")).distinct(), "groups")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *others, F.col(key))
    texts = keyed.groupBy(key).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows"))
    texts = stage(texts.join(groups, key), "texts")
    first = texts.groupBy("group_key").agg(F.min("best").alias("best"))
    first = stage(first.select(F.col(f"best.{key}").alias(key)), "first")
    # the one row of a chosen text stays where it is, as do rows without words
    passed_over = texts.join(first, key, "left_anti").select(key)
    touched = stage(passed_over.unionByName(texts.where("rows > 1").select(key)).distinct(), "touched")
    untouched, maybe = _told_apart(keyed, key, touched)
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    chosen = maybe.where(worded).groupBy(key).agg(F.min(order).alias("best"), F.first("text").alias("text")).join(first, key, "left_semi")
    chosen = chosen.select(*(F.col("text" if c == "text" else f"best.`{c}`").alias(c) for c in docs.columns))
    return untouched.select(docs.columns).unionByName(maybe.where(~worded).select(docs.columns)).unionByName(chosen)


@_ready
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@_ready
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence: its document, place and checksum, as in ``op8_pack``."""
    pieces = packing.decompose(docs, tokenizer_path(), added=True).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.sequences(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("ngram_join", one_per_group),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifiers and the schedule have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
