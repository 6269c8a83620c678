"""Exact deduplication by progressive refinement.

Rows are grouped by the length of their text and the hash of its first
characters, both from one scan and summed before the shuffle. Only texts that
still share a group are hashed whole: a bitmap of the shared groups, one
broadcast of bounded size, tells them during the second scan, so texts are
never shuffled, and what it admits in vain forms a group of one. Rows and
groups meet by the full hash; a group with more than a thousandth of all rows
(there are fewer than a thousand of them) reaches its rows by broadcast, so no
key of the join holds more.

Defined cases: null texts count as empty and equal empty ones; of equal texts
the row with the greatest id stays, a null id is below all others, and of
several rows with that id exactly one stays; an empty table gives no rows;
other columns are not read. A very long text is hashed whole like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import admit, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text that the second round hashes.
HEAD = 128
#: A group with more than one row in so many is hot.
HOT = 1000


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; empty for null."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id`` (id of the row of
    its group that stays), ``group_size``, ``kept``, ``text_sha256``. That
    hash is null for texts that length or head told apart, unless ``digest``
    asks for it."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.octet_length("text").alias("length"),
        F.xxhash64(normalised(F.substring("text", 1, HEAD))).alias("head"))
    rows = rows.withColumn("key", F.xxhash64("length", "head"))
    pairs = stage(rows.groupBy("length", "head", "key").agg(F.count("*").alias("n")), "dedup-pairs")
    shared = pairs.where("n > 1")
    total, n_shared = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()

    sha = F.sha2(normalised(F.col("text")), 256)
    hashed = admit(rows, shared, n_shared).select(
        "doc_id", "length", "head", "maybe", (sha if digest else F.when(F.col("maybe"), sha)).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"))
    hashed = stage(hashed, "dedup-hashed")

    key = ["length", "head", "text_sha256"]
    left = hashed.where("maybe")
    groups = stage(left.groupBy(key).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")), "dedup-groups")
    is_hot = F.col("group_size") * HOT > total
    hot = F.broadcast(groups.where(is_hot))
    met = left.join(hot, key).unionByName(left.join(hot, key, "left_anti").join(groups.where(~is_hot), key))
    alone = hashed.where("not maybe").select(
        "*", F.lit(1).cast("long").alias("group_size"), F.struct("doc_id", "row").alias("top"))
    return met.unionByName(alone).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("top.row") == F.col("row")).alias("kept"), "text_sha256")
