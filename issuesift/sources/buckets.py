"""Stored tables that a join never shuffles.

A collection or a cache is stored as Parquet hashed by its key into a fixed
number of sorted buckets, one file each. A join by that key reads the buckets
where they lie; only the other side (an update, the keys asked for) is dealt to
them. A specification beside the folder lets any session open the table again.

The number of buckets is that of the tasks of every later join: choose it for
the table's size to come (about 1 GB a bucket).
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.incremental import KEY, latest_version, upsert


@dataclass(frozen=True)
class Buckets:
    """A stored table: its folder, key columns and number of buckets."""

    path: str
    keys: tuple[str, ...]
    n: int

    def table(self) -> str:
        """Its name in the session's catalog."""
        return f"issuesift_buckets_{zlib.crc32(self.path.encode()):08x}_{self.n}"

    def align(self, df: DataFrame) -> DataFrame:
        """``df`` dealt out like the buckets: the one shuffle of a join with them."""
        return df.repartition(self.n, *self.keys)


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}`" for c in names)


def write_buckets(df: DataFrame, path: str, keys: list[str], n: int, aligned: bool = False) -> Buckets:
    """Store ``df`` under the new folder ``path``. ``aligned``: its partitions
    already are the buckets, so the rows are written where they are."""
    if n < 1 or not keys:
        raise ValueError("a bucketed table needs a key and at least one bucket")
    if missing := [c for c in keys if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)} to bucket by")
    spark, b = df.sparkSession, Buckets(path, tuple(keys), n)
    rows = df if aligned else b.align(df)
    rows.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(b.table())
    spec = json.dumps({"keys": keys, "buckets": n, "schema": df.schema.jsonValue()})
    spark.createDataFrame([(spec,)], "value string").coalesce(1).write.text(f"{path}-spec")
    return b


def open_buckets(spark: SparkSession, path: str) -> Buckets:
    """A table stored earlier, by this session or another."""
    spec = json.loads(spark.read.text(f"{path}-spec").first()[0])
    b = Buckets(path, tuple(spec["keys"]), spec["buckets"])
    if not spark.catalog.tableExists(b.table()):
        schema = StructType.fromJson(spec["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {b.table()} ({columns}) USING parquet CLUSTERED BY ({_quoted(b.keys)}) SORTED BY ({_quoted(b.keys)}) "
                  f"INTO {b.n} BUCKETS LOCATION '{path}'")
    return b


def read_buckets(spark: SparkSession, b: Buckets) -> DataFrame:
    return spark.table(b.table())


def upserted(spark: SparkSession, b: Buckets, updates: DataFrame) -> DataFrame:
    """S3 over a stored collection: its rows with ``updates`` applied. Only the
    updates' newest versions move; partition i of the result is bucket i."""
    if set(b.keys) != set(KEY):
        raise ValueError(f"an upsert needs a table bucketed by {', '.join(KEY)}")
    return upsert(read_buckets(spark, b), b.align(latest_version(updates)), dedupe=False)


def upsert_buckets(spark: SparkSession, b: Buckets, updates: DataFrame, base: str) -> Buckets:
    """Apply ``updates`` and store the result as a new table under ``base``; the
    table read stays as it is, so a reader of it is not disturbed."""
    return write_buckets(upserted(spark, b, updates), f"{base}/gen-{uuid.uuid4().hex}", list(b.keys), b.n, aligned=True)


def lookup(spark: SparkSession, b: Buckets, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J9 over a stored cache: distinct ``keys`` split into (hits with the
    cache's columns, misses). Only the keys move, each distinct one once."""
    asked = b.align(keys.dropDuplicates(list(b.keys)))
    cache = read_buckets(spark, b).dropDuplicates(list(b.keys)).withColumn("_held", F.lit(True))
    # not an anti join: the optimizer would move that below the dealing out of the keys
    met = asked.join(cache, list(b.keys), "left")
    return met.where(F.col("_held")).drop("_held"), met.where(F.col("_held").isNull()).select(keys.columns)


def extend(spark: SparkSession, b: Buckets, rows: DataFrame, base: str) -> Buckets:
    """The cache with ``rows`` added, as a new table. A value that is held
    stays; of several new rows of a key one is added."""
    cache = read_buckets(spark, b)
    new = b.align(rows.dropDuplicates(list(b.keys)))
    held = cache.withColumnsRenamed({c: f"_{c}" for c in cache.columns if c not in b.keys})
    both = held.join(new, list(b.keys), "full_outer")
    out = both.select(*b.keys, *(F.coalesce(f"_{c}", c).alias(c) for c in cache.columns if c not in b.keys))
    return write_buckets(out, f"{base}/gen-{uuid.uuid4().hex}", list(b.keys), b.n, aligned=True)
