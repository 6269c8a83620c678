"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str | None) -> list[bytes]:
    """The words of ``text`` in UTF-8 with A-Z lower-cased; [] for null. Bytes
    split at the ASCII white space that parts words."""
    return text.encode().translate(_LOWER).split() if text else []


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(m))


def held_out(id_col: Column, m: int, r: int) -> Column:
    """True where ``crc32(id) mod m = r``; a null id is never held out."""
    return F.coalesce(crc_mod(id_col, m) == r, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts (column ``text``) have about
    ``size`` bytes, so that what a task holds does not follow the batch size.
    A longer text is a slice of its own."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    the lineage, survives lost executors and gives the planner true sizes."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables written by ``stage`` that nothing reads any more."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a bitmap per key, and powers of two that bound its size (4 KB to 32 MB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 8, 15, 28


def admit(rows: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """``rows`` with ``maybe``: true for every row whose column ``key`` (a hash
    as a long) is one of ``keys``, and for few others. The keys reach the rows
    as a broadcast bitmap of bounded size, so the rows are not shuffled; beyond
    that bound more others are admitted, none is lost."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_A_KEY * n_keys).bit_length()))
    bit = F.pmod("key", F.lit(bits)) + 1
    bitmap = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bitmap"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "_bucket", "left")
    found = F.expr("shiftright(_byte, cast(_at % 8 as int)) & 1") == 1
    return (joined.withColumn("_at", at).withColumn("_byte", byte)
            .withColumn("maybe", F.coalesce(found, F.lit(False))).drop("_at", "_byte", "_bucket", "_bitmap"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
