"""Write-once intermediate tables under the shared checkpoint folder.

The reference enriches a collection once and then answers many queries from
the stored result. ``stored`` gives the same shape: the first caller in a
session writes the table (Parquet, or text for landed pages) into
``spark.checkpoint.dir``; later callers read it. Reading a written table also
cuts lineage, so a lost executor re-reads files instead of recomputing joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, release, scratch_path

_PATHS: dict[tuple, str] = {}


def _key(spark: SparkSession, name: str) -> tuple:
    return (spark.sparkContext.applicationId, ensure_checkpoint_dir(spark), name)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored_path(spark: SparkSession, name: str, build: Callable[[], DataFrame], fmt: str = "parquet",
                partition_by: list[str] | None = None) -> str:
    k = _key(spark, name)
    path = _PATHS.get(k)
    if path is not None and not _exists(spark, path):
        path = None                      # removed meanwhile: write it again
    if path is None:
        path = scratch_path(spark, f"{name.replace('/', '_')}-{uuid.uuid4().hex}")
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        if fmt == "text":
            w.option("compression", "gzip").text(path)
        else:
            w.option("compression", "zstd").parquet(path)
        _PATHS[k] = path
    return path


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return spark.read.parquet(stored_path(spark, name, build))


def written_path(spark: SparkSession, name: str, write: Callable[[str], object]) -> str:
    """Folder that ``write(path)`` lays down itself, once per session."""
    k = _key(spark, name)
    path = _PATHS.get(k)
    if path is None or not _exists(spark, path):
        path = scratch_path(spark, f"{name.replace('/', '_')}-{uuid.uuid4().hex}")
        write(path)
        _PATHS[k] = path
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def from_lines(spark: SparkSession, sf_dir: str, write: Callable[[Callable[[], DataFrame]], str]) -> str:
    """The folder that ``write(lines)`` lays down; where it calls ``lines()``, the placed
    lines are stored for it and removed afterwards, as are the files of its shuffles."""
    from .. import fixtures as fx

    path = scratch_path(spark, f"orders-lines-{uuid.uuid4().hex}")
    made = []

    def lines() -> DataFrame:
        made.append(path)
        df = fx.stored_lines(spark, sf_dir, path)
        release(spark)
        return df

    out = write(lines)
    if made:
        discard(spark, path)
        release(spark)
    return out
