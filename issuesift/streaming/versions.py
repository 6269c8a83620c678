"""X2 by keyed state: late and repeated versions without reading the log.

``start_version_log`` keeps, per item, the times of the versions of its last
seven days (``transformWithState``, RocksDB state). A version whose time is held
is a repeat and is left out; one older than the item's newest by more than the
delay is late: its repeats can no longer be told, so it goes to the late part
of the log. A batch writes one folder and reads none, so its work follows its
rows and not the number of batches before it; the state is one value an item,
bounded by its versions of one delay. Items have few rows in a batch, so they
pass as rows: a pandas frame for each item costs more than its versions.

``read_versions`` gives each version once: those of the log, and of the late
part what neither holds already. Of equal versions within a batch the one with
the greatest ``pos`` counts; rows without a time are versions of their own and
come once per item.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructType

KEY = ["repo", "number"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Name of the time in microseconds while rows pass the state.
_AT = "version_us"


class _Versions(StatefulProcessor):
    """State of one item, a single value: the ``newest`` time, the times of the
    last delay, and whether a row without a time came."""

    def __init__(self, delay_us: int, columns: list[str]):
        self.delay_us, self.columns, self.made = delay_us, columns, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("versions", "newest bigint, times array<bigint>, untimed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best, at_place, pos_place = {}, None, None
        for row in rows:  # one row per version, the greatest pos
            if at_place is None:
                at_place, pos_place = row.__fields__.index(_AT), row.__fields__.index("pos")
                places = [row.__fields__.index(c) for c in self.columns[:-1]]
            at, pos = row[at_place], row[pos_place]
            if at not in best or (pos is not None and (best[at][pos_place] is None or pos > best[at][pos_place])):
                best[at] = row
        if not best:
            return
        newest, held, untimed = self.held.get() or (None, [], False)
        known, before, out = set(held), (newest, len(held), untimed), []
        for at, row in best.items():
            late = at is not None and newest is not None and at < newest - self.delay_us
            if late or not (untimed if at is None else at in known):
                out.append((row, late))
        times = [at for at in best if at is not None]
        untimed = untimed or None in best
        if times:
            newest = max(times if newest is None else [newest, *times])
            known = {t for t in known.union(times) if t >= newest - self.delay_us}
        if (newest, len(known), untimed) != before:  # with the same newest time nothing leaves
            self.held.update((newest, sorted(known), untimed))
        for row, late in out:
            yield self.made(*(row[i] for i in places), late)

    def close(self) -> None:
        pass


def version_rows(stream: DataFrame, delay_days: int = 7) -> DataFrame:
    """``stream`` (with ``repo``, ``number``, ``pos``, ``updatedAt``) without
    repeated versions, and with ``late``."""
    if delay_days < 0:
        raise ValueError("delay_days must not be negative")
    spark = stream.sparkSession
    if spark.conf.get(_PROVIDER) != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    schema = StructType([*stream.schema.fields]).add("late", BooleanType())
    processor = _Versions(delay_days * 86_400_000_000, schema.names)
    keyed = stream.withColumn(_AT, F.unix_micros(F.col("updatedAt").cast("timestamp")))
    return keyed.groupBy(*KEY).transformWithState(processor, schema, "Append", "None")


def start_version_log(stream: DataFrame, root: str, checkpoint: str, delay_days: int = 7, available_now: bool = True):
    """Run the log under ``root``: a folder per batch, overwritten by a replay,
    with the late rows apart."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{root}/batch_id={batch_id}")

    w = version_rows(stream, delay_days).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def read_versions(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Each version once, with ``late``: true if only the late part has it."""
    typed = StructType([*schema.fields]).add("late", BooleanType())
    log = spark.read.schema(typed).option("basePath", root).option("recursiveFileLookup", "false").parquet(f"{root}/batch_id=*")
    others = [c for c in log.columns if c not in (*KEY, "updatedAt", "batch_id")]
    order = F.struct(~F.col("late"), F.coalesce("pos", F.lit(-1)))
    best = log.groupBy(*KEY, "updatedAt").agg(F.max_by(F.struct(*others), order).alias("v"))
    return best.select(*KEY, "updatedAt", *(F.col(f"v.{c}").alias(c) for c in others))
