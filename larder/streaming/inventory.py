"""Inventory state from a stream of change events.

Events may arrive late and out of order, up to a watermark. They are kept as an append-only log,
one folder per micro-batch, next to a snapshot of everything older than the watermark. The state
is the snapshot with the remaining log applied, so late events land in their right place, and a
replayed micro-batch overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators.inventory import apply_inventory_events

EVENT_SCHEMA = "kitchen_id long, slug string, op string, flag boolean, ts timestamp, event_id long"
ITEM_SCHEMA = "kitchen_id long, slug string, expiring boolean, is_staple boolean"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def append_events(batch: DataFrame, batch_id: int, state_path: str) -> None:
    """One micro-batch to the log, split by event day so that compaction reads whole folders."""
    batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(
        f"{state_path}/log/batch={batch_id}"
    )


def start(events: DataFrame, state_path: str, checkpoint: str, watermark: str = "1 day") -> StreamingQuery:
    """Feed the log from a stream; events are taken once and dropped when later than the watermark."""
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return (
        once.writeStream.foreachBatch(lambda df, n: append_events(df, n, state_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _log(spark: SparkSession, state_path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA + ", batch long, day date").parquet(f"{state_path}/log")


def _snapshots(spark: SparkSession, state_path: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/snapshots")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [str(s.getPath().getName()) for s in fs.listStatus(root)]
    return sorted(n for n in done if _exists(spark, f"{state_path}/snapshots/{n}/_SUCCESS"))


def current_state(spark: SparkSession, state_path: str) -> DataFrame:
    """Items now: the last snapshot with the log after it applied."""
    log = _log(spark, state_path)
    names = _snapshots(spark, state_path)
    if not names:
        return apply_inventory_events(log)
    base = spark.read.schema(ITEM_SCHEMA).parquet(f"{state_path}/snapshots/{names[-1]}")
    until = names[-1].split("=")[1]
    return apply_inventory_events(log.where(F.col("day") >= F.lit(until).cast("date")), base)


def compact(spark: SparkSession, state_path: str, until: str) -> None:
    """Fold all events before the day ``until`` into a new snapshot.

    Safe once the watermark has passed that day. Snapshots are immutable, so readers of an older
    one are not disturbed.
    """
    log = _log(spark, state_path).where(F.col("day") < F.lit(until).cast("date"))
    names = [n for n in _snapshots(spark, state_path) if n < f"until={until}"]
    if names:
        base = spark.read.schema(ITEM_SCHEMA).parquet(f"{state_path}/snapshots/{names[-1]}")
        log = log.where(F.col("day") >= F.lit(names[-1].split("=")[1]).cast("date"))
        state = apply_inventory_events(log, base)
    else:
        state = apply_inventory_events(log)
    state.write.mode("overwrite").parquet(f"{state_path}/snapshots/until={until}")
