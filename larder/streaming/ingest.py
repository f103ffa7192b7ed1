"""Streaming ingest of refined recipes: only unseen signatures are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from larder.sources.tables import REFINED_SCHEMA, ingest_refined


def read_refined(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REFINED_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest_refined_stream(recipes: DataFrame, graph_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes one batch partition of the graph tables, replays included."""
    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_refined(batch, graph_path, f"stream-{batch_id:012d}")

    return (
        recipes.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
