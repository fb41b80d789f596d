"""Resumable ingestion as Structured Streaming: what the checkpoint has seen isn't read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.sources.io import append_new


def file_stream(spark: SparkSession, folder: str, schema, kind: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """One row for each key among those that come within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends what is new to a Parquet table, then ends."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_insert_only(stream: DataFrame, target: str, checkpoint: str, key: str, order) -> None:
    """Each micro-batch adds the keys that the target lacks; a batch that is run again adds nothing."""
    stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, target, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
