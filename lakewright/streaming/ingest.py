"""Resumable ingestion as Structured Streaming: files in, first record of each id out, exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """A stream of JSON-lines files; the checkpoint of the query is the committed cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def deduplicated(stream: DataFrame, key: str = "id") -> DataFrame:
    """The first record of each key; the state store holds the keys seen."""
    return stream.where(F.col(key).isNotNull()).dropDuplicates([key])


def run_once(df: DataFrame, out: str, checkpoint: str) -> None:
    """Take in what is new and stop; a rerun with the same checkpoint goes on where the last one committed."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of tumbling windows by type: an extension; works on streams (with a watermark) and tables."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def onboard(stream: DataFrame, index: str, checkpoint: str, vector: Column) -> None:
    """Append new models (id, ...) with their ``vector`` to the index table (id, v, batch); ids that it holds are left out.

    Each batch writes its own folder over what an earlier try of the same batch left, so a replay adds nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where("id is not null").select("id", vector.alias("v")).dropDuplicates(["id"])
        held = spark.read.schema("id string, v array<double>, batch long").parquet(index).where(F.col("batch") < number)
        fresh.join(held.select("id"), "id", "left_anti").write.mode("overwrite").parquet(f"{index}/batch={number}")

    stream.sparkSession.range(0).select(F.lit("").alias("id"), F.array().cast("array<double>").alias("v")).write.mode("ignore").parquet(f"{index}/batch=-1")
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
