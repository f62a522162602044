"""Structured Streaming: sessions arriving as files, each kept once, and windowed event counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, folder: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_within(stream: DataFrame, key: str, at: str, delay: str = "30 days") -> DataFrame:
    """Each key once; copies that come within the delay are dropped, state older than that is let go."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, kind: str, size: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append every micro-batch as Parquet; restarts go on where they stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
