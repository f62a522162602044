"""Sinks: JSON Lines, one folder per split or file, size-bounded parts, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdial.operators.merge import request_parts


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """A folder per value of a column (split, file key, model)."""
    df.repartition(by).write.mode(mode).partitionBy(by).json(path)


def write_parts(requests: DataFrame, path: str, file: str, order: str, limit: int = 30_000_000) -> None:
    """Requests as JSON Lines in parts of up to limit bytes, numbered per file."""
    sized = requests.withColumn("_json", F.to_json(F.struct(*requests.columns))).withColumn("_size", (F.octet_length("_json") + 1).cast("bigint"))
    parts = request_parts(sized, file, order, "_size", limit).select(file, order, "part")
    sized.join(parts, [file, order]).select(file, "part", F.col("_json").alias("value")).repartition(file, "part").write.mode("overwrite").partitionBy(file, "part").text(path)


def batch_request(df: DataFrame, custom_id: str, messages: str, model: str, temperature: float = 0.2, max_tokens: int = 2048) -> DataFrame:
    """custom_id, method, url, body of chat-completion batch requests."""
    body = F.struct(F.lit(model).alias("model"), F.col(messages).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), F.lit(False).alias("stream"))
    return df.select(F.col(custom_id).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not there yet (idempotent resume); returns how many."""
    from loomdial.session import cut
    from loomdial.sources.readers import exists

    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.schema(df.schema).json(path).select(key), key, "left_anti")
    fresh = cut(df.dropDuplicates([key]))
    n = fresh.count()
    if n:
        write_jsonl(fresh, path, "append")
    return n
