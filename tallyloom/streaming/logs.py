"""The call log as a stream: late and repeated lines, latest record per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_calls(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet call records as they arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def distinct_calls(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each call id once; repeats within the watermark are dropped, state older than it is freed."""
    return stream.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["call_id"])


def hourly_usage(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Calls, errors and tokens per model and hour of event time."""
    return (
        stream.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", "1 hour"), "model")
        .agg(F.count("*").alias("n"), F.count_if(F.col("status") != "ok").alias("errors"), F.sum(F.coalesce("usage.total_tokens", F.lit(0))).alias("tokens"))
        .select(F.col("window.start").alias("hour"), "model", "n", "errors", "tokens")
    )


def append_latest(stream: DataFrame, path: str, checkpoint: str):
    """Append every batch to a log table; batches are written once each (folder per batch id)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
