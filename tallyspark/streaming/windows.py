"""Structured Streaming twins of the grouped detections, with watermarks so that state is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows and distinct-free sums per window and keys: works on batches and on streams (append mode)."""
    source = events.withColumn("__t", F.col(time).cast("timestamp"))
    source = source.withWatermark("__t", late) if events.isStreaming else source
    got = source.groupBy(F.window("__t", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *keys, "n")


def frequent_small_stream(events: DataFrame, time: str, vendor: str, amount: str, limit: float, least: int = 5, late: str = "1 day") -> DataFrame:
    """R018 over a stream: vendor-days with more than `least` rows, all below `limit`, once the day is past the watermark."""
    source = events.withColumn("__t", F.col(time).cast("timestamp")).filter(F.col(vendor).isNotNull() & F.col(amount).isNotNull())
    source = source.withWatermark("__t", late) if events.isStreaming else source
    got = source.groupBy(F.window("__t", "1 day").alias("w"), vendor).agg(F.count(F.lit(1)).alias("n"), F.max(amount).alias("most"))
    return got.filter((F.col("n") > least) & (F.col("most") < limit)).select(F.col("w.start").cast("date").alias("day"), vendor, "n", "most")


def distinct_rows(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of rows with equal keys that arrive within the watermark."""
    source = events.withColumn("__t", F.col(time).cast("timestamp"))
    if not events.isStreaming:
        return source.dropDuplicates(keys).drop("__t")
    return source.withWatermark("__t", late).dropDuplicatesWithinWatermark(keys).drop("__t")


def append_findings(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each batch of a stream of findings to a parquet table, once per batch even after a restart."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
