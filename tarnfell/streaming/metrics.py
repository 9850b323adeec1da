"""Running request metrics: batch counters maintained incrementally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.operators.telemetry import BUCKET_COLUMNS, latency_bucket

RUNNING_KEYS = ["epoch", "server", "z", "source"]


def epoch_of(ts: Column, resets: list[str]) -> Column:
    """Number of resets at or before ``ts``; each reset starts new counters."""
    passed = F.lit(0)
    for moment in resets:
        passed = passed + F.when(ts >= F.lit(moment).cast("timestamp_ntz"), 1).otherwise(0)
    return passed


def running_metrics(requests: DataFrame, resets: list[str]) -> DataFrame:
    """Counts, retries and latency buckets per epoch, layer, zoom and source.

    State is one row per key and a key is a handful of values, so it does not
    grow with the traffic.
    """
    bucketed = requests.withColumn("epoch", epoch_of(F.col("ts"), resets)).withColumn(
        "bucket", latency_bucket(F.col("seconds") * 1000))
    retried = F.col("attempts") > 1
    return bucketed.groupBy(*RUNNING_KEYS).agg(
        F.count("*").alias("n"), F.count(F.when(retried, 1)).alias("retried_requests"),
        F.sum(F.when(retried, F.col("attempts").cast("long") - 1).otherwise(0)).alias("retry_attempts"),
        *[F.count(F.when(F.col("bucket") == i, 1)).alias(c) for i, c in enumerate(BUCKET_COLUMNS)])


def windowed_metrics(requests: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling-window counts; rows later than the watermark are dropped (an addition of ours)."""
    timed = requests.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", lateness)
    counted = timed.groupBy(F.window("event_time", width).alias("w"), "server", "source").agg(F.count("*").alias("n"))
    return counted.select(F.unix_micros("w.start").alias("start_us"), "server", "source", "n")
