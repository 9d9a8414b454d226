"""Operations metrics over an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hirelake.plans.quantiles import exact_percentiles
from hirelake.plans.series import running_total


def throughput(events: DataFrame, width: str) -> DataFrame:
    """Events per tumbling window and source."""
    return events.groupBy(F.window("ts", width).alias("w"), "source").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), "source", "n")


def latency(events: DataFrame) -> DataFrame:
    return exact_percentiles(events, ["source"], "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def hit_rate(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if("hit") / F.count(F.lit(1))).alias("hit_rate")
    ).select(F.col("w.start").alias("window_start"), "n", "hit_rate")


def queue_depth(events: DataFrame) -> DataFrame:
    """Queue length after every enqueue or dequeue moment, relative to the start."""
    return running_total(events.where(F.col("delta") != 0), "ts", "delta", "depth")
