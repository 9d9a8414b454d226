"""Ordered-window helpers whose partitions are cut by time.

A plain window over one key sorts all of that key's rows in one task. Here each
window covers one (key, time bucket), and only one row per bucket travels on to
carry the boundary value, so a hot key is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hirelake.plans.skew import null_safe_join


def with_neighbour(
    df: DataFrame, keys: list[str], at: str, tie: str, column: str, out: str,
    forward: bool = False, bucket: str = "day",
) -> DataFrame:
    """``lag`` (or ``lead``) of ``column`` in (at, tie) order within the keys."""
    shift = F.lead if forward else F.lag
    pick = F.min_by if forward else F.max_by
    cut = df.withColumn("_bucket", F.date_trunc(bucket, at))
    value = F.struct(F.col(column).alias("v"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(at, tie)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    border = (
        cut.groupBy(*keys, "_bucket").agg(pick(value, F.struct(at, tie)).alias("_edge"))
        .withColumn("_carried", shift("_edge").over(across)).drop("_edge")
    )
    near = cut.withColumn("_near", shift(value).over(inside))
    joined = null_safe_join(near, border, [*keys, "_bucket"])
    return joined.withColumn(out, F.coalesce("_near", "_carried")["v"]).drop(
        "_bucket", "_near", "_carried"
    )


def running_total(df: DataFrame, at: str, delta: str, out: str) -> DataFrame:
    """Running sum of ``delta`` at every distinct time, without one global window.

    Hours, the seconds of an hour and the moments of a second are summed in turn. So a
    window holds one row per hour of the calendar, 3,600 seconds, or a million microseconds
    at most, however many rows fall into them.
    """
    def before(column: str, within: list[str], order: str):
        upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(column).over(upto) - F.col(column)

    moments = df.groupBy(at).agg(F.sum(delta).alias(delta)).withColumn("_second", F.date_trunc("second", at))
    seconds = (
        moments.groupBy("_second").agg(F.sum(delta).alias("_sum"))
        .withColumn("_hour", F.date_trunc("hour", "_second"))
        .withColumn("_in_hour", before("_sum", ["_hour"], "_second"))
    )
    hours = (
        seconds.groupBy("_hour").agg(F.sum("_sum").alias("_sum"))
        .select("_hour", before("_sum", [], "_hour").alias("_of_hour"))
    )
    offsets = seconds.join(hours, "_hour").select("_second", (F.col("_in_hour") + F.col("_of_hour")).alias("_offset"))
    return (
        moments.withColumn("_inner", before(delta, ["_second"], at) + F.col(delta))
        .join(offsets, "_second")
        .select(at, F.col(delta), (F.col("_inner") + F.col("_offset")).alias(out))
    )
