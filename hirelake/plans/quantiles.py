"""Exact percentiles that never order a whole group in one task."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.plans.skew import null_safe_join
from hirelake.session import materialize

BINS_PER_E_FOLD = 200  # one bin spans about 0.5 % of a value
PARTS = 4096  # parts of a bin that holds too many rows
MOST = 1_000_000  # rows of one bin that are ordered together


def _bin(value: Column) -> Column:
    """A data-independent, order-keeping histogram bin: log scale, both signs."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * BINS_PER_E_FOLD)


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], most: int = MOST
) -> DataFrame:
    """Interpolated percentiles per key, plus the row count ``n``. Nulls and NaN do not count.

    A log-scale histogram, counted map-side, finds the bins that hold the wanted ranks. A
    bin of more than ``most`` rows is cut into ``PARTS`` between its least and its largest
    value, again by map-side counts, and so on until each wanted bin is small or holds one
    value. Each round is written, so its size is known when it is joined: a few bins per key.
    Only rows of small bins are ordered, and the values of a whole group never are.
    """
    keys = list(keys)
    if not keys:
        return exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, most).drop("_all")
    sides = (F.floor, F.ceil)

    def rank(p: float, side) -> Column:
        return side(F.lit(float(p)) * (F.col("_total") - 1))

    def holds(target: Column, start: str, length: str) -> Column:
        return (target >= F.col(start)) & (target < F.col(start) + F.col(length))

    def wanted(bins: DataFrame, within: list[str]) -> DataFrame:
        """Bins with a wanted rank; ``_base`` rows lie before those they were cut from."""
        upto = Window.partitionBy(*within).orderBy("_low").rowsBetween(Window.unboundedPreceding, 0)
        placed = bins.withColumn("_before", F.col("_base") + F.sum("_n").over(upto) - F.col("_n"))
        return placed.where(
            reduce(or_, [holds(rank(p, s), "_before", "_n") for p in probs.values() for s in sides])
        ).select(*keys, "_bin", "_low", "_high", "_n", "_before", "_total")

    def inside(bins: DataFrame) -> DataFrame:
        """Values that lie in one of the bins, with its columns; bins of a key do not overlap."""
        return null_safe_join(rows, bins, [*keys, "_bin"]).where(F.col("_v").between(F.col("_low"), F.col("_high")))

    number = F.col(value).cast("double")
    rows = (
        df.where(number.isNotNull() & ~F.isnan(number)).select(*keys, number.alias("_v"))
        .withColumn("_bin", _bin(F.col("_v")))
    )
    counted = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    first = rows.groupBy(*keys, "_bin").agg(*counted).withColumns({
        "_base": F.lit(0), "_total": F.sum("_n").over(Window.partitionBy(*keys))})
    bins = materialize(wanted(first, keys), "bins")
    varied = F.col("_low") < F.col("_high")
    crowded = varied & (F.col("_n") > most)
    while not bins.where(crowded).isEmpty():
        share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        parts = (
            inside(bins.where(crowded).withColumn("_of", F.col("_low")).drop("_n"))
            .groupBy(*keys, "_bin", "_of", F.col("_before").alias("_base"), "_total", F.floor(share * PARTS).alias("_part"))
            .agg(*counted)
        )
        bins = materialize(
            bins.where(~crowded).unionByName(wanted(parts, [*keys, "_bin", "_of"])), "bins")
    in_bin = Window.partitionBy(*keys, "_bin", "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = (
        inside(bins.where(varied).drop("_n"))
        .groupBy(*keys, "_bin", "_before", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_from", F.col("_before") - F.col("_n") + F.sum("_n").over(in_bin))
    )
    columns = [*keys, "_total", "_v", "_n", "_from"]
    ranked = ordered.select(*columns).unionByName(
        bins.where(~varied).withColumns({"_v": F.col("_low"), "_from": F.col("_before")}).select(*columns))
    picks, out = [F.max("_total").alias("n")], []
    for name, p in probs.items():
        for label, side in zip(("lo", "hi"), sides):
            hit = F.when(holds(rank(p, side), "_from", "_n"), F.col("_v"))
            picks.append(F.max(hit).alias(f"_{name}_{label}"))
        position = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, "n", *out)
