"""Quantiles and distinct counts over a long history, from sketches kept per key and day.

The exact operators read the whole history for every question. Here each day is reduced once to
one small sketch per key, and a question merges the sketches of the days it is about. A new day
is added without reading an old one; a day that is given again replaces what was stored of it.

Quantiles are KLL sketches: with ``k`` = 400 the rank of an answer is off by at most 0.8 % of the
rows, with a confidence of 99 %. Distinct counts are HyperLogLog sketches: with ``lg_k`` = 14 the
standard error is 0.8 %. Both bounds hold after any number of merges and for any size of key: a
sketch is built map-side, so a key with a third of all rows is merged from one sketch per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KLL_K = 400
HLL_LG_K = 14


def _finite(value: str) -> Column:
    number = F.col(value).cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))


def _store(daily: DataFrame, path: str) -> None:
    """Replace the folders of the days at hand, and no others."""
    daily.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


# ---- quantiles -----------------------------------------------------------------------

def add_quantile_days(rows: DataFrame, path: str, keys: list[str], value: str, at: str, k: int = KLL_K) -> None:
    """Store ``keys, day, n, low, high, sketch`` of whole days. Null and non-finite values count nowhere;
    rows without a time belong to the day null."""
    daily = rows.where(_finite(value)).groupBy(*keys, F.to_date(at).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col(value).cast("double")).alias("low"), F.max(F.col(value).cast("double")).alias("high"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))
    _store(daily, path)


def _period(bucket: str | None) -> list[Column]:
    return [] if bucket is None else [F.date_trunc(bucket, "day").alias("period")]


def quantiles_from(store: DataFrame, keys: list[str], probs: dict[str, float], bucket: str | None = None) -> DataFrame:
    """``keys``, ``period`` if a bucket is given, ``n`` and the quantiles. Fewer keys than were stored
    are rolled up; filter the store by ``day`` to read only those folders."""
    merged = store.groupBy(*keys, *_period(bucket)).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("sketch"))
    # The ends are known exactly; a quantile lies between them.
    quantile = lambda p: F.greatest("low", F.least("high", F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))))
    return merged.select(*merged.columns[:-4], "n", *[quantile(p).alias(name) for name, p in probs.items()])


# ---- distinct counts -------------------------------------------------------------------

def add_distinct_days(rows: DataFrame, path: str, key: str, row_id: str, at: str, lg_k: int = HLL_LG_K) -> None:
    """Store ``key, all, day, sketch`` of whole days: the distinct ids of each key, and of all rows
    together. ``key`` may be an array column; a row then counts for each of its elements."""
    rows = rows.select(F.col(key).alias("key"), F.col(row_id).cast("string").alias("id"), F.to_date(at).alias("day"))
    each = rows.select(F.explode("key").alias("key"), "id", "day") if dict(rows.dtypes)["key"].startswith("array") else rows
    kind = dict(each.dtypes)["key"]
    sketch = F.hll_sketch_agg("id", F.lit(lg_k)).alias("sketch")
    daily = each.where("key is not null").groupBy("key", "day").agg(sketch).withColumn("all", F.lit(False)).unionByName(
        rows.groupBy("day").agg(sketch).withColumns({"key": F.lit(None).cast(kind), "all": F.lit(True)}))
    _store(daily, path)


def distinct_from(store: DataFrame, bucket: str | None = None) -> DataFrame:
    """``key``, ``period`` if a bucket is given, the estimated ``n`` of its distinct ids, ``n_all`` of all ids in
    that period, and ``share``."""
    merged = store.groupBy("key", "all", *_period(bucket)).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    at = [] if bucket is None else ["period"]
    total = merged.where("all").select(*at, F.col("n").alias("n_all"))
    each = merged.where("not all").drop("all")
    # One row in all, or one row for each period of the calendar.
    both = each.join(F.broadcast(total), at) if at else each.crossJoin(F.broadcast(total))
    return both.withColumn("share", F.col("n") / F.col("n_all"))
