"""Keyed Feistel permutation of ``0 .. total - 1`` as a native column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROUNDS = 8
WALKS = 40


def permuted(number: Column, total: Column, seed: int) -> Column:
    """Where the row ``number`` goes in a keyed shuffle of ``total`` rows.

    The halves live in ``0 .. high - 1`` and ``0 .. low - 1`` with ``high * low`` at least
    ``total`` and less than ``total + high`` above it. A round adds a hash of one half to
    the other, so every round is a bijection. Values past ``total`` walk on along their
    cycle. Fewer than ``high`` values lie outside, so ``WALKS`` steps are enough for
    certain up to 1,600 rows; beyond, missing it has a chance below ``total ** -19``,
    and then the query fails rather than give a wrong place.
    """
    high = F.greatest(F.lit(1), F.ceil(F.sqrt(total.cast("double")))).cast("long")
    low = F.greatest(F.lit(1), F.ceil(total.cast("double") / high)).cast("long")

    def one_round(halves: Column, step: Column) -> Column:
        first, second = halves["first"], halves["second"]
        return F.when(
            step % 2 == 0,
            F.struct(((first + F.pmod(F.xxhash64(F.lit(seed).cast("long"), step, second), high)) % high).alias("first"),
                     second.alias("second")),
        ).otherwise(
            F.struct(first.alias("first"),
                     ((second + F.pmod(F.xxhash64(F.lit(seed).cast("long"), step, first), low)) % low).alias("second")))

    def once(x: Column) -> Column:
        steps = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
        start = F.struct(F.floor(x / low).cast("long").alias("first"), (x % low).alias("second"))
        return F.aggregate(steps, start, one_round, lambda h: h["first"] * low + h["second"])

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), once(number),
        lambda at, _: F.when(at < total, at).otherwise(once(at)))
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def numbered(df: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """``keys`` of every row, a gapless ``number`` from 0 and the ``total``.

    Equal rows are counted first, map-side, so a key with a third of all rows is one row
    here. Buckets by hash get running offsets; their table has at most ``buckets`` rows and
    is broadcast. Order within a bucket is by the keys, so a rerun gives the same numbers.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = counted.groupBy("_bucket").agg(F.sum("_n").alias("_size"))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_bucket", (F.sum("_size").over(upto) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(every).alias("total"))
    within = Window.partitionBy("_bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = (
        counted.withColumn("_end", F.sum("_n").over(within)).join(F.broadcast(offsets), "_bucket")
        .withColumn("_first", F.col("_offset") + F.col("_end") - F.col("_n"))
    )
    # One row per repeat; very many repeats come in runs, so no array grows with them.
    run = 100_000
    return (
        placed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / run))))
        .withColumn("_at", F.explode(F.sequence(
            F.col("_run") * run, F.least(F.col("_n"), (F.col("_run") + 1) * run) - 1)))
        .select(*keys, (F.col("_first") + F.col("_at")).alias("number"), "total")
    )
