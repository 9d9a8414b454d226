"""Compare two frames block by block in bounded tiles.

Both sides of a block are hashed into tiles of about ``tile_rows`` rows, and each
pair of tiles is one small group. A hot block becomes many tile pairs instead of
one huge group, and a kernel returns only its few best rows, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hirelake.plans.skew import HOT_ROWS, join_counted, null_safe_join


def tiled(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: list[str],
    kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    tile_rows: int = 4096, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Run ``kernel`` on every pair of tiles that share a block."""
    block = list(block)
    # Fresh column ids: both sides may come from one frame.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    if not block:
        block = ["_block"]
        left, right = left.withColumn("_block", F.lit(0)), right.withColumn("_block", F.lit(0))
    tiles = lambda n: F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias(n)
    shape = null_safe_join(
        left.groupBy(*block).agg(tiles("_tiles_l"), F.count(F.lit(1)).alias("_nl")),
        right.groupBy(*block).agg(tiles("_tiles_r"), F.count(F.lit(1)).alias("_nr")), block,
    ).withColumn("_n", F.greatest("_nl", "_nr")).drop("_nl", "_nr")

    def place(df: DataFrame, row_id: str, own: str, other: str) -> DataFrame:
        mine, theirs = f"_tiles_{own}", f"_tiles_{other}"
        return (
            join_counted(df, shape, block, hot_rows=hot_rows, null_safe=True)
            .withColumn(f"_{own}", F.pmod(F.xxhash64(row_id), F.col(mine)).cast("int"))
            .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)))
            .drop(mine, theirs)
        )

    keys = [*block, "_l", "_r"]
    return (
        place(left, left_id, "l", "r").groupBy(*keys)
        .cogroup(place(right, right_id, "r", "l").groupBy(*keys))
        .applyInPandas(kernel, schema)
    )
