"""Joining rows to one counted row per key, with hot keys taken out of the shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from hirelake.session import materialize

HOT_ROWS = 1_000_000
HOT_KEYS = 10_000  # at most so many keys are broadcast


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c).alias(c) for c in right.columns if c not in keys],
    )
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    out = left.join(renamed, on, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_r_{k}" for k in keys])


@dataclass
class Counted:
    """A written table with one row per key and how many rows have it."""

    table: DataFrame
    count: str
    total: int
    most: int


def counted_table(counted: DataFrame, count: str = "_n") -> Counted:
    table = materialize(counted, "counted")
    total, most = (n or 0 for n in table.agg(F.sum(count), F.max(count)).first())
    return Counted(table, count, total, most)


def join_counted(rows: DataFrame, counted: DataFrame | Counted, keys: list[str], count: str = "_n",
                 hot_rows: int = HOT_ROWS, null_safe: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``counted``: one row per key and how many rows have it.

    ``counted`` is written first, so its size is known. A key is hot with more than
    ``hot_rows`` rows and more than a share of 1 / ``HOT_KEYS`` of them all; so hot keys
    number fewer than ``HOT_KEYS`` at any size. They are broadcast, and their rows never
    meet in one task. The other keys join as Catalyst sees fit.
    """
    def join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        return null_safe_join(left, right, keys, how) if null_safe else left.join(right, keys, how)

    found = counted if isinstance(counted, Counted) else counted_table(counted, count)
    table, count = found.table, found.count
    bound = max(hot_rows, found.total // HOT_KEYS)
    if found.most <= bound:
        return join(rows, table).drop(count)
    hot = table.where(F.col(count) > bound)
    heavy = join(rows, F.broadcast(hot))
    rest = join(rows, F.broadcast(hot.select(*keys)), "left_anti")
    light = join(rest, table.where(F.col(count) <= bound))
    return heavy.unionByName(light).drop(count)
