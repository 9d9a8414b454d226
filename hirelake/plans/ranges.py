"""Spans and points as equal keys, so that "a point within a span" is an equi-join.

A span of whole numbers is cut into aligned blocks of 2^level numbers, at most two a level
below the top one, and a point lies in one block of every level. The blocks of a span do not
overlap, so a span and a point in it meet exactly once, and a long span costs no more rows
than its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOP = 15


def _block(level: int, cell: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), cell.cast("bigint").alias("cell"))


def blocks_of_span(start: Column, stop: Column) -> Column:
    """``array<struct<level, cell>>`` of ``start`` to ``stop``, the latter not included. An empty
    span or one with a null end has none."""
    found = []
    for level in range(TOP):
        first, end = F.ceil(start / 2 ** level), F.floor(stop / 2 ** level)
        found.append(F.when((first < end) & (F.pmod(first, F.lit(2)) == 1), _block(level, first)))
        found.append(F.when((first < end) & (F.pmod(end, F.lit(2)) == 1), _block(level, end - 1)))
    first, end = F.ceil(start / 2 ** TOP), F.floor(stop / 2 ** TOP)
    rest = F.when(first < end, F.transform(F.sequence(first, end - 1), lambda c: _block(TOP, c)))
    return F.concat(F.array_compact(F.array(*found)), F.coalesce(rest, F.array().cast("array<struct<level:int,cell:bigint>>")))


def blocks_of_point(at: Column) -> Column:
    """The block of every level that holds a point."""
    return F.array(*[_block(level, F.floor(at / 2 ** level)) for level in range(TOP + 1)])
