"""Reproducible global shuffle into shards: row number, Feistel permutation, shard and slot.

Nulls: a null text has no bytes and the CRC of no bytes; a null id is an id like any other.
Empty texts count 8 bytes. Ties and repeated rows get numbers of their own; equal rows are
interchangeable. An empty table gives no rows. Other columns are not read, so clashing
names do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hirelake.llm.feistel import numbered, permuted

OVERHEAD = 8


def shard_rows(df: DataFrame, keys: list[str], shards: int, seed: int = 20_240_101) -> DataFrame:
    """``keys``, ``shard`` and ``slot``. Shard sizes differ by one row at most, and the slots
    of a shard have no gaps, since place ``p`` goes to shard ``p % shards``, slot ``p // shards``.
    Only the keys are shuffled, never the texts."""
    placed = numbered(df, keys).withColumn("_place", permuted(F.col("number"), F.col("total"), seed))
    return placed.select(
        *keys, (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20_240_101) -> DataFrame:
    """The law ``rows`` over documents; a further shard would move nearly every row, so
    ``grown_shard`` stays null."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    return shard_rows(rows, rows.columns, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
