"""Token ids in training order: packed sequences in fixed-stride shards.

Every document's ids and an end id are packed one after the other into sequences of
``LENGTH`` ids, by each task for the rows that it reads; only a task's last sequence is
filled up, with end ids. A keyed Feistel permutation with cycle walking gives every
sequence a global slot. Ranges of slots are the shards, each the work of one task and a file of
equal strides, so slot ``s`` is ``LENGTH`` ids at a place that can be computed, and reading
can resume anywhere. A file is written under a task's own name and then renamed, so a task
that runs again leaves the same file. The order hangs on how Spark cuts the table into
tasks: the same files read with the same ``spark.sql.files`` settings give the same order.

Null and empty texts are an end id alone. Repeated rows are documents like others. An
empty table writes no file. Columns other than the text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hirelake.llm.feistel import permuted
from hirelake.llm.subwords import VOCABULARY, Subwords
from hirelake.session import fresh_dir

LENGTH = 2048
PER_SHARD = 4096


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """``part, at, n_tokens, n_docs, body``: the sequences of each task in order."""
    shared = docs.sparkSession.sparkContext.broadcast(Subwords(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, part = shared.value, TaskContext.get().partitionId()
        end = np.array([subwords.end], np.uint16)
        rest, at = np.empty(0, np.uint16), 0

        def rows(ids: np.ndarray, real: int) -> pa.RecordBatch:
            nonlocal at
            ids = ids.reshape(-1, length)
            many, ends = len(ids), (ids == subwords.end).sum(1)
            ends[-1] -= length - real
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * many, pa.int32()), pa.array(range(at, at + many), pa.int64()),
                 pa.array([length] * (many - 1) + [real], pa.int32()), pa.array(ends, pa.int32()),
                 pa.array([x.tobytes() for x in ids], pa.binary())], ["part", "at", "n_tokens", "n_docs", "body"])
            at += many
            return out

        for batch in batches:
            pieces = [rest]
            for text in batch.column("text").to_pylist():
                pieces += [subwords.encode(text), end]
            rest = np.concatenate(pieces)
            whole = len(rest) // length * length
            if whole:
                yield rows(rest[:whole], length)
                rest = rest[whole:]
        if len(rest):
            yield rows(np.concatenate([rest, np.repeat(end, length - len(rest))]), len(rest))

    return docs.select("text").mapInArrow(run, "part int, at long, n_tokens int, n_docs int, body binary")


def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their bodies compressed one by one."""
    press = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        at = batch.schema.get_field_index("body")
        yield batch.set_column(at, "body", pa.array([press.compress(b) for b in batch.column(at).to_pylist()], pa.binary()))


def in_order(sequences: DataFrame, seed: int) -> DataFrame:
    """Give every sequence its ``slot``. The window and the broadcast see one row of two
    numbers for each task of the packing stage, never sequences."""
    parts = sequences.groupBy("part").agg(F.count(F.lit(1)).alias("many"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = parts.select(F.col("part").alias("_part"), (F.sum("many").over(upto) - F.col("many")).alias("_offset"),
                           F.sum("many").over(every).alias("_total"))
    return sequences.join(F.broadcast(offsets), F.col("part") == F.col("_part")).withColumn(
        "slot", permuted(F.col("_offset") + F.col("at"), F.col("_total"), seed))


def write_shards(docs: DataFrame, path: str, seed: int = 20_240_101, vocabulary: str = VOCABULARY,
                 length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards below ``path``, a folder that all executors share, and return a row
    for every sequence: ``slot, shard, offset`` (in bytes), ``n_tokens``,
    ``n_docs`` (that end in it) and ``crc32``."""
    # Neighbours compress best together, so the table is pressed by its pages; in the shuffle each is alone.
    packed_at = fresh_dir(docs.sparkSession, "packed")
    packed(docs, vocabulary, length).write.option("compression", "zstd").parquet(packed_at)
    sequences = docs.sparkSession.read.parquet(packed_at)
    placed = in_order(sequences, seed).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    lean = placed.select("slot", "shard", "n_tokens", "n_docs", "body")
    lean = lean.mapInArrow(pressed, lean.schema)
    stride = length * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pafs.FileSystem.from_uri(path)
        unpress, now, out, name = zstandard.ZstdDecompressor(), None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                system.move(name, f"{folder}/shard-{now:08d}.bin")

        for batch in batches:
            slots, shards = batch.column("slot").to_pylist(), batch.column("shard").to_pylist()
            sums = []
            for shard, body in zip(shards, batch.column("body").to_pylist()):
                if shard != now:
                    close()
                    now, name = shard, f"{folder}/_writing-{shard:08d}-{uuid.uuid4().hex}"
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(name)
                ids = unpress.decompress(body, max_output_size=stride)
                out.write(ids)
                sums.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("shard"), pa.array([s % per_shard * stride for s in slots], pa.int64()),
                 batch.column("n_tokens"), batch.column("n_docs"), pa.array(sums, pa.int64())],
                ["slot", "shard", "offset", "n_tokens", "n_docs", "crc32"])
        close()

    # A shard numbers its own task, so nothing is sampled to find ranges and the bodies are pressed once.
    many = max(1, -(-sequences.count() // per_shard))
    return lean.repartitionById(many, "shard").sortWithinPartitions("slot").mapInArrow(
        run, "slot long, shard int, offset long, n_tokens int, n_docs int, crc32 long")


def read_from(spark: SparkSession, path: str, slot: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """Resume: ``count`` sequences from ``slot`` on, as rows of ids."""
    system, folder = pafs.FileSystem.from_uri(path)
    out = []
    while len(out) < count:
        with system.open_input_file(f"{folder}/shard-{slot // per_shard:08d}.bin") as shard:
            shard.seek(slot % per_shard * length * 2)
            here = min(count - len(out), per_shard - slot % per_shard)
            data = np.frombuffer(shard.read(here * length * 2), np.uint16).reshape(-1, length)
        if not len(data):
            break
        out.extend(data)
        slot += len(data)
    return np.array(out, np.uint16).reshape(-1, length)
