"""Source adapters: any job board becomes a Spark data source.

An adapter says what can be fetched in parallel (``splits``) and yields pages of raw
postings for one split; batch reads, streams, paging and pacing are shared. A new
source is a new adapter, and nothing downstream changes.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RAW_SCHEMA = "source string, external_id string, url string, payload string, fetched_at timestamp_ntz"
RAW_COLUMNS = ["source", "external_id", "url", "payload", "fetched_at"]
ROWS_PER_PAGE = 10_000
READERS = 8


class JobSource(ABC):
    """What a board must offer."""

    @abstractmethod
    def splits(self) -> list[str]:
        """Names of the parts that may be fetched independently, in order of arrival.

        Later calls may only append, so a stream can remember how many it has seen.
        """

    @abstractmethod
    def pages(self, split: str, rows_per_page: int) -> Iterator[pa.RecordBatch]:
        """Pages of raw postings (``RAW_COLUMNS``) of one split."""


class LandedParquet(JobSource):
    """Payloads another process landed as Parquet files, one split per file, by time of arrival.

    For continuous pulls of landed files use ``flows.ingest_files``: Spark's own file stream
    remembers every file, whatever its name and time.
    """

    def __init__(self, path: str):
        self.path = path

    def splits(self) -> list[str]:
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        landed = [f for f in found if f.is_file and f.path.endswith(".parquet") and "/_" not in f.path[len(root):]]
        return [f.path for f in sorted(landed, key=lambda f: (f.mtime_ns or 0, f.path))]

    def pages(self, split: str, rows_per_page: int) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        with fs.open_input_file(split) as f:
            yield from pq.ParquetFile(f).iter_batches(rows_per_page, columns=RAW_COLUMNS)


@dataclass
class SplitPartition(InputPartition):
    splits: list[str]


def _plan(splits: list[str], options: dict) -> list[SplitPartition]:
    if not splits:
        return []
    if options.get("max_rps"):
        readers = min(len(splits), _readers(options))
        return [SplitPartition(splits[i::readers]) for i in range(readers)]
    return [SplitPartition([s]) for s in splits]


def _readers(options: dict) -> int:
    return max(1, int(options.get("readers", READERS)))


def _read(adapter: JobSource, options: dict, partition: SplitPartition) -> Iterator[pa.RecordBatch]:
    rows = int(options.get("rows_per_page", ROWS_PER_PAGE))
    # Each paced reader has an equal share, so all together never exceed the rate.
    gap = _readers(options) / float(options["max_rps"]) if options.get("max_rps") else 0.0
    due = time.monotonic()
    for split in partition.splits:
        for page in adapter.pages(split, rows):
            if gap:
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + gap
            yield page


class _BatchReader(DataSourceReader):
    def __init__(self, adapter: JobSource, options: dict):
        self.adapter, self.options = adapter, options

    def partitions(self):
        return _plan(self.adapter.splits(), self.options) or [SplitPartition([])]

    def read(self, partition):
        yield from _read(self.adapter, self.options, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets count the splits seen, so a restart resumes after the last commit."""

    def __init__(self, adapter: JobSource, options: dict):
        self.adapter, self.options = adapter, options

    def initialOffset(self):
        return {"splits": 0}

    def latestOffset(self):
        return {"splits": len(self.adapter.splits())}

    def partitions(self, start, end):
        return _plan(self.adapter.splits()[start["splits"]:end["splits"]], self.options)

    def read(self, partition):
        yield from _read(self.adapter, self.options, partition)


def register_source(spark: SparkSession, name: str, adapter: JobSource) -> str:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read the adapter.

    Options: ``rows_per_page``, ``max_rps`` (pages per second of all readers together) and
    ``readers`` (how many share that rate).
    """

    class PostingSource(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return RAW_SCHEMA

        def reader(self, schema):
            return _BatchReader(adapter, dict(self.options))

        def streamReader(self, schema):
            return _StreamReader(adapter, dict(self.options))

    spark.dataSource.register(PostingSource)
    return name
