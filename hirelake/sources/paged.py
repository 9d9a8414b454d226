"""Boards that are read page by page.

A board says how many pages each of its sections has and fetches one page. Sections are cut
into ranges of pages, so a long one is read by many tasks; a paced read deals the ranges to
a fixed number of readers that share one rate. A stream keeps the next page of every
section as its offset, so it goes on in the middle of one after a restart, and a section
that appears later is read from its start.

Filters on ``source`` choose sections, and lower bounds of ``fetched_at`` the first page to
fetch, found by halving since pages are in order of time; both are checked again by Spark.
Spark asks for that with ``spark.sql.python.filterPushdown.enabled``, which registering sets.
"""

from __future__ import annotations

import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition)

from hirelake.session import discard, materialize
from hirelake.sources.adapters import RAW_COLUMNS, RAW_SCHEMA, READERS

PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"
PAGES_PER_TASK = 64
PRESSED = ".json.zst"


class PagedBoard(ABC):
    """What a board with pages must offer. Pages are numbered from 0, never change once
    they are there, and are in order of ``fetched_at`` within their section, nulls first."""

    @abstractmethod
    def sections(self) -> list[str]:
        """Names of the sections; each is the ``source`` of its postings."""

    @abstractmethod
    def count(self, section: str) -> int:
        """How many whole pages the section has; it only grows."""

    @abstractmethod
    def page(self, section: str, number: int) -> list[dict]:
        """The postings of a page, with ``external_id, url, payload`` and ``fetched_at``."""


class JsonPages(PagedBoard):
    """Answers of a board's interface kept as they came: ``<path>/<section>/<number>.json`` with
    ``{"postings": [...]}``, or ``.json.zst`` pressed. Pages are looked for by doubling and halving, not by listing."""

    def __init__(self, path: str):
        self.path = path

    def _files(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def sections(self) -> list[str]:
        fs, root = self._files()
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.Directory and not f.base_name.startswith("_"))

    def _file(self, section: str, number: int) -> str | None:
        fs, root = self._files()
        found = fs.get_file_info([f"{root}/{section}/{number}{ending}" for ending in (PRESSED, ".json")])
        return next((f.path for f in found if f.type == pafs.FileType.File), None)

    def count(self, section: str) -> int:
        there = lambda n: self._file(section, n) is not None
        above = 1
        while there(above - 1):
            above *= 2
        return _first(above // 2, above - 1, lambda n: not there(n))

    def page(self, section: str, number: int) -> list[dict]:
        path = self._file(section, number)
        if path is None:
            raise FileNotFoundError(f"{self.path}/{section}/{number}.json")
        with self._files()[0].open_input_stream(path, compression="detect") as f:
            postings = json.loads(f.read())["postings"]
        return [{**p, "fetched_at": p["fetched_at"] and datetime.fromisoformat(p["fetched_at"])} for p in postings]


def write_pages(raw: DataFrame, path: str, rows_per_page: int) -> None:
    """Lay raw postings out as pressed ``JsonPages`` below ``path``; those without a source are left out.

    Rows are range-partitioned in order, so a hot section is the work of many tasks, and written
    once. Pages are numbered through one row per file and section, and then made by reading
    each file in its order, so postings are shuffled only once; a file's last page may be short.
    """
    posting = ["fetched_at", "external_id", "url", "payload"]
    kept = raw.where(F.col("source").isNotNull()).select("source", *posting)
    order = kept.repartitionByRange("source", *posting).sortWithinPartitions("source", *posting)
    placed = materialize(order, "placed", "zstd")
    name = F.col("_metadata.file_name")
    many = placed.groupBy("source", name.alias("file")).agg(F.count(F.lit(1)).alias("many"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")  # files are numbered as their ranges are
    before = Window.partitionBy("source").orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.ceil(F.col("many") / rows_per_page)).over(before), F.lit(0))
    files = materialize(many.withColumn("start", start).groupBy("file").agg(
        F.collect_list(F.struct("source", "start")).alias("sections")), "files")
    folder = placed._scratch

    def pages(file: pq.ParquetFile) -> Iterator[tuple[str, list[dict]]]:
        section, page = None, []
        for batch in file.iter_batches(rows_per_page):
            for row in batch.to_pylist():
                if page and (row["source"] != section or len(page) == rows_per_page):
                    yield section, page
                    page = []
                section = row.pop("source")
                page.append({**row, "fetched_at": row["fetched_at"] and row["fetched_at"].isoformat()})
        if page:
            yield section, page

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), (store, at) = JsonPages(path)._files(), JsonPages(folder)._files()
        for batch in batches:
            for row in batch.to_pylist():
                number = {s["source"]: s["start"] for s in row["sections"]}
                for section in number:
                    fs.create_dir(f"{root}/{section}", recursive=True)
                with store.open_input_file(f"{at}/{row['file']}") as f:
                    for section, page in pages(pq.ParquetFile(f)):
                        with fs.open_output_stream(f"{root}/{section}/{number[section]}{PRESSED}", compression="zstd") as out:
                            out.write(json.dumps({"postings": page}).encode())
                        number[section] += 1
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    n = max(1, files.count())
    files.repartition(n).mapInArrow(write, "files long").agg(F.sum("files")).collect()
    discard(placed, files)


def _first(low: int, high: int, true: Callable[[int], bool]) -> int:
    """The first number from ``low`` on at which ``true`` holds, ``high`` if none below it."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if true(middle) else (middle + 1, high)
    return low


@dataclass
class Pages(InputPartition):
    ranges: list[tuple[str, int, int]]


def _plan(ranges: list[tuple[str, int, int]], options: dict) -> list[Pages]:
    step = int(options.get("pages_per_task", PAGES_PER_TASK))
    cut = [(section, at, min(at + step, stop)) for section, start, stop in ranges for at in range(start, stop, step)]
    if options.get("max_rps"):
        readers = min(len(cut), _readers(options))
        return [Pages(cut[i::readers]) for i in range(readers)]
    return [Pages([one]) for one in cut]


def _readers(options: dict) -> int:
    return max(1, int(options.get("readers", READERS)))


def _fetch(board: PagedBoard, options: dict, partition: Pages) -> Iterator[pa.RecordBatch]:
    """One batch a page. Each paced reader has an equal share, so all together keep to the rate."""
    gap = _readers(options) / float(options["max_rps"]) if options.get("max_rps") else 0.0
    due = time.monotonic()
    for section, start, stop in partition.ranges:
        for number in range(start, stop):
            if gap:
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + gap
            postings = board.page(section, number)
            columns = [pa.array([section] * len(postings), pa.string())]
            columns += [pa.array([p.get(c) for p in postings], pa.string()) for c in RAW_COLUMNS[1:4]]
            columns.append(pa.array([p["fetched_at"] for p in postings], pa.timestamp("us")))
            yield pa.RecordBatch.from_arrays(columns, RAW_COLUMNS)


class _BatchReader(DataSourceReader):
    def __init__(self, board: PagedBoard, options: dict):
        self.board, self.options = board, options
        self.only, self.since = None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("source",):
                wanted = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.only = wanted if self.only is None else self.only & wanted
            if isinstance(one, (GreaterThan, GreaterThanOrEqual)) and one.attribute == ("fetched_at",):
                self.since = one.value if self.since is None else max(self.since, one.value)
            yield one

    def partitions(self):
        ranges = []
        for section in self.board.sections():
            if self.only is None or section in self.only:
                many = self.board.count(section)
                ranges.append((section, self._start(section, many), many))
        return _plan(ranges, self.options) or [Pages([])]

    def _start(self, section: str, many: int) -> int:
        """The first page that can hold a posting of ``since`` or later."""
        if self.since is None:
            return 0

        def late(number: int) -> bool:
            times = [p["fetched_at"] for p in self.board.page(section, number) if p["fetched_at"]]
            return bool(times) and max(times) >= self.since

        return _first(0, many, late)

    def read(self, partition):
        yield from _fetch(self.board, self.options, partition)


class _StreamReader(DataSourceStreamReader):
    """The offset is the next page of every section."""

    def __init__(self, board: PagedBoard, options: dict):
        self.board, self.options = board, options

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {section: self.board.count(section) for section in self.board.sections()}

    def partitions(self, start, end):
        return _plan([(s, start.get(s, 0), stop) for s, stop in sorted(end.items())], self.options)

    def read(self, partition):
        yield from _fetch(self.board, self.options, partition)


def register_board(spark: SparkSession, name: str, board: PagedBoard) -> str:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read the board.

    Options: ``pages_per_task``, ``max_rps`` (pages a second of all readers together) and
    ``readers`` (how many share that rate).
    """
    spark.conf.set(PUSH_DOWN, "true")

    class BoardSource(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return RAW_SCHEMA

        def reader(self, schema):
            return _BatchReader(board, dict(self.options))

        def streamReader(self, schema):
            return _StreamReader(board, dict(self.options))

    spark.dataSource.register(BoardSource)
    return name
