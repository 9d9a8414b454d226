import sys
import time
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from hirelake.operators import copilot
from hirelake.session import shared_dir
from hirelake.sources import adapters, stores
from hirelake.streaming import flows

# Executors need the classes of this file but cannot import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

T0 = datetime(2024, 1, 1)


class Board(adapters.JobSource):
    """Three splits of five postings each."""

    def __init__(self, name, splits=3):
        self.name, self.count = name, splits

    def splits(self):
        return [f"{i:03d}" for i in range(self.count)]

    def pages(self, split, rows_per_page):
        rows = [(self.name, f"{split}-{i}", None, "{}", T0) for i in range(5)]
        for start in range(0, 5, rows_per_page):
            part = rows[start:start + rows_per_page]
            columns = [list(c) for c in zip(*part)]
            types = [pa.string()] * 4 + [pa.timestamp("us")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=adapters.RAW_COLUMNS)


def test_second_source_is_only_a_second_adapter(spark):
    for name in ("board_a", "board_b"):
        adapters.register_source(spark, name, Board(name))
        df = spark.read.format(name).load()
        assert df.count() == 15 and {r.source for r in df.collect()} == {name}
        assert df.rdd.getNumPartitions() == 3


def test_paging_and_pacing(spark):
    adapters.register_source(spark, "board_c", Board("c"))
    assert spark.read.format("board_c").option("rows_per_page", 2).load().count() == 15
    paced = spark.read.format("board_c").option("rows_per_page", 1).option("max_rps", 20).option("readers", 2).load()
    assert paced.rdd.getNumPartitions() == 2
    start = time.monotonic()
    assert paced.count() == 15
    assert time.monotonic() - start >= 9 * 2 / 20  # the longer reader has ten pages at half the rate


def test_ingest_resumes_where_it_stopped(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for splits, rows in ((2, 10), (2, 10), (3, 15)):
        adapters.register_source(spark, "board_d", Board("d", splits))
        flows.ingest_stream(spark, "board_d", out, checkpoint).awaitTermination()
        assert spark.read.parquet(out).distinct().count() == spark.read.parquet(out).count() == rows


def test_files_with_earlier_names_are_ingested_too(spark, tmp_path):
    landed, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    make = lambda day: spark.createDataFrame([(day, i) for i in range(10)], "day string, i int").coalesce(1)
    for many, day in enumerate(("2024-01-02", "2024-01-01", "2024-01-03"), 1):
        make(day).write.parquet(f"{landed}/on={day}")
        for _ in range(2):  # a pull without anything new adds nothing
            flows.ingest_files(spark, f"{landed}/*", make(day).schema, out, checkpoint).awaitTermination()
        assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == 10 * many


def test_landed_files_are_read_in_order_of_arrival(tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.parquet").write_text("")
        time.sleep(0.02)
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "x.parquet").write_text("")
    assert [s.rsplit("/", 1)[1] for s in adapters.LandedParquet(str(tmp_path)).splits()] == [
        "b.parquet", "a.parquet", "c.parquet"]


def test_the_feed_does_not_depend_on_batches(spark, tmp_path):
    people = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "profile_id bigint, embedding array<double>")
    jobs = [(i, [float(i), float(9 - i)]) for i in range(10)]
    schema, got = "job_id bigint, embedding array<double>", []
    for name, cuts in (("one", [jobs]), ("five", [jobs[i::5] for i in range(5)])):
        path = str(tmp_path / name)
        _files(spark, path, cuts, schema)
        stream = flows.replay(spark, path, spark.read.parquet(path).schema)
        flows.match_feed(stream, people, 2, 0.1, f"{path}-feed", f"{path}-cp").awaitTermination()
        feed = flows.read_feed(spark, f"{path}-feed").orderBy("profile_id", "rank")
        got.append([(r.profile_id, r["rank"], r.job_id, r.score) for r in feed.collect()])
    assert got[0] == got[1] and [r[2] for r in got[0]] == [9, 8, 0, 1]


def test_the_feed_writes_changes_only(spark, tmp_path):
    schema, path = "profile_id bigint, job_id bigint, score double", str(tmp_path / "found")
    _files(spark, path, [[(1, 5, 0.5), (1, 6, 0.4), (2, 5, 0.9)], [(1, 6, 0.4), (1, 7, 0.3)], [(1, 8, 0.6)], [(1, 9, 0.1)]], schema)
    changes = flows.drain(flows.best_so_far(flows.replay(spark, path, spark.read.parquet(path).schema), 2), "changes")
    got = sorted((r.profile_id, r.version, r.entered, r.job_id, r.score) for r in changes.collect())
    assert got == [(1, 1, True, 5, 0.5), (1, 1, True, 6, 0.4), (1, 2, False, 6, 0.4), (1, 2, True, 8, 0.6), (2, 1, True, 5, 0.9)]


def test_a_feed_goes_on_where_it_stopped(spark, tmp_path):
    people = spark.createDataFrame([(1, [1.0, 0.0])], "profile_id bigint, embedding array<double>")
    schema, path = "job_id bigint, embedding array<double>", str(tmp_path / "jobs")
    seen = []
    for cut in ([(1, [3.0, 4.0]), (2, [0.0, 1.0])], [(3, [4.0, 3.0])], [(4, [0.0, -1.0])]):
        _files(spark, path, [cut], schema)
        stream = flows.replay(spark, path, spark.read.parquet(path).schema)
        flows.match_feed(stream, people, 2, 0.1, f"{path}-feed", f"{path}-cp").awaitTermination()
        seen.append([(r.job_id, r.score) for r in flows.read_feed(spark, f"{path}-feed").orderBy("rank").collect()])
    assert seen == [[(1, 0.6)], [(3, 0.8), (1, 0.6)], [(3, 0.8), (1, 0.6)]]
    assert spark.read.parquet(f"{path}-feed/changes").count() == 2


def test_normalized_store_replaces_only_given_days(spark, tmp_path):
    path = str(tmp_path / "silver")
    make = lambda rows: spark.createDataFrame(rows, "posting_id string, fetched_at timestamp_ntz")
    stores.write_normalized(make([("a", T0), ("b", T0 + timedelta(days=1))]), path)
    stores.write_normalized(make([("c", T0)]), path)
    assert {r.posting_id for r in spark.read.parquet(path).collect()} == {"b", "c"}
    raw = str(tmp_path / "raw")
    for _ in range(2):
        stores.write_raw(make([("a", T0)]), raw)
    assert spark.read.parquet(raw).count() == 2


def test_profiles_are_whole_files(spark, tmp_path):
    (tmp_path / "ann.txt").write_text("one\ntwo\n")
    (tmp_path / "bob.txt").write_text("three")
    rows = {r.profile_id: r.text for r in stores.read_profiles(spark, str(tmp_path)).collect()}
    assert rows == {"ann": "one\ntwo\n", "bob": "three"}


def _files(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def test_streams_equal_batch_on_timely_data(spark, tmp_path):
    schema = "posting_id string, seen_at timestamp_ntz"
    batches = [[(f"p{(i * 7 + b) % 5}", T0 + timedelta(hours=b * 10 + i)) for i in range(8)] for b in range(3)]
    path = str(tmp_path / "in")
    _files(spark, path, batches, schema)
    kind = spark.read.parquet(path).schema
    updates = flows.drain(flows.seen_stream(flows.replay(spark, path, kind)), "seen", "update")
    state = {tuple(r) for r in flows.latest_versions(updates).collect()}
    from hirelake.operators.freshness import seen
    assert state == {tuple(r) for r in seen(spark.read.parquet(path)).collect()}
    once = flows.drain(flows.dedupe_stream(flows.replay(spark, path, kind), ["posting_id"], "seen_at", "9 days"), "d")
    assert sorted(r.posting_id for r in once.collect()) == [f"p{i}" for i in range(5)]


def test_reminders_fire_once_for_open_applications(spark, tmp_path):
    schema = "profile_id bigint, job_id bigint, status string, at timestamp_ntz, event_id bigint"
    batches = [
        [(1, 1, "saved", T0, 1), (1, 2, "applied", T0, 2), (2, 1, "saved", T0, 3)],
        [(1, 2, "rejected", T0 + timedelta(days=1), 4), (2, 1, "applied", T0 + timedelta(days=3), 5)],
        [(9, 9, "saved", T0 + timedelta(days=9), 6)],
    ]
    path = str(tmp_path / "in")
    _files(spark, path, batches, schema)
    kind = spark.read.parquet(path).schema
    got = flows.drain(flows.reminder_stream(flows.replay(spark, path, kind), 7, "0 seconds"), "r").collect()
    due = copilot.due_reminders(spark.read.parquet(path), T0 + timedelta(days=9), 7).collect()
    assert {(r.profile_id, r.job_id) for r in got} == {(r.profile_id, r.job_id) for r in due} == {(1, 1)}


def test_reminders_do_not_depend_on_batches(spark, tmp_path):
    schema = "profile_id bigint, job_id bigint, status string, at timestamp_ntz, event_id bigint"
    day = lambda n: T0 + timedelta(days=n)
    events = [(1, 1, "saved", day(0), 1), (7, 7, "saved", day(2), 2), (1, 1, "applied", day(10), 3),
              (1, 1, "rejected", day(12), 4), (9, 9, "saved", day(13), 5), (5, 5, "saved", day(21), 6)]
    got = []
    for name, cuts in (("one", [events]), ("many", [[e] for e in events])):
        path = str(tmp_path / name)
        _files(spark, path, cuts, schema)
        kind = spark.read.parquet(path).schema
        rows = flows.drain(flows.reminder_stream(flows.replay(spark, path, kind), 7, "0 seconds"), "r").collect()
        got.append(sorted((r.profile_id, r.job_id, r.status, r.since.day) for r in rows))
    assert got[0] == got[1] == [(1, 1, "saved", 1), (7, 7, "saved", 3), (9, 9, "saved", 14)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        shared_dir(Fake())
