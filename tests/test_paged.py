import sys
import time
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from hirelake.operators.freshness import seen
from hirelake.sources import paged
from hirelake.streaming import flows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

T0 = datetime(2024, 1, 1)
SCHEMA = "source string, external_id string, url string, payload string, fetched_at timestamp_ntz"


class Board(paged.PagedBoard):
    """Sections of five postings a page; pages below ``closed`` must not be fetched."""

    def __init__(self, pages, closed=0):
        self.pages, self.closed = pages, closed

    def sections(self):
        return sorted(self.pages)

    def count(self, section):
        return self.pages[section]

    def page(self, section, number):
        if number < self.closed:
            raise ValueError(f"page {number} fetched")
        return [{"external_id": f"{number}-{i}", "url": None, "payload": "{}",
                 "fetched_at": T0 + timedelta(days=number)} for i in range(5)]


def ids(df):
    return sorted((r.source, r.external_id) for r in df.collect())


def every(pages):
    return sorted((s, f"{n}-{i}") for s, many in pages.items() for n in range(many) for i in range(5))


def test_one_long_section_is_read_by_many_tasks(spark):
    name = paged.register_board(spark, "long_board", Board({"a": 20, "b": 1, "c": 0}))
    df = spark.read.format(name).option("pages_per_task", 4).load()
    assert df.rdd.getNumPartitions() == 6 and ids(df) == every({"a": 20, "b": 1})
    none = paged.register_board(spark, "no_board", Board({}))
    assert spark.read.format(none).load().count() == 0


def test_readers_share_one_rate(spark):
    name = paged.register_board(spark, "slow_board", Board({"a": 20}))
    df = spark.read.format(name).option("pages_per_task", 2).option("max_rps", 20).option("readers", 2).load()
    assert df.rdd.getNumPartitions() == 2
    start = time.monotonic()
    assert df.count() == 100
    assert time.monotonic() - start >= 9 * 2 / 20


def test_a_stream_goes_on_inside_a_section(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for pages in ({"a": 2}, {"a": 2}, {"a": 5, "b": 3}, {"a": 6, "b": 3}):
        paged.register_board(spark, "growing_board", Board(pages))
        flows.ingest_stream(spark, "growing_board", out, checkpoint, options={"pages_per_task": 2}).awaitTermination()
        assert ids(spark.read.parquet(out)) == every(pages)  # nothing twice, nothing lost


def test_filters_reach_the_board(spark):
    # Halving 16 pages looks at 8, 12 and later ones only.
    name = paged.register_board(spark, "closed_board", Board({"a": 16, "b": 16}, closed=8))
    since = F.lit(T0 + timedelta(days=12)).cast("timestamp_ntz")
    got = spark.read.format(name).load().where((F.col("source") == "a") & (F.col("fetched_at") >= since))
    assert ids(got) == [("a", x) for x in sorted(f"{n}-{i}" for n in range(12, 16) for i in range(5))]
    with pytest.raises(Exception, match="page 0 fetched"):
        spark.read.format(name).load().where(F.col("source") == "a").count()
    reader = paged._BatchReader(Board({"a": 16, "b": 16}), {})
    assert len(list(reader.pushFilters([paged.EqualTo(("source",), "a"), paged.In(("source",), ("a", "b")),
                                        paged.GreaterThan(("fetched_at",), T0 + timedelta(days=9))]))) == 3
    assert [p.ranges for p in reader.partitions()] == [[("a", 9, 16)]]


def test_pages_in_files_hold_every_posting_in_order(spark, tmp_path):
    rows = [("hot" if i % 3 else f"s{i % 7}", str(i), None, "{}", None if i % 50 == 0 else T0 + timedelta(hours=i))
            for i in range(700)] + [("hot", "1", None, "{}", T0)] * 3 + [(None, "x", None, "{}", T0)]
    raw = spark.createDataFrame(rows, SCHEMA).repartition(4)
    path = str(tmp_path / "board")
    paged.write_pages(raw, path, 20)
    board = paged.JsonPages(path)
    got = []
    for section in board.sections():
        whole = [(section, p["external_id"], p["url"], p["payload"], p["fetched_at"])
                 for n in range(board.count(section)) for p in board.page(section, n)]
        times = [r[4] or datetime.min for r in whole]
        assert times == sorted(times)
        got += whole
    assert sorted(map(str, got)) == sorted(str(r) for r in rows if r[0])
    name = paged.register_board(spark, "json_board", board)
    df = spark.read.format(name).option("pages_per_task", 3).load()
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(map(str, got))
    assert board.count("none") == 0


# ---- sightings whose state ends -----------------------------------------------------------------

def _replayed(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, "posting_id string, seen_at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return flows.replay(spark, path, spark.read.parquet(path).schema)


def test_state_of_sightings_stays_flat_and_the_snapshot_is_whole(spark, tmp_path):
    # Every day ten new postings, each seen on three days; one comes back after a long while.
    day = lambda n, h=0: T0 + timedelta(days=n, hours=h)
    days = [[(f"p{d - age}-{i}", day(d, i)) for age in range(min(d, 2) + 1) for i in range(10)] for d in range(14)]
    days[12] += [("p0-1", day(12, 3)), ("p0-1", day(12, 2))]
    days[13] += [(None, day(13)), ("p0-1", day(13, 1))]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = flows.seen_spells(_replayed(spark, path, days), 3, "1 day")
    query = flows.to_batches(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"),
                             str(tmp_path / "cp"), "update")
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    log = spark.read.parquet(out)
    # The keys of seven days are in sight at once; later on only the two that come up beside them are
    # held in addition, though twice as many were seen.
    assert max(held[:10]) == 70 and max(held) <= 72
    assert log.where("ended").where("posting_id = 'p0-1'").count() == 1
    want = {tuple(r) for r in seen(spark.read.parquet(path)).collect()}
    assert {tuple(r) for r in flows.seen_of_spells(log).collect()} == want


def test_spells_do_not_depend_on_the_groups_of_keys(spark, tmp_path):
    # Keys beyond what a double holds; some end, one of them comes back, one has no key.
    day, big = lambda n, h=0: T0 + timedelta(days=n, hours=h), 2**60
    days = [[(big + i, day(d, i)) for i in range(6) if d % (i + 1) == 0 or i < 2] for d in range(0, 12, 2)]
    days[2] += [(None, day(4, 1)), (big + 9, day(4, 2)), (big + 9, day(4))]
    path = str(tmp_path / "in")
    for rows in days:
        spark.createDataFrame(rows, "posting_id bigint, seen_at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    logs = []
    for groups in (65_536, 2):
        stream = flows.seen_spells(flows.replay(spark, path, spark.read.parquet(path).schema), 3, "0 days", groups=groups)
        query = flows.to_batches(stream, lambda b, n, g=groups: b.write.mode("overwrite").parquet(f"{tmp_path}/{g}/batch={n}"),
                                 str(tmp_path / f"cp{groups}"), "update")
        query.awaitTermination()
        held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
        logs.append((spark.read.parquet(f"{tmp_path}/{groups}"), held))
    (each, many), (few, two) = logs
    assert two <= 2 < many  # a group is one row of state
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert rows(few) == rows(each) and each.where("ended").count() > 3
    assert rows(flows.seen_of_spells(few)) == rows(seen(spark.read.parquet(path)))


def test_pages_are_pressed_and_plain_ones_are_read_too(spark, tmp_path):
    rows = [("a", str(i), "u", "{}" * 200, T0 + timedelta(hours=i)) for i in range(45)]
    path = tmp_path / "board"
    paged.write_pages(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(path), 10)
    files = sorted((path / "a").glob("*.json*"))
    board = paged.JsonPages(str(path))
    assert files and all(f.name.endswith(".json.zst") for f in files) and sum(f.stat().st_size for f in files) < 45 * 200
    assert board.count("a") == len(files)
    (path / "a" / f"{len(files)}.json").write_text('{"postings": [{"external_id": "x", "fetched_at": null}]}')
    assert board.count("a") == len(files) + 1 and board.page("a", len(files)) == [{"external_id": "x", "fetched_at": None}]
    with pytest.raises(FileNotFoundError):
        board.page("a", len(files) + 1)
