"""Stored sketches against the exact queries, within their stated error."""

import datetime as dt
import math


import __spark_entry__ as driver
from hirelake.operators import sketches
from hirelake.plans import roles

SF = "/root/testdata/sf0.01"
RANK_ERROR = 0.008  # of KLL with k = 400, at 99 %; tests allow twice that


def ranks(values, x):
    """Lowest and highest share of the values that ``x`` can stand at."""
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def holds(values, x, p, slack=2 * RANK_ERROR):
    low, high = ranks(values, x)
    return low - slack - 1 / len(values) <= p <= high + slack + 1 / len(values)


def values_by(df, key, value):
    out = {}
    for r in df.select(key, value).collect():
        out.setdefault(r[0], []).append(float(r[1]))
    return out


def test_pay_by_role_within_the_rank_error(spark):
    have = values_by(roles.observed_jobs(spark, SF), "role", "comp")
    rows = driver.queries()["comp_by_role_sketch"](spark, SF).collect()
    assert {r.role: r.n for r in rows} == {k: len(v) for k, v in have.items()}
    assert max(len(v) for v in have.values()) > 5000  # more than a sketch keeps
    for r in rows:
        assert all(holds(have[r.role], r[name], p) for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))


def test_latency_within_the_rank_error(spark):
    have = values_by(roles.ops_events(spark, SF), "source", "latency")
    for r in driver.queries()["latency_sketch"](spark, SF).collect():
        assert all(holds(have[r.source], r[name], p) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


def test_trend_has_every_period_of_the_exact_one(spark):
    exact = {(r.role, r.period): r for r in driver.queries()["comp_trend"](spark, SF).collect()}
    near = {(r.role, r.period): r for r in driver.queries()["comp_trend_sketch"](spark, SF).collect()}
    assert exact.keys() == near.keys()
    off = [abs(near[x].p50 / exact[x].p50 - 1) for x in exact]
    assert sum(off) / len(off) < 0.02


def test_skill_shares_within_the_error_of_distinct_counts(spark):
    exact = {(r.skill, r.period): r for r in driver.queries()["skill_trend"](spark, SF).collect() if r.n_asking}
    near = {(r.skill, r.period): r for r in driver.queries()["skill_trend_sketch"](spark, SF).collect()}
    assert exact.keys() == near.keys()
    for x, r in exact.items():
        assert abs(near[x].n - r.n_asking) <= 1 + 0.04 * r.n_asking  # five standard errors
        assert abs(near[x].n_all - r.n_jobs) <= 1 + 0.04 * r.n_jobs


def frame(spark, days, scale=1.0):
    rows = [(f"k{i % 2}", dt.datetime(2024, 1, d, 5), scale * float(i), ["a", "b"][: i % 3], i % 40) for d in days for i in range(100)]
    rows += [("k0", dt.datetime(2024, 1, days[0]), x, None, None) for x in (None, float("nan"), float("inf"))] + [(None, None, 5.0, ["a"], 1)]
    return spark.createDataFrame(rows, "role string, at timestamp, comp double, skills array<string>, posting_id int")


def test_a_day_is_added_without_touching_others_and_replaced_when_given_again(spark, tmp_path):
    path = str(tmp_path / "pay")
    sketches.add_quantile_days(frame(spark, [1, 2]), path, ["role"], "comp", "at")
    before = {f for f in spark.read.parquet(path).inputFiles() if "2024" in f}
    sketches.add_quantile_days(frame(spark, [3]), path, ["role"], "comp", "at")
    assert before < set(spark.read.parquet(path).inputFiles())
    got = {r.role: r for r in sketches.quantiles_from(spark.read.parquet(path), ["role"], {"low": 0.0, "p50": 0.5, "high": 1.0}).collect()}
    assert got["k0"].n == 150 and got["k1"].n == 150 and got[None].n == 1
    assert (got["k0"].low, got["k0"].high) == (0.0, 98.0) and abs(got["k0"].p50 - 49) <= 4
    sketches.add_quantile_days(frame(spark, [3], 1000.0), path, ["role"], "comp", "at")
    again = {r.role: r for r in sketches.quantiles_from(spark.read.parquet(path), ["role"], {"high": 1.0}).collect()}
    assert again["k0"].n == 150 and again["k0"].high == 98_000.0
    months = sketches.quantiles_from(spark.read.parquet(path).where("day = DATE'2024-01-03'"), [], {"high": 1.0}, "month").collect()
    assert [(r.n, r.high) for r in months] == [(100, 99_000.0)]


def test_distinct_ids_over_days_are_a_union(spark, tmp_path):
    path = str(tmp_path / "skills")
    for d in (1, 2, 3):
        sketches.add_distinct_days(frame(spark, [d]), path, "skills", "posting_id", "at")
    rows = {r.key: r for r in sketches.distinct_from(spark.read.parquet(path)).collect()}

    want = {"a": {i % 40 for i in range(100) if i % 3 > 0}, "b": {i % 40 for i in range(100) if i % 3 == 2}}
    assert {k: r.n for k, r in rows.items()} == {k: len(v) for k, v in want.items()}
    assert math.isclose(rows["a"].share, rows["a"].n / rows["a"].n_all)
    by = sketches.distinct_from(spark.read.parquet(path), "day").where("period is not null").collect()
    assert {(r.key, r.n) for r in by} == {(k, len(v)) for k, v in want.items()} and len(by) == 6


def test_empty_history(spark, tmp_path):
    path = str(tmp_path / "none")
    sketches.add_quantile_days(frame(spark, [1]).limit(0), path, ["role"], "comp", "at")
    schema = "role string, n long, low double, high double, sketch binary, day date"
    assert sketches.quantiles_from(spark.read.schema(schema).parquet(path), ["role"], {"p50": 0.5}).count() == 0
