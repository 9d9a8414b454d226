import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from hirelake.functions import text as tx
from hirelake.operators import aliases, copilot, freshness, market, normalize, skills
from hirelake.plans.quantiles import exact_percentiles
from hirelake.plans.series import running_total, with_neighbour

T0 = datetime(2024, 1, 1)
EVENTS = "profile_id bigint, job_id bigint, status string, at timestamp_ntz, event_id bigint"


def test_snapshot_update_equals_full_recompute(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randint(0, 9)}", T0 + timedelta(hours=rng.randint(0, 900))) for _ in range(120)]
    make = lambda r: spark.createDataFrame(r, "posting_id string, seen_at timestamp_ntz")
    whole = sorted(map(tuple, freshness.seen(make(rows)).collect()))
    for cut in (0, 1, 60, 120):
        state = freshness.seen_update(freshness.seen(make(rows[:cut])), make(rows[cut:]))
        assert sorted(map(tuple, state.collect())) == whole


def test_added_stale_and_current(spark):
    jobs = spark.createDataFrame([
        ("a", T0, T0 + timedelta(days=9)), ("b", T0 + timedelta(days=9, hours=1), T0 + timedelta(days=10)),
        ("c", T0, T0 + timedelta(days=1))], "posting_id string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    now = T0 + timedelta(days=10)
    ids = lambda df: {r.posting_id for r in df.collect()}
    assert ids(freshness.added_since(jobs, now, 24)) == {"b"}
    assert ids(freshness.stale(jobs, now, 5)) == {"c"}
    assert ids(freshness.current_openings(jobs, now, 5)) == {"a", "b"}
    days = {r.day.day: r.open_postings for r in freshness.openings_by_day(jobs).collect()}
    assert days == {1: 2, 2: 2, **{d: 1 for d in range(3, 10)}, 10: 2, 11: 1}


def test_neighbours_cross_buckets_and_ties(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, None, 2]), T0 + timedelta(hours=rng.randint(0, 200)), i, f"s{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "k bigint, at timestamp_ntz, e bigint, v string")
    for forward in (False, True):
        got = {r.e: r.x for r in with_neighbour(frame, ["k"], "at", "e", "v", "x", forward).collect()}
        want = {}
        for key in (1, None, 2):
            own = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1], r[2]), reverse=forward)
            want.update({b[2]: (a[3] if a else None) for a, b in zip([None, *own], own)})
        assert got == want


def test_running_total(spark):
    rng = random.Random(6)
    rows = [(T0 + timedelta(minutes=rng.randint(0, 5000)), rng.choice([1, -1])) for _ in range(200)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, delta bigint")
    got = {r.ts: r.depth for r in running_total(frame, "ts", "delta", "depth").collect()}
    assert got == {t: sum(d for u, d in rows if u <= t) for t, _ in rows}


def test_running_total_of_a_busy_second(spark):
    rng = random.Random(7)
    rows = [(T0 + timedelta(microseconds=rng.randint(0, 900_000)), rng.choice([1, -1])) for _ in range(300)]
    rows += [(T0 + timedelta(seconds=s), 5) for s in (-1, 1, 3599, 3600)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, delta bigint")
    got = {r.ts: r.depth for r in running_total(frame, "ts", "delta", "depth").collect()}
    assert got == {t: sum(d for u, d in rows if u <= t) for t, _ in rows}


def test_trends_see_periods_without_rows(spark):
    day = lambda m: datetime(2024, m, 5)
    rows = [("a", day(1), 10.0, ["x", "y"]), ("b", day(2), 30.0, ["x"]), ("c", day(4), 60.0, ["y"])]
    jobs = spark.createDataFrame([("r", *r) for r in rows],
                                 "role string, posting_id string, seen_at timestamp_ntz, comp double, skills array<string>")
    assert [(r.period.month, r.change) for r in market.comp_trend(jobs).orderBy("period").collect()] == [
        (1, None), (2, 20.0), (4, None)]
    got = {(r.skill, r.period.month): (r.n_asking, r.n_jobs, r.share, r.change)
           for r in market.skill_trend(jobs, bucket="month").collect()}
    assert got == {
        ("x", 1): (1, 1, 1.0, None), ("x", 2): (1, 1, 1.0, 0.0), ("x", 3): (0, 0, None, None), ("x", 4): (0, 1, 0.0, None),
        ("y", 1): (1, 1, 1.0, None), ("y", 2): (0, 1, 0.0, -1.0), ("y", 3): (0, 0, None, None), ("y", 4): (1, 1, 1.0, None)}


def test_percentiles_of_crowded_bins(spark):
    """Bins of more rows than are ordered together are cut until they are small or of one value."""
    rng = np.random.default_rng(9)
    data = {"narrow": rng.uniform(0, 0.004, 3000), "near": 5e4 + rng.uniform(0, 1, 2000), "ties": rng.integers(0, 3, 900) / 1e3,
            "nested": np.concatenate([0.004 / 10.0 ** rng.integers(0, 60, 900), np.full(200, 1e-30)]),
            "below": -rng.uniform(0, 0.004, 700), None: rng.uniform(1, 1.001, 300)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("narrow", float("nan"))]
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    frame = spark.createDataFrame(rows, "k string, v double")
    for r in exact_percentiles(frame, ["k"], "v", probs, most=40).collect():
        assert r.n == len(data[r.k])
        for name, p in probs.items():
            assert np.isclose(r[name], np.quantile(data[r.k], p), rtol=1e-9, atol=0)


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(8)
    data = {"hot": rng.lognormal(3, 2, 900).round(2), "neg": rng.normal(0, 50, 101).round(1),
            "same": np.full(40, 7.0), "one": np.array([0.0]), None: rng.integers(-3, 3, 50).astype(float)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None)]
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs).collect()
    assert {r.k for r in got} == set(data)
    for r in got:
        assert r.n == len(data[r.k])
        for name, p in probs.items():
            assert abs(r[name] - np.quantile(data[r.k], p)) < 1e-9
    overall = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), [], "v", {"m": 0.5}).first()
    assert abs(overall.m - np.quantile(np.concatenate(list(data.values())), 0.5)) < 1e-9


def test_application_tracker(spark):
    rows = [
        (1, 1, "saved", T0, 1), (1, 1, "applied", T0 + timedelta(days=1), 2),
        (1, 1, "offer", T0 + timedelta(days=1), 3),  # simultaneous, and skips a stage
        (1, 2, "saved", T0, 4), (1, 2, "saved", T0 + timedelta(days=2), 5),  # repeated
        (2, 1, "applied", T0, 6), (2, 1, "saved", T0 + timedelta(days=3), 7),  # back
    ]
    events = spark.createDataFrame(rows, EVENTS)
    status = {(r.profile_id, r.job_id): r.status for r in copilot.current_status(events).collect()}
    assert status == {(1, 1): "offer", (1, 2): "saved", (2, 1): "saved"}
    assert {r.event_id for r in copilot.bad_transitions(events).collect()} == {3, 5, 7}
    due = copilot.due_reminders(events, T0 + timedelta(days=9), 7).collect()
    assert {(r.profile_id, r.job_id) for r in due} == {(1, 2)}
    line = copilot.status_timeline(events).where("profile_id = 1 AND job_id = 2").first()
    assert (line.saved, line.applied) == (T0, None)
    assert {r.status: r.n for r in copilot.pipeline_counts(events).collect()} == {"offer": 1, "saved": 2}


def test_skill_gap_and_tailoring(spark):
    jobs = spark.createDataFrame([("j1", "dev", ["go", "sql"]), ("j2", "dev", ["go"]), ("j3", "ops", ["bash"])],
                                 "posting_id string, role string, skills array<string>")
    needs = copilot.role_requirements(jobs)
    targets = spark.createDataFrame([(1, "dev"), (2, "ops")], "profile_id bigint, role string")
    owned = spark.createDataFrame([(1, "go"), (2, "go")], "profile_id bigint, skill string")
    gaps = copilot.skill_gap(targets, owned, needs, 0.5).collect()
    assert {(r.profile_id, r.skill, r.demand_rank) for r in gaps} == {(1, "sql", 2), (2, "bash", 1)}
    matches = spark.createDataFrame([(1, 5, ["go", "sql", "c"])], "profile_id bigint, job_id bigint, job_skills array<string>")
    counts = spark.createDataFrame([(1, "go", 9), (1, "sql", 1)], "profile_id bigint, skill string, mentions bigint")
    row = copilot.tailor(matches, counts, 3).first()
    assert (row.add, row.emphasize) == (["c"], ["sql"])


def test_payloads_of_two_sources_need_only_two_mappings(spark):
    schema = "source string, external_id string, url string, payload string, fetched_at timestamp_ntz"
    a = spark.createDataFrame([
        ("a", "1", "https://www.a.com/1/", '{"t": "Sr. Dev", "c": "X Inc", "pay": "$100k"}', T0),
        ("a", "2", None, "not json", T0), ("a", "3", "u", "{}", T0)], schema)
    b = spark.createDataFrame([("b", "1", "http://b.com/1", '{"job": {"name": "senior developer"}}', T0)], schema)
    out = normalize.union_sources([
        normalize.normalize(a, {"title": "$.t", "company": "$.c", "comp": "$.pay"}),
        normalize.normalize(b, {"title": "$.job.name"})])
    rows = {(r.source, r.external_id): r for r in out.collect()}
    assert rows["a", "1"].title_norm == rows["b", "1"].title_norm == "senior developer"
    assert rows["a", "1"].comp_min == 100_000.0 and rows["a", "1"].company_norm == "x"
    assert rows["a", "2"].title is None and rows["a", "3"].seniority is None
    assert rows["a", "1"].posting_id != rows["b", "1"].posting_id


def test_filters_reach_the_scan(spark, tmp_path):
    rows = [("a", "x", 10.0, "senior", T0)]
    path = str(tmp_path / "jobs")
    spark.createDataFrame(rows, "posting_id string, location string, comp_max double, seniority string, "
                                "last_seen timestamp_ntz").write.parquet(path)
    kept = normalize.apply_filters(spark.read.parquet(path), location="x", comp_floor=5.0, seniority="senior")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    for column in ("location", "comp_max", "seniority"):
        assert f"({column}" in plan.split("PushedFilters")[1]
    assert kept.count() == 1


def test_aliases_equal_brute_force_in_any_number_of_parts(spark):
    rnd = random.Random(3)
    letters = "abcdef"
    texts = [" ".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(200)] + [None, "", "a" * 9]
    phrases = {" ".join(rnd.choices(letters, k=rnd.randint(1, 5))) for _ in range(120)} | {"", "a  b"}
    entries = [(f"s{len(p) % 7}", p) for p in phrases] + [("other", next(iter(sorted(phrases - {""}))))] + [(None, "a"), ("x", None)]
    docs = spark.createDataFrame(list(enumerate(texts)), "posting_id bigint, description string")
    words = spark.createDataFrame(entries, "skill string, alias string")
    want = {(i, s) for i, t in enumerate(texts) for s, p in entries if s and p and t and len(p.split(" ")) <= 4
            and f" {p} " in f" {t} " and p.split()}
    split = docs.select("posting_id", tx.tokens("description").alias("w"))
    for part_bytes in (1 << 24, 2000):
        got = aliases.mentions(split, words, "posting_id", "w", "alias", "skill", 4, part_bytes)
        assert {tuple(r) for r in got.collect()} == want
    none = aliases.mentions(split, words.limit(0), "posting_id", "w", "alias", "skill", 4)
    assert none.count() == 0


def test_skills_by_alias(spark):
    docs = spark.createDataFrame([(1, "We use Apache Spark, and SQL."), (2, ""), (3, None), (4, "spark spark")],
                                 "posting_id bigint, description string")
    words = spark.createDataFrame([("Spark", "apache spark"), ("Spark", "spark"), ("SQL", "sql")],
                                  "skill string, alias string")
    got = {r.posting_id: r.skills for r in skills.extract_skills(docs, words).collect()}
    assert got == {1: ["SQL", "Spark"], 4: ["Spark"]}
    top = skills.keywords(docs, 1).where(F.col("posting_id") == 4).first()
    assert (top.term, top.tf) == ("spark", 2)


def test_blocks_of_spans_and_points_meet_once(spark):
    from hirelake.plans.ranges import blocks_of_point, blocks_of_span
    rng = random.Random(5)
    ends = [0, 1, 2, 3, 7, 8, -1, -8, 2 ** 15, 2 ** 16 + 1, 3 * 2 ** 15 - 1, -2 ** 15 - 5]
    spans = [(a, b) for a in ends for b in ends] + [(a, a + rng.randrange(400)) for a in rng.sample(range(-500, 500), 60)]
    at = sorted({x + d for x in ends for d in (-1, 0, 1)} | set(rng.sample(range(-600, 900), 60)))
    left = spark.createDataFrame([(i, *s) for i, s in enumerate(spans + [(None, 3), (3, None)])], "i int, a int, b int")
    right = spark.createDataFrame([(x,) for x in at] + [(None,)], "x int")
    cut = left.select("i", F.inline(blocks_of_span(F.col("a"), F.col("b"))))
    met = cut.join(right.select("x", F.inline(blocks_of_point(F.col("x")))), ["level", "cell"]).select("i", "x").collect()
    assert sorted(map(tuple, met)) == [(i, x) for i, (a, b) in enumerate(spans) for x in at if a <= x < b]
    assert cut.groupBy("i").count().agg(F.max("count")).first()[0] <= 32


def test_openings_at_equal_brute_force(spark):
    rng, day = random.Random(6), datetime(2024, 1, 1)
    jobs = []
    for i in range(300):
        a = day + timedelta(hours=rng.randrange(2400))
        skills = rng.sample("abcdefg", rng.randrange(4)) + ["hot"] * (i % 2) + [None] * (i % 7 == 0)
        jobs.append((f"p{i}", skills, a, a + timedelta(hours=rng.randrange(900))))
    jobs += [("n1", None, day, day), ("n2", ["a"], None, day), ("n3", ["a"], day, None)]
    wanted = [(i, rng.sample("abcdefg", rng.randrange(3)) + ["hot"] * (i % 3 == 0),
               (day + timedelta(days=rng.randrange(-5, 140))).date()) for i in range(120)]
    wanted += [(500, ["nobody", "hot"], day.date()), (501, None, day.date()), (502, ["a"], None), (503, ["hot", "hot", None], day.date())]
    got = freshness.openings_at(
        spark.createDataFrame(jobs, "posting_id string, skills array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz"),
        spark.createDataFrame(wanted, "wanted_id int, skills array<string>, day date")).collect()
    want = [(w, p) for w, wished, at in wanted for p, skills, a, b in jobs
            if at and a and b and a.date() <= at <= b.date() and {x for x in wished or () if x}
            and {x for x in wished if x} <= set(skills or ())]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_equal_wishes_are_looked_up_once(spark, monkeypatch):
    day, written = datetime(2024, 1, 1), {}
    keep = freshness.materialize
    monkeypatch.setattr(freshness, "materialize", lambda df, label, *a: written.setdefault(label, keep(df, label, *a)))
    jobs = spark.createDataFrame([(f"p{i}", ["a", "b"] if i % 2 else ["b", "a", "c"], day, day) for i in range(20)],
                                 "posting_id string, skills array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz")
    wanted = [(i, ["b", "a"] if i % 2 else ["a", "b", "a"], day.date()) for i in range(30)] + [(30, ["c"], day.date())]
    frame = spark.createDataFrame(wanted + wanted[:5], "wanted_id int, skills array<string>, day date")
    got = freshness.openings_at(jobs, frame).collect()
    assert sorted(map(tuple, got)) == sorted([(w, f"p{i}") for w in range(30) for i in range(20)]
                                             + [(30, f"p{i}") for i in range(0, 20, 2)])
    # One row a posting and block of days, with its skills in one order, and not one for each skill.
    spans = written["spans"].collect()
    assert len(spans) == 20 and len({tuple(r["_set"]) for r in spans}) == 2
