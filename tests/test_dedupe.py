import random
from pathlib import Path

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hirelake.operators import dedupe
from hirelake.plans import skew
from hirelake.plans.tiles import tiled
from hirelake.session import fresh_dir, materialize


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def resolved(spark, edges, **options):
    frame = spark.createDataFrame(edges, "posting_id bigint, dup_of bigint")
    rows = dedupe.resolve_clusters(frame, **options).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.job_id for r in rows}


def test_clusters_of_known_shapes(spark):
    chain = [(i + 1, i) for i in range(100)]
    star = [(200 + i, 200) for i in range(1, 30)]
    edges = chain + star + [(400, 400), (501, 500)]
    random.Random(1).shuffle(edges)
    assert resolved(spark, edges) == components(edges)
    assert resolved(spark, edges, hot_rows=2) == components(edges)
    assert resolved(spark, []) == {}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_clusters_do_not_depend_on_direction(spark, edges):
    flipped = [(b, a) for a, b in reversed(edges)]
    assert resolved(spark, edges) == components(edges) == resolved(spark, flipped)


def test_exact_keys_skip_nulls(spark):
    rows = spark.createDataFrame([
        ("c", "u1", "s", "1"), ("a", "u1", "t", "1"), ("b", None, "s", "1"), ("d", None, "t", None),
    ], "posting_id string, canonical_url string, source string, external_id string")
    got = {tuple(r)[:2] for r in dedupe.dedupe_exact(rows).collect()}
    assert got == {("c", "a"), ("c", "b")}


def test_hot_keys_give_the_same_edges(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(200)], "posting_id int, key string")
    plain = sorted(map(tuple, dedupe.group_edges(rows, ["key"], "t").collect()))
    assert plain and plain == sorted(map(tuple, dedupe.group_edges(rows, ["key"], "t", hot_rows=10).collect()))


def test_cascade_gives_later_tiers_one_row_per_group(spark):
    rows = spark.createDataFrame([
        ("a", "u1", "x", "k"), ("b", "u1", "y", "k"), ("c", "u2", "x", "k"), ("d", "u3", "z", ""),
    ], "posting_id string, canonical_url string, title_norm string, company_norm string")
    tiers = [lambda d: dedupe.dedupe_exact(d, [["canonical_url"]]), dedupe.dedupe_title_company]
    edges = dedupe.dedupe(rows, tiers)
    assert {tuple(r) for r in edges.collect()} == {("b", "a", "exact"), ("c", "a", "title_company")}
    jobs = dedupe.assign_jobs(rows, dedupe.resolve_clusters(edges))
    assert {r.posting_id: r.job_id for r in jobs.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}


def _brute(ids, similar):
    out = {}
    for a in ids:
        earlier = [b for b in ids if b < a and similar(a, b)]
        if earlier:
            out[a] = min(earlier)
    return out


def test_similar_vectors_equal_brute_force_with_hot_block(spark):
    """Two thirds of one block are copies and near copies; tiles and leaders are tiny."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(8)
    vectors, blocks = {}, {}
    for i in range(120):
        if i % 3 == 0:
            v = base
        elif i % 3 == 1:
            v = base + 0.05 * rng.standard_normal(8)
        else:
            v = rng.standard_normal(8)
        vectors[i], blocks[i] = [float(x) for x in v], 0 if i % 10 else 1
    vectors[120], blocks[120] = [0.0] * 8, 0
    vectors[121], blocks[121] = [0.0] * 8, 0

    def similar(a, b):
        x, y = np.array(vectors[a]), np.array(vectors[b])
        n = np.linalg.norm(x) * np.linalg.norm(y)
        return blocks[a] == blocks[b] and n > 0 and round(float(x @ y / n), 6) >= 0.7

    frame = spark.createDataFrame([(i, vectors[i], blocks[i]) for i in vectors],
                                  "posting_id bigint, embedding array<double>, block int")
    got = dedupe.dedupe_semantic(frame, 0.7, ["block"], leaders=3, tile_rows=7, hot_rows=20).collect()
    assert {r.posting_id: r.dup_of for r in got} == _brute(sorted(vectors), similar)


def test_similar_texts_equal_brute_force_with_hot_group(spark):
    """A third of the texts are near copies of one, another part share boilerplate only."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    core = [rng.choice(vocabulary) for _ in range(40)]
    texts = {}
    for i in range(150):
        if i % 3 == 0:
            words = list(core)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(40)] = rng.choice(vocabulary)
        elif i % 3 == 1:
            words = core[:12] + [rng.choice(vocabulary) for _ in range(10)]
        else:
            words = [rng.choice(vocabulary[:6]) for _ in range(rng.randint(0, 7))]
        texts[i] = " ".join(words)

    def grams(t):
        w = t.split()
        return {tuple(w[j:j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)}

    sets = {i: grams(t) for i, t in texts.items()}

    def similar(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6

    frame = spark.createDataFrame(list(texts.items()), "posting_id bigint, description string")
    for leaders, hot_rows in ((1, 5), (16, 1_000_000)):
        got = dedupe.near_dup_text(frame, 0.6, leaders=leaders, hot_rows=hot_rows).collect()
        assert {r.posting_id: r.dup_of for r in got} == _brute(sorted(texts), similar)


def test_tiles_stay_small(spark):
    """No group a kernel sees grows with a hot block."""
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 0, id) AS block")

    def sizes(left, right):
        import pandas as pd
        return pd.DataFrame({"l": [len(left)], "r": [len(right)]})

    seen = tiled(rows, rows, "id", "id", ["block"], sizes, "l int, r int", tile_rows=50).collect()
    assert max(max(r.l, r.r) for r in seen) <= 100
    assert sum(r.l * r.r for r in seen) == 900 * 900 + 100


def test_counted_join_broadcasts_few_hot_keys(spark, monkeypatch):
    """With any bound on hot keys the join gives the same rows."""
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)], "k string, i int")
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.min("i").alias("first"))
    want = None
    for keys in (1, 2, 10_000):
        monkeypatch.setattr(skew, "HOT_KEYS", keys)
        got = sorted(map(tuple, skew.join_counted(rows, counted, ["k"], hot_rows=0).collect()))
        assert len(got) == 90 and got == (want or got)
        want = got


def _scratch(spark):
    top = fresh_dir(spark, "x").rsplit("/", 1)[0]
    return {f.name for f in Path(top.removeprefix("file:")).iterdir()} if Path(top.removeprefix("file:")).is_dir() else set()


def test_clusters_leave_one_table_behind(spark):
    # Stars of leaves, one of them below another; a chain that needs rounds; a loop that is its own job.
    edges = [(100 * s + i, 100 * s) for s in range(3) for i in range(1, 20)] + [(200, 100)]
    edges += [(1001 + i, 1000 + i) for i in range(9)] + [(5, 5), (7000, 7000), (101, 100)]
    frame = spark.createDataFrame(edges, "posting_id bigint, dup_of bigint")
    before = _scratch(spark)
    rows = dedupe.resolve_clusters(frame).collect()
    assert {r.node: r.job_id for r in rows} == components(edges) and len(rows) == len(components(edges))
    assert {name.split("-")[0] for name in _scratch(spark) - before} <= {"clusters", "counted"}


def test_unique_keys_are_not_compared(spark):
    rows = spark.createDataFrame([(f"p{i:02}", f"u{i}", f"e{i % 30}" if i < 35 else None) for i in range(40)],
                                 "posting_id string, canonical_url string, external_id string")
    assert dedupe._repeated(rows, ["canonical_url"]) is None
    few = dedupe._repeated(rows.where("external_id IS NOT NULL"), ["external_id"])
    assert sorted(r.posting_id for r in few.collect()) == sorted(f"p{i:02}" for j in range(5) for i in (j, j + 30))
    got = dedupe.dedupe_exact(rows.unionByName(rows), [["canonical_url"], ["external_id"]])  # ids come twice as well
    assert sorted(map(tuple, got.collect())) == [(f"p{i + 30}", f"p{i:02}", "exact") for i in range(5)]
    none = dedupe.dedupe_exact(rows, [["canonical_url"]])
    assert none.columns == ["posting_id", "dup_of", "tier"] and none.isEmpty()


def test_what_a_tier_leaves_is_written_once(spark):
    rows = spark.createDataFrame([(i, "k" if i % 2 else f"k{i}", f"t{i % 4}") for i in range(12)],
                                 "posting_id bigint, canonical_url string, title_norm string")
    seen = []

    def tier(key):
        return lambda d: seen.append(len(d.inputFiles())) or dedupe.group_edges(d, [key], key)

    before = _scratch(spark)
    edges = dedupe.dedupe(materialize(rows, "rows"), [tier("canonical_url"), tier("title_norm")])
    assert sorted(map(tuple, edges.collect())) == sorted(
        [(i, 1, "canonical_url") for i in (3, 5, 7, 9, 11)] + [(i, i % 4, "title_norm") for i in (4, 6, 8, 10)])
    assert len(seen) == 2 and "left" not in {name.split("-")[0] for name in _scratch(spark) - before}


def test_merged_wording_is_that_of_the_earliest(spark):
    rows = [("b", "j", "s1", "late", "x", 2, 5, 1.0, 9.0), ("a", "j", "s2", None, "y", 1, 4, 2.0, 8.0),
            ("c", "k", "s1", "only", "z", 3, 3, None, None), (None, None, "s1", "lost", "w", 7, 7, 1.0, 1.0),
            (None, "j", "s3", "no id", "v", 0, 6, 0.5, 1.0), ("a", "k", "s1", "moved", "u", 9, 9, 3.0, 3.0)]
    frame = spark.createDataFrame(rows, "posting_id string, job_id string, source string, title string, company string, "
                                  "first_seen int, last_seen int, comp_min double, comp_max double")
    before = _scratch(spark)
    got = {r.job_id: tuple(r)[1:] for r in dedupe.merge_cluster(frame).collect()}
    assert got == {"j": (None, "y", 0, 6, 0.5, 9.0, 3, 3), "k": ("moved", "u", 3, 9, 3.0, 3.0, 2, 1),
                   None: (None, None, 7, 7, 1.0, 1.0, 1, 1)}
    assert {name.split("-")[0] for name in _scratch(spark) - before} == {"jobs"}  # numbers first, texts of the earliest then
