"""Banded hashing and MinHash against brute force, on planted copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.operators import dedupe, meeting


def cosine(a, b):
    return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)


def planted_vectors(n=600, dim=24, seed=3):
    """Groups of near copies, one of them with a third of all rows, among unrelated vectors."""
    rng = np.random.default_rng(seed)
    rows, base = [], rng.standard_normal((60, dim))
    for i in range(n):
        group = 0 if i % 3 == 0 else rng.integers(1, 60) if i % 3 == 1 else None
        v = rng.standard_normal(dim) if group is None else base[group] + 0.05 * rng.standard_normal(dim)
        rows.append((i, v if i % 10 else base[0], "xyz"[i % 2]))
    return rows


def brute_earliest(rows, threshold):
    out = {}
    for i, v, block in rows:
        for j, w, other in rows:
            if j < i and block == other and cosine(v, w) >= threshold:
                out[i] = j
                break
    return out


def test_banded_hashing_links_planted_copies_to_the_earliest(spark):
    rows = planted_vectors()
    df = spark.createDataFrame([(i, v.tolist(), b) for i, v, b in rows], "posting_id bigint, embedding array<double>, company string")
    got = {r.posting_id: r.dup_of for r in dedupe.dedupe_similar(df, 0.9, ["company"]).collect()}
    want = brute_earliest(rows, 0.9)
    assert len(got.keys() & want.keys()) >= 0.95 * len(want) and got.keys() <= want.keys()
    assert sum(got.get(i) == j for i, j in want.items()) >= 0.95 * len(want)
    exact = {r.posting_id: r.dup_of for r in dedupe.dedupe_semantic(df, 0.9, ["company"]).collect()}
    assert exact == want


def test_odd_vectors_and_blocks(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.001], None), (3, [1.0, 0.0], None), (4, None, "a"), (5, [0.0, 0.0], "a"),
            (6, [float("nan"), 1.0], "a"), (7, [1.0, 0.0, 0.0], "a"), (8, [2.0, 0.0], "a"), (9, [1.0, None], "a"), (10, [2.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "posting_id bigint, embedding array<double>, company string").withColumn("point", F.lit(1))
    got = {(r.posting_id, r.dup_of, r.score) for r in dedupe.dedupe_similar(df, 0.95, ["company"]).collect()}
    assert got == {(3, 2, 1.0), (8, 1, 1.0), (10, 1, 1.0)}  # null blocks are equal; lengths never mix
    assert dedupe.dedupe_similar(df.limit(0), 0.95, ["company"]).count() == 0
    with pytest.raises(ValueError, match="bands"):
        dedupe.dedupe_similar(df, 0.1)


def test_tested_pairs_are_linear_in_a_group_of_copies(spark, monkeypatch):
    """A group twice as large has twice the pairs, not four times."""
    seen = []
    plain = meeting.earliest_matches

    def counted(members, verify, **how):
        def counting(pairs):
            seen[-1] += pairs.count()
            return verify(pairs)
        seen.append(0)
        return plain(members, counting, **how)

    monkeypatch.setattr(dedupe, "earliest_matches", counted)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    for n in (400, 800):
        rows = [(i, (base + 0.01 * rng.standard_normal(16)).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "posting_id bigint, embedding array<double>")
        assert {r.dup_of for r in dedupe.dedupe_similar(df, 0.9).collect()} == {0}
    assert seen[1] < 2.6 * seen[0] and seen[1] < 10 * 800


def test_every_earlier_row_is_tested_until_a_match(spark):
    """All rows meet at one point; the match of each is found whatever its place."""
    rnd = random.Random(2)
    kind = {i: rnd.randrange(40) for i in range(300)}
    members = spark.createDataFrame([(0, i) for i in kind] + [(1, i) for i in range(5)], "point int, id bigint")
    kinds = spark.createDataFrame(list(kind.items()), "id bigint, kind int")
    def verify(pairs):
        both = pairs.join(kinds, "id").join(kinds.select(F.col("id").alias("other"), F.col("kind").alias("k")), "other")
        return both.where("kind = k").withColumn("score", F.lit(1.0))
    got = {r.id: r.dup_of for r in meeting.earliest_matches(members, verify, leaders=2).collect()}
    first = {}
    want = {i: first[k] for i, k in kind.items() if first.setdefault(k, i) != i}
    assert got == want


def texts(n=240, seed=4):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    bases = [[rnd.choice(words) for _ in range(60)] for _ in range(20)]
    rows = []
    for i in range(n):
        t = list(rnd.choice(bases)) if i % 3 else [rnd.choice(words) for _ in range(60)]
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(60)] = rnd.choice(words)
        rows.append((i, " ".join(t)))
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[0][1]), (n + 3, "one two"), (n + 4, "One, two!")]


def test_minhash_recalls_the_exact_path(spark):
    df = spark.createDataFrame(texts(), "posting_id bigint, description string")
    exact = {r.posting_id: (r.dup_of, round(r.score, 9)) for r in dedupe.near_dup_text(df, 0.7).collect()}
    near = {r.posting_id: (r.dup_of, round(r.score, 9)) for r in dedupe.near_dup_minhash(df, 0.7).collect()}
    assert len(exact) > 100 and sum(near.get(i) == m for i, m in exact.items()) >= 0.95 * len(exact)
    assert near.keys() <= exact.keys()
    assert dedupe.near_dup_minhash(df.limit(0), 0.7).count() == 0
