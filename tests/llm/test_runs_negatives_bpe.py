"""Periodic runs, hard negatives and BPE against brute force and the public encoder."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hirelake.llm import bpe, nearest, negatives, queries, runs
from hirelake.llm.words import ready

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, runs string, decoded string, collapsed string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators' own."""
    ready(spark)
    rnd = random.Random(7)
    long = " ".join(rnd.choice(["la", "li", "<|endoftext|>", "é漢\x1c", "don't"]) for _ in range(30000))
    rows = [(1, "a b c d e f " * 5), (1, "a b c d e f " * 5), (2, None), (3, ""), (4, " \n\t "), (None, "x " * 40), (None, None),
            (5, long), (6, "one"), (7, "a\x00 a " * 20)]
    return spark.createDataFrame([(*r, "mine", None, "mine", "mine") for r in rows], SCHEMA)


# ---- 11: periodic runs ------------------------------------------------------------------

def brute_runs(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted((s, q, n) for (s, n), q in out.items())


def found_runs(texts, least=12):
    return [[(int(s), int(q), int(n)) for s, n, q in zip(*one)] for one in runs.runs_in(texts, least)]


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        texts = []
        for _ in range(8):
            kind, w = rnd.randrange(4), []
            if kind == 0:
                w = rnd.choices("ab", k=rnd.randint(0, 120))
            elif kind == 1:
                for _ in range(rnd.randint(1, 6)):
                    block = rnd.choices("abcdefgh", k=rnd.randint(1, 40))
                    for _ in range(rnd.randint(0, 3)):
                        again = block[:rnd.randint(1, len(block))]
                        if rnd.random() < 0.3:
                            again[rnd.randrange(len(again))] = "z"
                        block = block + again
                    w += block
            elif kind == 2:
                a, b = "a", "ab"
                for _ in range(rnd.randint(3, 9)):
                    a, b = b, b + a
                w = list(b)
            else:
                w = ["x"] * rnd.randint(0, 200) + rnd.choices("xy", k=rnd.randint(0, 40))
            texts.append([x.encode() for x in w])
        assert found_runs(texts) == [brute_runs(w) for w in texts]


def test_runs_of_every_period_at_every_place():
    for q in range(1, 40):
        for shift in range(0, 17):
            length = max(12, 2 * q)
            w = [b"s%d" % k for k in range(shift)] + [b"p%d" % (k % q) for k in range(length)] + [b"end"]
            assert found_runs([w]) == [[(shift, q, length)]]
            short = w[:shift + length - 1]  # one word less is no run, unless it is long by itself
            assert found_runs([short]) == [[]]


def test_successor_of_the_wavelet_tree():
    rnd = np.random.default_rng(2)
    values = rnd.permutation(300)
    tree = runs.WaveletTree(values)
    low = rnd.integers(0, 299, 2000)
    high = np.array([rnd.integers(a + 1, 301) for a in low])
    bound = rnd.integers(0, 600, 2000)
    want = [min([v for v in values[a:b] if v >= x], default=-1) for a, b, x in zip(low, high, bound)]
    assert tree.successor(low, high, bound).tolist() == want


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query_of_runs_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for r in queries.op11_runs(spark, SF).collect():
        w = planted(r.doc_id, docs[r.doc_id])
        if len(w) > 2500:
            continue
        want = brute_runs(w)
        gone = {k for s, q, n in want for k in range(s + q, s + n)}
        best = min(want, key=lambda x: (-x[2], x[0], x[1]), default=None)
        first = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert tuple(r)[1:6] == (len(want), *first)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        seen += len(want)
    assert seen > 10


def test_runs_of_odd_rows(spark, odd):
    rows = runs.find_runs(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(([(x.start, x.length, x.period) for x in r.runs], r.collapsed))
    assert by[1] == [([(0, 30, 6)], "a b c d e f")] * 2
    assert by[2] == by[3] == by[4] == [([], "")] and by[6] == [([], "one")]
    assert sorted(by[None]) == [([], ""), ([(0, 40, 1)], "x")]
    assert by[7] == [([(0, 40, 2)], "a\x00 a")]
    assert runs.find_runs(odd.limit(0)).count() == 0


# ---- 12: hard negatives -------------------------------------------------------------------

def brute_negatives(rows, chosen, n_pos=5, n_neg=5):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if i is not None and c is not None and fine(v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in rows if chosen(i)}:
        mine = sorted((-score(v, w), j) for j, d, w in rows if d == c and j != i)[:n_pos]
        others = sorted((-score(v, w), j) for j, d, w in rows if d != c and j != i)
        for s, j in mine:
            fits = [x for x in others if 80 * -s <= 100 * -x[0] <= 100 * -s][:n_neg]
            out += [(i, j, k + 1, b, -s, -t) for k, (t, b) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("tile", [negatives.MOST, 7])
def test_negatives_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "MOST", tile)
    monkeypatch.setattr(negatives, "AT_ONCE", 50)
    rnd = random.Random(tile)
    rows = [(k, rnd.randrange(3), [rnd.choice([0.25, 0.5, 1.0, -0.5, 0.3]) for _ in range(3)]) for k in range(120)]
    rows += [(200, 1, None), (201, None, [1.0, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (202, 1, [1.0, None, 1.0]),
             (203, 1, [float("nan"), 1.0, 1.0]), (204, 1, [float("inf"), 1.0, 1.0]), (205, 1, []), (206, 1, [0.0, 0.0, 0.0]),
             (207, 2, [1.0, 1.0, 1.0, 9.0]), (208, 2, [0.5]), (10, 1, [0.1, 0.2, 0.3]), (60, *rows[60][1:]), (61, *rows[61][1:]),
             (210, 0, [1e9, 1e-9, -1e9]), (211, 0, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>").withColumn("rank", F.lit(1)).withColumn("key", F.lit("x"))
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0).collect())
    # 211 with anything that is not zero is past the limit of scores.
    assert got == brute_negatives([r for r in rows if r[0] != 211], lambda i: i % 10 == 0) and len(got) > 100
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_residues_give_exact_scores_of_any_size():
    rnd = np.random.default_rng(4)
    for size in (1e-3, 1.0, 1e3, 1e4, 5e4):
        a, b = (rnd.normal(size=(20, 150)) * size for _ in range(2))
        left, right = negatives.Residues(list(a), 150), negatives.Residues(list(b), 150)
        scores, wide = left.scores(right, slice(None))
        whole = [[int(math.floor(256 * x)) for x in v] for v in a], [[int(math.floor(256 * x)) for x in v] for v in b]
        assert wide is None and scores.tolist() == [[sum(x * y for x, y in zip(v, w)) for w in whole[1]] for v in whole[0]]
    assert left.needed(right) > negatives.Residues([np.ones(2)], 2).needed(negatives.Residues([np.ones(2)], 2))
    huge = negatives.Residues([np.array([1e200, 1.0]), np.array([1.0, 2.0])], 2)
    scores, wide = huge.scores(huge, slice(None))
    assert wide.tolist() == [[True, True], [True, False]] and scores[1, 1] == 256 * 256 * 5


# ---- 13: BPE -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(bpe.VOCABULARY)


def test_ids_equal_the_public_encoder(vocabulary, public, monkeypatch):
    rnd = random.Random(3)
    parts = [*"aabbtsre'''   \n\t \x1c\x85é1²Ⅷ!?.👍́漢<|>\x00", "'ll", "'ve", " 's", "'VE", "<|endoftext|>", "don't",
             "Ᲊ", "퟿", "ｱ", "   ", "the ", "\xa0", "　", "\U0001e5f0"]
    for block in (2_000_000, 40):
        monkeypatch.setattr(bpe, "BLOCK", block)
        texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 80))) for _ in range(3000)] + [None, "", "a" * 1000, "ab" * 500 + "a"]
        want = [e.ids for e in public.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        got = vocabulary.encode(texts)
        assert [g.tolist() for g in got] == want
        assert [vocabulary.decode(g).decode() for g in got] == [t or "" for t in texts]


def test_decoding_any_ids_equals_the_public_decoder(vocabulary, public):
    rnd = random.Random(5)
    for _ in range(300):
        ids = rnd.choices(range(50257), k=rnd.randint(0, 20))
        assert vocabulary.decode(np.array(ids, np.int64)).decode("utf-8", "replace") == public.decode(ids, skip_special_tokens=False)


def test_words_are_parted_by_the_same_classes(vocabulary):
    """Every letter, number and space that any of the Unicode versions here knows."""
    splitter = bpe.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    points = [p for p in range(0x30000) if not 0xD800 <= p < 0xE000 and p % 7 == 0 or p < 0x3400]
    text = "".join(f"a{chr(p)}1{chr(p)}" for p in points)
    want = [at[0] for _, at in splitter.pre_tokenize_str(text)]
    numbers = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    assert vocabulary.words(numbers, np.array([0])).tolist() == want


def test_query_of_bpe_equals_the_public_library(spark, public):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = public.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        text = public.decode(ids, skip_special_tokens=False)
        assert tuple(r) == (r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                            hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_odd_rows(spark, odd, public):
    rows = bpe.decode(bpe.encode(odd)).collect()
    texts = sorted((r.text or "") for r in odd.collect())
    assert sorted(r.decoded for r in rows) == texts
    assert sorted(r.ids for r in rows) == sorted(public.encode(t, add_special_tokens=False).ids for t in texts)
    assert bpe.decode(bpe.encode(odd.limit(0))).count() == 0
    strange = spark.createDataFrame([(1, None), (2, [None, 50256, 99999, -1]), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(strange).collect()} == {1: "", 2: "<|endoftext|>", 3: ""}


# ---- 3: nearest neighbours on mixed norms ------------------------------------------------------

@pytest.mark.parametrize("kind", ["outlier", "lognormal", "few"])
def test_neighbours_are_found_on_mixed_norms(spark, kind):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "outlier":
        v[7] *= 4
        v[9, 0] = 1e200
    elif kind == "lognormal":
        v *= rng.lognormal(0, 0.5, (4000, 1))
    else:
        v[rng.random(4000) < 0.02] *= 6
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = {}
    for r in nearest.nearest(df, df.where("id % 40 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 4000, 40):
        scores = (v * v[q]).sum(1)
        scores[q] = -np.inf
        recall.append(len(got[q] & set(np.lexsort((np.arange(4000), -scores))[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9 and min(recall) >= 0.5
