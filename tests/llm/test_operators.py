"""Training-data operators against brute force, on small frames with every odd case."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from hirelake.llm import (attention, bayes, feistel, jaccard, language, materialise, mixing, nearest, pii, queries,
                          sharding, subwords, tiling)
from hirelake.llm.words import WordHashes, ready
from hirelake.session import fresh_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and a clashing extra column."""
    ready(spark)
    rnd = random.Random(4)
    long = " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 6) for _ in range(9000))
    plain = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(1, plain, "en", "a"), (2, plain, "en", None), (2, plain, "en", None), (3, None, "en", "a"), (4, "", None, "b"),
            (5, "   \n", "de", "b"), (None, plain, "en", "a"), (None, None, None, None), (6, long, "de", "b"),
            (7, long + " end", "de", "a"), (8, "12 34 ..", "en", "c"), (9, "two words", "de", "c"),
            (10, plain.upper() + " x", "en", "c"), (10, "two words", "de", "c")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    for name in ("score", "_size", "_rate", "_copy", "_copies", "_nth", "row", "key", "size", "unsure"):
        df = df.withColumn(name, F.lit("mine"))
    return df.withColumn("_n", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    ready(spark)
    return spark.createDataFrame([], SCHEMA)


def given(spark, table):
    return ready(spark).read.parquet(f"{SF}/{table}.parquet")


# ---- 1: greedy string tiling ----------------------------------------------------------

def brute_cover(doc, test, width=4):
    """Words of the test that greedy tiling marks, by trying all places."""
    width, used_d, used_t, total = min(width, len(test)), set(), set(), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(test)):
            for i in range(len(doc)):
                n = 0
                while (i + n < len(doc) and j + n < len(test) and doc[i + n] == test[j + n]
                       and i + n not in used_d and j + n not in used_t):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < max(1, width):
            return total
        used_d |= set(range(i, i + n))
        used_t |= set(range(j, j + n))
        total += n


def test_tiling_equals_brute_force_on_shuffled_passages(spark):
    rnd, words = random.Random(1), "ab bc cd de ef fg gh hi".split()
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 8, 14])))) for k in range(12)]
    docs = []
    for k in range(40):
        parts = [rnd.choice(items)[1].split() for _ in range(2)] + [rnd.choices(words, k=6)]
        parts[0] = parts[0][len(parts[0]) // 2:] + parts[0][:len(parts[0]) // 2]
        rnd.shuffle(parts)
        docs.append((k, " ".join(sum(parts, []))))
    got = {(r.doc_id, r.item_id): r.n_covered for r in tiling.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, test in items:
            covered = brute_cover(tiling.parted(text), tiling.parted(test))
            if covered >= tiling.COVERAGE * len(test.split()):
                want[d, i] = covered
    assert got == want and len(want) > 20


def test_tiling_blocks_do_not_matter_and_whole_passages_are_found(spark):
    docs, bench = given(spark, "documents"), given(spark, "benchmark")
    one, many = (sorted(tuple(r) for r in tiling.contamination(docs, bench, block_bytes=b).collect()) for b in (10**9, 2000))
    assert one == many
    squeezed = {r.item_id: b" ".join(tiling.parted(r.text)) for r in bench.collect()}
    holds = {(r.doc_id, i) for r in docs.collect() for i, t in squeezed.items() if t in b" ".join(tiling.parted(r.text))}
    assert holds <= {r[:2] for r in one} and holds
    left = {r.doc_id for r in tiling.decontaminated(docs, bench).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {r[0] for r in one}


def test_tiling_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (None, "lazy dog near the"), (3, "fox")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in tiling.contamination(odd, items).collect())
    assert got == Counter({(1, None): 1, (2, None): 2, (None, None): 1, (10, None): 1, (1, 3): 1, (2, 3): 2, (None, 3): 1, (10, 3): 1})
    assert tiling.contamination(empty, items).count() == 0
    assert tiling.contamination(odd, items.limit(0)).count() == 0
    assert tiling.decontaminated(odd, items).columns == odd.columns


# ---- 2: empirical Bayes -----------------------------------------------------------------

def test_quality_on_labels_that_were_held_back(spark):
    docs = given(spark, "documents").select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "text")
    labels = given(spark, "labels")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = bayes.quality(docs, labels.where(fold)).join(labels.where(~fold), "doc_id")
    assert out.where(F.col("keep") == (F.col("quality") == 1)).count() / out.count() > 0.9


def test_quality_of_odd_rows_and_of_sites(spark, odd, empty):
    docs = odd.withColumn("host", F.col("source")).withColumn("path", F.col("lang"))
    labels = spark.createDataFrame([(1, 1), (6, 0), (3, None), (99, 1)], "doc_id long, quality int")
    rows = bayes.quality(docs, labels).collect()
    assert len(rows) == odd.count() and all(0 < r.p_quality < 1 for r in rows)
    none = bayes.quality(docs, labels.limit(0)).collect()
    assert {r.p_doc for r in none} == {0.5} and all(r.keep for r in none)
    lean = empty.withColumn("host", F.col("source")).withColumn("path", F.col("lang"))
    assert bayes.quality(lean, labels).count() == 0


# ---- 3: nearest neighbours ----------------------------------------------------------------

def exact(ids, x, q, k):
    s = (x * x[q]).sum(1)
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return [int(ids[j]) for j in order]


def test_nearest_recall(spark):
    got = {}
    for r in queries.op3_nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    e = given(spark, "embeddings").toPandas()
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding).astype(float)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        mine = sorted(got[ids[q]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - float((x[ids == m[1]][0] * x[q]).sum())) < 1e-12 for m in mine)
        hits.append(len({m[1] for m in mine} & set(exact(ids, x, q, 20))) / 20)
    assert np.mean(hits) >= 0.9


def test_nearest_with_one_very_common_vector_and_bad_ones(spark):
    rnd = np.random.default_rng(2)
    same = rnd.normal(size=4).tolist()
    rows = [(i, same) for i in range(60)] + [(100 + i, rnd.normal(size=4).tolist()) for i in range(40)]
    bad = [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 0.0, 0.0]), (904, [math.nan, 1.0, 1.0, 1.0]),
           (905, [math.inf] * 4), (None, same), (906, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "id long, vector array<double>").withColumn("key", F.lit(1)).select("id", "vector", "key")
    out = nearest.nearest(df.select("id", "vector"), df.where("id in (0, 100, 900, 906)").select("id", "vector"), k=5, tile=7).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 100}
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert by[0] == exact(ids, x, 0, 5)
    few = spark.createDataFrame(rows[:3], "id long, vector array<double>")
    assert [r.vec_id for r in nearest.nearest(few, few.where("id = 1"), k=5).orderBy("rank").collect()] == [0, 2]
    assert nearest.nearest(few.limit(0), few, k=5).count() == 0


# ---- 4: mixing --------------------------------------------------------------------------------

def test_targets_equal_repeated_resharing(spark):
    rnd = random.Random(5)
    sizes = {None: 40, "": 7, **{f"s{k}": rnd.randint(0, 5000) for k in range(11)}}
    got = {r.source: r.target for r in mixing.targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    assert got == pytest.approx(target)


def test_mixing_of_odd_rows_and_of_the_corpus(spark, odd, empty):
    rows = mixing.mixing_plan(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mixing_plan(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    docs = given(spark, "documents")
    plan = mixing.mixing_plan(docs)
    assert mixing.mixed(docs).agg(F.sum(mixing.word_count())).first()[0] == plan.agg(F.sum("taken")).first()[0]
    total = plan.agg(F.sum("taken"), F.sum("size")).first()
    assert abs(total[0] / total[1] - 1.5) < 0.2


# ---- 5: Jaccard join ------------------------------------------------------------------------------

def brute_components(rows):
    def own(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, own(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (x, p), (y, q) = sets[a], sets[b]
            if p and q and 100 * len(p & q) >= 80 * len(p | q):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
    return sorted([(i, len(s), root(i)) for i, s in sets])


@pytest.mark.parametrize("how", [{}, {"tile": 60, "block": 2}, {"tile": 200}])
def test_components_equal_brute_force(spark, how):
    rnd = random.Random(8)
    rows = []
    for group in range(6):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 5, 40, 90]))]
        for _ in range(18):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                text[rnd.randrange(len(text))] = f"x{rnd.randint(0, 9)}"
            rows.append((len(rows) * 7 % 997, "  ".join(text).upper() if rnd.random() < 0.3 else "\n".join(text)))
    got = sorted(tuple(r) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect())
    assert got == brute_components(rows)


def test_components_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = [tuple(r) for r in jaccard.components(odd).collect()]
    assert sorted(r for r in out if r[0] is not None) == brute_components(rows)
    assert sorted(str(r) for r in out if r[0] is None) == ["(None, 0, None)", "(None, 11, None)"]
    assert jaccard.components(empty).count() == 0
    left = jaccard.one_of_each(odd)
    assert left.columns == odd.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter({1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 1, None: 1})  # the texts of 10 are judged apart


def test_tree_passes_over_no_possible_link():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 2**63, rnd.integers(5, 60)).astype(np.uint64)) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[1:], rnd.integers(0, 2**63, 1).astype(np.uint64)])) for s in sets[:150]]
    counts, sizes = np.array([jaccard.group_counts(s) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard.CountTree(counts, sizes)
    for i in range(len(sets)):
        bound = np.minimum(counts, counts[i]).sum(1)
        fits = (sizes * 5 >= sizes[i] * 4) & (sizes * 4 <= sizes[i] * 5) & (bound >= jaccard.needed(sizes + sizes[i]))
        assert set(np.flatnonzero(fits)) <= set(tree.probe(counts[i], int(sizes[i])).tolist())


# ---- 6: personal data -------------------------------------------------------------------------------

def plain_by_regex(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_spans_equal_the_patterns(spark):
    rnd = random.Random(6)
    parts = ["a@b.c", "@", ".", "x", "1.2.3.4", "300", "4111 1111 1111 1111", "+1 (202) 555-0101", "-", " ", "é", "4", "+", "b.c_d@e.f"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(1, 9))) for _ in range(3000)]
    texts += [r.text for r in given(spark, "documents").collect()]
    for text in texts:
        assert pii.plain(text) == plain_by_regex(text), text


@pytest.mark.parametrize("text, kind, part", [
    ("write jane dot doe at mail dot example dot org now", "email", "jane dot doe at mail dot example dot org"),
    ("x jane [at] mail (dot) org y", "email", "jane [at] mail (dot) org"),
    ("x jаne@mail.org y", "email", "jаne@mail.org"),
    ("ja​ne@mail.org", "email", "ja​ne@mail.org"),
    ("ip 10[.]0[.]0[.]255 z", "ip", "10[.]0[.]0[.]255"),
    ("call plus four four two zero seven nine four six zero nine five eight", "phone",
     "plus four four two zero seven nine four six zero nine five eight"),
    ("card ４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("ask john at example.com today", "email", "john at example.com"),
    ("jane AT mail.example.org", "email", "jane AT mail.example.org"),
    ("j.doe2 at unknown.museum is none, max.m at home.de is", "email", "max.m at home.de"),
    ("to john -at- example -dot- com", "email", "john -at- example -dot- com"),
    ("(john_at_example_dot_com)", "email", "john_at_example_dot_com"),
    ("<b>john&#64;example.com</b>", "email", "john&#64;example.com"),
    ("john&#x40;example&period;com", "email", "john&#x40;example&period;com"),
    ("call plus double four two zero seven nine triple six zero nine", "phone",
     "plus double four two zero seven nine triple six zero nine"),
    ("one ninety two dot one sixty eight dot one dot one", "ip", "one ninety two dot one sixty eight dot one dot one"),
    ("host ten dot twelve dot zero dot twenty-five.", "ip", "ten dot twelve dot zero dot twenty-five"),
    ("ip 10․0․0․255 z", "ip", "10․0․0․255"),
    ("card ٤١١١ 1111 1111 1111", "card", "٤١١١ 1111 1111 1111"),
    ("card 4111–1111–1111–1111", "card", "4111–1111–1111–1111")])
def test_disguised_spans_point_at_their_source(text, kind, part):
    base, more = pii.spans_of(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in more
    assert set(base) == set(plain_by_regex(text))


@pytest.mark.parametrize("kind, part", [
    ("ip", "one nine two dot one six eight dot one dot one"), ("ip", "192.168.1.one"), ("ip", "19 two dot 168 dot one dot 1"),
    ("card", "4111 one one 11 1111 1111"), ("card", "4111 1111 1111 11 one one"), ("phone", "plus one (202) 555-0101 two"),
    ("phone", "+49 30 1234 five six 78"), ("ip", "one.two.three.four"), ("ip", "10[.]0[.]0[.]255")])
def test_few_spelled_digits_are_found(kind, part):
    for text in (part, f"see {part} now", f"in 2019 we saw {part} or so"):
        assert (kind, text.index(part), text.index(part) + len(part)) in pii.spans_of(text)[1], text
    assert ("ip", 12, 28) in pii.spans_of("in 2019 one 10[.]0[.]0[.]255")[1]  # the number before it is none of it


def test_the_gate_changes_no_result():
    text = "call plus 49 30 1234 5678 now"
    assert ("phone", 5, 25) in pii.spans_of(text)[1]
    rnd = random.Random(9)
    parts = ["plus ", "+", "49 30 1234 5678", "1.2.3.4", " dot ", "[dot]", "(at)", " at ", "one", "two ", "nine ", "192", "168", "4111", "1111",
             " ", " ", "-", ", ", ".", "jane", "mail", "org", "@", "x", "é", "\u200b", "ａ", "tone", "10", "255", "\n",
             "double ", "ninety", "sixteen ", "-at-", "_dot_", "&#64;", "&period;", "at home.de", "–", "\u2024", "٤", ".com"]
    for _ in range(6000):
        text = "".join(rnd.choices(parts, k=rnd.randint(2, 14)))
        base, more = pii.spans_of(text)
        assert set(base) | set(more) == set(pii.plain(text)) | set(pii.disguised(text)), text


def test_prose_is_left_alone(spark, odd, empty):
    for text in ("look at the spot on the map. at 5.30 we met at home.co", "one two buckle my shoe", "At last. Dot com", "a at b", "available at example.com", "see more at shop.co.uk now",
                 "look-at-this.com", "twenty one at ten", "a state-at-large.", "R&#38;D at 10.5"):
        assert pii.spans_of(text) == ([], [])
    rows = pii.find_pii(odd).collect()
    assert len(rows) == odd.count() and {r.spans for r in rows} == {""}
    assert pii.find_pii(empty).count() == 0


# ---- 7: language --------------------------------------------------------------------------------------

def test_language_of_held_out_texts(spark):
    out = queries.op7_language(spark, SF).join(given(spark, "documents"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97


def brute_grams(text):
    n = Counter()
    for word in "".join(c.lower() if c.isalpha() else " " for c in text).split():
        n.update(word)
        w = f" {word} "
        n.update(w[i:i + 2] for i in range(len(w) - 1))
        n.update(w[i:i + 3] for i in range(len(w) - 2))
    return n


def test_grams_and_distance_equal_brute_force(spark):
    grams, texts = language.Grams(), ["Abc ab!ab", None, "", "Straße Été 42 a", "x"]
    got = [Counter() for _ in texts]
    for doc, gram, n in grams.count(texts):
        for d, g, c in zip(doc, gram, n):
            got[d]["".join(chr(g >> s & 0xFFFF) for s in (32, 16, 0) if g >> s & 0xFFFF)] += int(c)
    assert got == [brute_grams(t or "") for t in texts]


def test_language_of_odd_rows(spark, odd, empty):
    by = {(r.doc_id, r.lang_pred): r.score for r in language.identify(odd).collect()}
    assert by[3, "und"] == by[4, "und"] == by[8, "und"] == 0 and all(0 <= s <= 1 for s in by.values())
    assert language.identify(empty).count() == 0
    silent = language.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in silent.collect()} == {"und"}


# ---- 8: training order --------------------------------------------------------------------------------------

def test_subwords_equal_the_encoder(spark):
    s = subwords.Subwords()
    texts = [r.text for r in given(spark, "documents").collect()] + [
        "a  b\n\n c\t\td ", " x y  ", "it's  we'll\x1cgo\x85on", "\n \n", "tab\t x", "　wide  　", "", None]
    for text in texts:
        assert s.encode(text).tolist() == (s.one(text) if text else [])
    # Long runs of white space are cut out; short ones of the same kind show what is right.
    for make in (lambda n: "a" + " " * n + "b", lambda n: " " * n, lambda n: " \n" * n + "\x1cb", lambda n: "a" + "\t" * n,
                 lambda n: " " * n + "日" + "\u3000" * n + " 7"):
        for n in (9_999, 10_000, 10_001, 20_000):
            assert s.encode(make(n)).tolist() == s.one(make(n))
        assert s.encoder.decode(s.encode(make(1_000_000)).tolist()) == make(1_000_000)


def test_shards_hold_every_text_and_resume(spark, odd, empty):
    docs, length = given(spark, "documents").select("text").unionByName(odd.select("text")), 64
    path = fresh_dir(spark, "shards")
    rows = materialise.write_shards(docs, path, length=length, per_shard=50).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    every = materialise.read_from(spark, path, 0, len(rows), length, 50)
    assert [zlib.crc32(x.tobytes()) for x in every] == [r.crc32 for r in rows]
    assert (materialise.read_from(spark, path, 70, 61, length, 50) == every[70:131]).all()
    assert sum(r.n_docs for r in rows) == docs.count()
    s = subwords.Subwords()
    want = Counter(t for r in docs.collect() for t in s.encode(r.text).tolist())
    got = Counter(t for r, x in zip(rows, every) for t in x[:r.n_tokens].tolist())
    assert got.pop(s.end) == docs.count() and got == want
    again = fresh_dir(spark, "shards")
    assert [r.crc32 for r in materialise.write_shards(docs, again, length=length, per_shard=50).orderBy("slot").collect()] == [
        r.crc32 for r in rows]
    assert materialise.write_shards(empty, fresh_dir(spark, "shards")).count() == 0


# ---- 9: language model -------------------------------------------------------------------------------------------

def test_base_scores_equal_brute_force(spark, odd, empty):
    docs = given(spark, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).cache()
    rows = docs.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), "END"]
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for r in rows if not out_of(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id or -1, out_of(r.doc_id), len(tokens(r.text)), sum(w in c for w in tokens(r.text)),
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 6)) for r in rows)
    for frequent in (attention.FREQUENT, 50):
        attention.FREQUENT, before = frequent, attention.FREQUENT
        got = attention.score(docs).collect()
        attention.FREQUENT = before
        assert {r.train_tokens for r in got} == {n}
        assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert attention.score(empty.select("doc_id", "text")).count() == 0


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    return attention.Model(rng.integers(0, 50, 2000), rng.integers(0, 2, 2000), rng.random((2000, attention.AROUND)) * 9, 1999)


def test_model_is_a_distribution_scored_once_per_id():
    m, ids = small_model(), np.random.default_rng(1).integers(0, 1999, 45)
    shares = np.bincount(m.klass, np.exp(m.share.astype(np.float64)), len(m.weights["bias"]))
    assert np.allclose(shares[np.bincount(m.klass, minlength=len(shares)) > 0], 1, atol=1e-4)
    alone = [m.scores([ids[:n]])[0] for n in range(46)]
    both = m.scores([ids[:n] for n in range(46)])
    assert np.allclose(alone, both, atol=1e-3)


def test_model_is_not_shrunk_for_the_budget():
    m = small_model()
    assert m.weights["up"].shape == (16, 32) and len(m.weights["bias"]) == 128
    assert len(np.unique(m.klass[m.klass < 64])) == 64


def test_slopes_equal_differences():
    m, rng = small_model(), np.random.default_rng(2)
    for name in m.weights:
        m.weights[name] = m.weights[name].astype(np.float64)
    rows, aims = rng.integers(0, 900, (3, 8)), rng.integers(0, len(m.weights["bias"]), (3, 8))
    real = rng.random((3, 8)) < 0.8

    def loss():
        w, n = m.weights, 8
        x = w["rows"][rows]
        far = np.arange(n)[:, None] - np.arange(n)[None, :]
        a = attention.softmax(x @ w["q"] @ (x @ w["k"]).transpose(0, 2, 1) / attention.DIM ** 0.5
                              + np.where(far >= 0, w["near"][np.maximum(far, 0)], -1e9))
        h = x + a @ (x @ w["v"]) @ w["o"]
        y = h + np.maximum(h @ w["up"], 0) @ w["down"]
        return -np.log(np.take_along_axis(attention.softmax(y @ w["out"] + w["bias"]), aims[..., None], -1))[real].mean()

    slopes = m.slopes(rows, aims, real)
    for name, w in m.weights.items():
        at = np.unravel_index(np.abs(slopes[name]).argmax(), w.shape)
        keep = w[at]
        w[at] = keep + 1e-5
        up = loss()
        w[at] = keep - 1e-5
        down = loss()
        w[at] = keep
        assert (up - down) / 2e-5 == pytest.approx(slopes[name][at], rel=2e-2, abs=1e-6), name


def test_attention_learns_what_stands_before():
    rng = np.random.default_rng(3)
    counts = np.zeros(2000)
    counts[:40] = 100
    m = attention.Model(counts, np.zeros(2000, np.int64), rng.random((2000, attention.AROUND)), 1999)
    windows = (rng.integers(0, 40, (600, 1)) + np.arange(2 * attention.BLOCK + 1)) % 40  # each id tells the next
    m.fit(windows, 0)
    right, wrong = windows[0], rng.permutation(windows[0])
    assert m.scores([right])[0] - m.scores([wrong])[0] > 100


def test_every_id_of_a_training_text_is_a_target_once(spark):
    words = spark.sparkContext.broadcast(attention.Words(attention.Subwords(attention.VOCABULARY)))
    end, texts = words.value.subwords.end, ["", None, "one", " ".join(f"word{i} of the house" for i in range(400))]
    facts = attention.gathered(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), words)
    flat = b"".join(bytes(r.ids) for r in facts.where("kind = 'window'").collect())
    windows = np.frombuffer(flat, np.uint16).reshape(-1, 2 * attention.BLOCK + 1)
    aims = windows[:, 1:]
    own = [words.value.ids(n).tolist() + [end] for n in words.value.numbers(texts)]
    assert aims[~attention.filled(aims, end)].tolist() == sum(own, [])
    counts = {r.key: r.n for r in facts.where("kind = 'id'").collect()}
    assert counts == Counter(sum(own, []))
    seen = np.bincount(list(counts), list(counts.values()), end + 1)
    most = attention.surroundings(facts.where("kind = 'window'").select("ids"), attention.ranks(seen))
    assert (most.max(1) <= seen).all() and most.max() > len(texts)


def test_windows_are_passed_on_by_the_pack(spark):
    words = spark.sparkContext.broadcast(attention.Words(attention.Subwords(attention.VOCABULARY)))
    text = " ".join(f"word{i} of the house" for i in range(2000))
    facts = attention.gathered(spark.createDataFrame([(text,)], "text string").coalesce(1), words)
    packs = [len(r.ids) // (2 * (2 * attention.BLOCK + 1)) for r in facts.where("kind = 'window'").collect()]
    assert len(packs) <= sum(packs) // attention.PACK + 1 and sum(packs) > attention.PACK


def test_new_words_of_a_batch_are_encoded_in_one_call(monkeypatch):
    subwords, calls = attention.Subwords(attention.VOCABULARY), []
    known, single = attention.Words(subwords), subwords.encoding()
    texts = ["The house's 12ab don't", None, "", "na\u00efve \u4f60\u597d \U0001f600 a\u00a0 \u3000b c\x1cd \u0085", "\u00a0 the end"]
    want = [sum((single.encode_ordinary(" " + w.decode()) for w in (t or "").encode().lower().split()), []) for t in texts]

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(single, name)

    subwords.encoder = Counted()
    got = known.numbers(texts)
    assert [known.ids(own).tolist() for own in got] == want
    calls.clear()
    assert known.ids(known.numbers(["plain words that are all of them new " * 3])[0]).size
    assert len(calls) == 1


@pytest.mark.parametrize("by", [1, 40])  # with large weights the exponents need their shift
def test_scores_equal_one_id_at_a_time(by):
    m, rng = small_model(), np.random.default_rng(4)
    m.weights = {name: w * (by if name in ("rows", "near") else 1) + rng.normal(size=w.shape).astype(np.float32) * 0.1
                 for name, w in m.weights.items()}
    texts = [rng.integers(0, 1999, n) for n in (0, 1, 15, 16, 17, 40, 0, 31)]
    w, block = {name: part.astype(np.float64) for name, part in m.weights.items()}, attention.BLOCK

    def plain(ids):
        given, total = [m.end, *ids], 0.0
        x = w["rows"][m.row[given]]
        for i, aim in enumerate([*ids, m.end]):
            seen = np.arange(max(0, i // block - 1) * block, i + 1)
            a = attention.softmax(x[i] @ w["q"] @ (x[seen] @ w["k"]).T / attention.DIM ** 0.5 + w["near"][i - seen])
            h = x[i] + a @ (x[seen] @ w["v"]) @ w["o"]
            y = h + np.maximum(h @ w["up"], 0) @ w["down"]
            logits = y @ w["out"] + w["bias"]
            total += logits[m.klass[aim]] - logits.max() - np.log(np.exp(logits - logits.max()).sum()) + m.share[aim]
        return total

    assert np.allclose(m.scores(texts), [plain(ids) for ids in texts], rtol=1e-4, atol=1e-3)
    assert len(m.scores([])) == 0


# ---- 10: sharding and the permutation --------------------------------------------------------------------------------

def place(x, total, seed):
    """The permutation in plain Python."""
    high = max(1, math.ceil(math.sqrt(total)))
    low = max(1, math.ceil(total / high))

    def mix(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
        return h - (1 << 64) if h >> 63 else h

    def once(x):
        a, b = divmod(x, low)
        for step in range(feistel.ROUNDS):
            if step % 2 == 0:
                a = (a + mix(seed, step, b) % high) % high
            else:
                b = (b + mix(seed, step, a) % low) % low
        return a * low + b

    x = once(x)
    while x >= total:
        x = once(x)
    return x


@pytest.mark.parametrize("total", [1, 2, 3, 7, 10, 101, 1000])
def test_permutation_equals_plain_python(spark, total):
    got = [r.p for r in spark.range(total).select(feistel.permuted(F.col("id"), F.lit(total).cast("long"), 9).alias("p"), "id")
           .orderBy("id").collect()]
    assert got == [place(x, total, 9) for x in range(total)] and sorted(got) == list(range(total))


def test_shards_of_odd_rows(spark, odd, empty):
    rows = sharding.shard_documents(odd, shards=4).collect()
    assert len(rows) == odd.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    texts = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in odd.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    key = lambda r: str(tuple(r))
    assert sorted(rows, key=key) == sorted(sharding.shard_documents(odd.repartition(5), shards=4).collect(), key=key)
    assert sharding.shard_documents(empty).count() == 0


# ---- the pipeline -------------------------------------------------------------------------------------------------------

def test_pipeline_stages_take_effect(spark, odd, empty):
    docs = given(spark, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        if name != "mixing":
            assert out.exceptAll(docs).count() == 0
        if name == "language":
            assert out.count() == docs.count()  # all of it is prose
        if name == "near_copies":
            want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()])}
            assert {r.doc_id for r in out.collect()} == want and out.count() == len(want)
        if name == "decontamination":
            assert tiling.contamination(out, given(spark, "benchmark")).count() == 0
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
    for rows in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).collect()


def test_pipeline_keeps_every_clean_text(spark):
    """Repeated and null ids: different texts stay, copies go, whatever row comes first."""
    one, two, three = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, None), (5, one), (1, one + " end"), (1, two), (None, three), (None, three), (None, two + " more"), (None, None), (6, "few"),
            (6, "few"), (7, "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("_nth", F.lit("mine"))
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect())
    texts = {t for _, t in kept}
    assert max(kept.values()) == 1 and {(5, None), (None, None), (None, three), (7, "few")} <= kept.keys()
    assert (one in texts) != (one + " end" in texts) and (two in texts) != (two + " more" in texts)
    assert sum(t == "few" for _, t in kept) == 1 and len(kept) == 6
    mixed = mixing.mixed(docs.withColumn("_rate", F.lit("mine")).withColumn("_size", F.lit("mine")))
    assert mixed.columns == [*docs.columns, "_rate", "_size"]
    assert all((r._rate, r._size, r._nth) == ("mine",) * 3 for r in mixed.collect())


def test_sql_twins(spark):
    from compare import compare, duck
    con = duck(SF)
    for name, sql in queries.SQL.items():
        assert compare(queries.QUERIES[name](spark, SF), con, sql) == "", name


def test_rolling_hashes_tell_windows_apart():
    from hirelake.llm.words import rolling
    own = WordHashes().of(b"a b c a b c d".split())
    window = rolling(own, 3)
    assert window[0] == window[3] and len(set(window.tolist())) == 4 and not len(rolling(own, 9))
