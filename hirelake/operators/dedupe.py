"""Tiered de-duplication of cross-posted jobs.

Every tier gives edges ``posting_id -> dup_of`` (a smaller id), at most one per
posting and key, so the output is linear in the input however large a group of
copies is. ``resolve_clusters`` closes the edges of all tiers transitively.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window, functions as F

from hirelake.functions import text as tx
from hirelake.operators.cells import unit_rows, usable
from hirelake.operators.meeting import earliest_matches
from hirelake.plans.skew import HOT_ROWS, counted_table, join_counted
from hirelake.plans.tiles import tiled
from hirelake.session import discard, materialize

Tier = Callable[[DataFrame], DataFrame]
CODEC = "zstd"  # of tables with a row per posting


# ---- tiers 1 and 2: equal keys -------------------------------------------------

def _repeated(present: DataFrame, keys: list[str]) -> DataFrame | None:
    """Rows whose keys may come twice, ``None`` if none do.

    Hashes of the keys are counted first, so neither ids nor long keys are shuffled to find out
    that most keys are unique; where most are not, all rows are kept. Equal hashes of
    different keys do no harm, as the keys themselves are compared afterwards.
    """
    seen = Observation()
    hashes = present.select(F.xxhash64(*keys).alias("_h")).observe(seen, F.count(F.lit(1)).alias("n"))
    twice = counted_table(hashes.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    if twice.total == 0:
        return None
    if 2 * twice.total > seen.get["n"]:
        return present
    return present.withColumn("_h", F.xxhash64(*keys)).join(twice.table.select("_h"), "_h", "left_semi").drop("_h")


def _linked(df: DataFrame, keys: list[str], row_id: str, hot_rows: int) -> DataFrame | None:
    """``row_id``, keys and ``dup_of``, the smallest id with these keys, of every other row that has
    them; ``None`` if there is none."""
    kinds = dict(df.dtypes)
    filled = [F.col(k) != "" if kinds[k] == "string" else F.col(k).isNotNull() for k in keys]
    present = _repeated(df.select(row_id, *keys).where(reduce(and_, filled)), keys)
    if present is None:
        return None
    first = counted_table(
        present.groupBy(*keys).agg(F.min(row_id).alias("dup_of"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
    )
    if first.total == 0:
        return None
    return join_counted(present, first, keys, hot_rows=hot_rows).where(F.col(row_id) != F.col("dup_of"))


def _edges(found: DataFrame | None, df: DataFrame, tier: str, row_id: str) -> DataFrame:
    if found is None:
        found = df.select(row_id, F.col(row_id).alias("dup_of")).where(F.lit(False))
    return found.select(F.col(row_id), "dup_of", F.lit(tier).alias("tier"))


def group_edges(df: DataFrame, keys: list[str], tier: str, row_id: str = "posting_id",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Link every row to the smallest id that has the same keys, none of them null or empty.

    ``min`` is combined map-side, and only keys with two or more rows join back.
    """
    return _edges(_linked(df, keys, row_id, hot_rows), df, tier, row_id)


def dedupe_exact(df: DataFrame, keys: list[list[str]] | None = None) -> DataFrame:
    """Tier 1: equal canonical URL, or equal external id. Ids are compared within a
    source unless the caller passes keys that hold across sources."""
    keys = keys or [["canonical_url"], ["source", "external_id"]]
    # Rows that met by their keys lie together, so they are told apart there, without another shuffle.
    linked = [found.select("posting_id", *k, "dup_of").distinct()
              for k in keys if (found := _linked(df, k, "posting_id", HOT_ROWS)) is not None]
    edges = [_edges(found, df, "exact", "posting_id") for found in linked or [None]]
    return edges[0] if len(edges) == 1 else reduce(DataFrame.unionByName, edges).distinct()


def dedupe_title_company(df: DataFrame) -> DataFrame:
    """Tier 2: equal normalized title and company; empty ones never match."""
    named = df.where((F.col("title_norm") != "") & (F.col("company_norm") != ""))
    return group_edges(named, ["title_norm", "company_norm"], "title_company")


def dedupe(df: DataFrame, tiers: list[Tier], row_id: str = "posting_id") -> DataFrame:
    """Run tiers cheapest first; each sees one representative per group found so far. What a tier
    leaves is written once, so pass the columns that the tiers read and no others."""
    left, found = df, []
    for tier in tiers:
        if found:
            rest = materialize(left.join(found[-1].select(row_id), row_id, "left_anti"), "left", CODEC)
            if left is not df:
                discard(left)
            left = rest
        found.append(materialize(tier(left).select(row_id, "dup_of", "tier"), "edges", CODEC))
    if left is not df:
        discard(left)
    return reduce(DataFrame.unionByName, found)


# ---- tier 3: similar vectors ---------------------------------------------------

def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.array(vectors.tolist(), dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _earliest_similar(row_id: str, threshold: float):
    """Kernel: per left row the smallest right id below its own that is similar."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({row_id: left[row_id][:0], "dup_of": left[row_id][:0], "score": []})
        right = right.sort_values(row_id, ignore_index=True)
        ids, others = left[row_id].to_numpy(), right[row_id].to_numpy()
        scores = np.round(_unit_rows(left["embedding"]) @ _unit_rows(right["embedding"]).T, 6)
        fits = (scores >= threshold) & (np.searchsorted(others, ids)[:, None] > np.arange(len(others)))
        rows = np.flatnonzero(fits.any(axis=1))
        first = fits[rows].argmax(axis=1)
        return pd.DataFrame(
            {row_id: ids[rows], "dup_of": others[first], "score": scores[rows, first]}
        )

    return kernel


def _collapse(df: DataFrame, content: str, row_id: str, block: list[str] | None = None):
    """Split rows into the first of each distinct content and ``(row_id, _rep)`` of the copies.

    Contents are compared by two 64-bit hashes, so only ids and hashes are shuffled to
    find the copies; ``min`` is combined map-side, whatever the size of a group.
    """
    stored = materialize(df, "contents")
    keys = ["_h1", "_h2", *(block or [])]
    hashed = stored.select(row_id, *(block or []), F.xxhash64(content).alias("_h1"),
                           F.xxhash64(F.reverse(content)).alias("_h2"))
    first = hashed.groupBy(*keys).agg(F.min(row_id).alias("_rep"), F.count(F.lit(1)).alias("_n"))
    copies = materialize(
        join_counted(hashed, first.where(F.col("_n") > 1), keys, null_safe=True)
        .where(F.col(row_id) != F.col("_rep")).select(row_id, "_rep"), "copies"
    )
    if copies.isEmpty():
        return stored, copies
    return materialize(stored.join(copies.select(row_id), row_id, "left_anti"), "distinct"), copies


def dedupe_semantic(df: DataFrame, threshold: float, block: list[str] | None = None,
                    row_id: str = "posting_id", leaders: int = 256, tile_rows: int = 2048,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Tier 3: link each posting to the earliest posting of its block whose vector has
    cosine similarity of at least ``threshold`` (to six places). Exact.

    1. Equal vectors collapse to their first row.
    2. The remaining rows meet the first ``leaders`` rows of their block. A match here
       is final, since no earlier row is left to test; a large group of near copies
       ends here, in work linear in its size.
    3. Rows still unmatched meet the whole block in bounded tiles.
    """
    block = list(block or [])
    id_type = dict(df.dtypes)[row_id]
    schema = f"{row_id} {id_type}, dup_of {id_type}, score double"
    rows = df.select(row_id, "embedding", *block).where(
        F.exists("embedding", lambda x: x != 0))  # a zero vector resembles nothing
    reps, copies = _collapse(rows, "embedding", row_id, block)

    rank = F.row_number().over(Window.partitionBy(*block).orderBy(row_id))
    heads = reps.withColumn("_rank", rank).where(F.col("_rank") <= leaders).drop("_rank")
    kernel = _earliest_similar(row_id, threshold)
    early = materialize(
        tiled(reps, heads, row_id, row_id, block, kernel, schema, tile_rows, hot_rows), "leader-edges"
    )
    # Leaders have met every earlier row already.
    done = early.select(row_id).union(heads.select(row_id)).distinct()
    rest = reps.join(done, row_id, "left_anti")
    late = tiled(rest, reps, row_id, row_id, block, kernel, schema, tile_rows, hot_rows)
    matched = early.unionByName(late).groupBy(row_id).agg(
        F.min(F.struct("dup_of", "score")).alias("_m")
    ).select(row_id, "_m.dup_of", "_m.score")
    matched = materialize(matched, "vector-edges")

    of_rep = matched.select(F.col(row_id).alias("_rep"), "dup_of", "score")
    of_copies = copies.join(of_rep, "_rep", "left").select(
        row_id, F.coalesce("dup_of", "_rep").alias("dup_of"), F.coalesce("score", F.lit(1.0)).alias("score")
    )
    return matched.unionByName(of_copies).withColumn("tier", F.lit("semantic"))


def bands_for(threshold: float, bits: int, recall: float) -> int:
    """Bands of ``bits`` random hyperplanes in which two vectors at the threshold share a bucket of
    at least one with the wanted probability."""
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(agree, 1 - 1e-12))))


def dedupe_similar(df: DataFrame, threshold: float, block: list[str] | None = None, row_id: str = "posting_id",
                   bits: int = 16, recall: float = 0.98, most_bands: int = 256, seed: int = 9) -> DataFrame:
    """Tier 3 at scale: link each posting to the earliest similar one that banded hashing finds in
    its block. ``recall`` is the chance to find a pair right at the threshold; closer pairs are
    found almost always. Every edge is checked on the vectors themselves.

    A vector gets one bucket per band, from the signs of ``bits`` random projections. Only
    ids travel to the buckets, and ``earliest_matches`` keeps the tested pairs linear in a group of
    copies. A low threshold needs many bands; beyond ``most_bands`` use ``dedupe_semantic``.
    """
    block = list(block or [])
    bands = bands_for(threshold, bits, recall)
    if bands > most_bands:
        raise ValueError(f"a threshold of {threshold} needs {bands} bands of {bits} bits; lower bits, or compare exactly")
    rows = usable(df.select(row_id, "embedding", *block)).where(F.exists("embedding", lambda x: x != 0))
    reps, copies = _collapse(rows, "embedding", row_id, block)
    kind = dict(reps.dtypes)[row_id]
    reps = reps.select(F.col(row_id).alias("id"), "embedding", F.struct(F.lit(0).alias("all"), *block).alias("block"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}  # by vector length
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = batch.column("embedding").to_numpy(zero_copy_only=False)
            lengths = np.array([len(v) for v in vectors], np.int64)
            codes = np.zeros((len(vectors), bands), np.int64)
            for n in np.unique(lengths).tolist():
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, n]).standard_normal((n, bands * bits))
                own = np.flatnonzero(lengths == n)
                up = unit_rows(vectors[own]) @ planes[n] > 0
                codes[own] = (up.reshape(len(own), bands, bits) * powers).sum(2)
            codes = (np.arange(bands) << bits) + codes
            ends = pa.array(np.arange(len(codes) + 1) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("block"), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))],
                ["id", "block", "codes"])

    signed = reps.select("id", "block", "embedding").mapInArrow(sign, f"id {kind}, block {dict(reps.dtypes)['block']}, codes array<long>")
    members = signed.select("id", F.explode("codes").alias("code"), "block").select("id", F.struct("block", "code").alias("point"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(reps.select("id", F.col("embedding").alias("a")), "id").join(
            reps.select(F.col("id").alias("other"), F.col("embedding").alias("b")), "other")
        return both.where(F.size("a") == F.size("b")).select("id", "other", "a", "b").mapInArrow(
            _cosines, f"id {kind}, other {kind}, score double").where(F.col("score") >= threshold)

    found = earliest_matches(members, verify)
    return _with_copies(found, copies, row_id).withColumn("tier", F.lit("semantic"))


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine similarity of the vectors of each pair, to six places."""
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ab")
        lengths = np.array([len(v) for v in a], np.int64)
        score = np.zeros(len(a))
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            score[own] = np.round((unit_rows(a[own]) * unit_rows(b[own])).sum(1), 6)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("other"), pa.array(score)], ["id", "other", "score"])


def _with_copies(found: DataFrame, copies: DataFrame, row_id: str) -> DataFrame:
    """Matches of representatives, and those of the rows that have the same content."""
    own = found.select(F.col("id").alias(row_id), "dup_of", "score")
    of_copies = copies.join(found.select(F.col("id").alias("_rep"), "dup_of", "score"), "_rep", "left").select(
        row_id, F.coalesce("dup_of", "_rep").alias("dup_of"), F.coalesce("score", F.lit(1.0)).alias("score"))
    return own.unionByName(of_copies)


# ---- tier 3 by wording: similar shingle sets ------------------------------------

def shingles(words, n: int = 3):
    """Distinct hashed word ``n``-grams of a token column; a shorter text is one shingle."""
    short = F.array(F.array_join(words, " "))
    grams = F.when(F.size(words) >= n, tx.word_ngrams(words, n)).otherwise(short)
    return F.sort_array(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))))


def near_dup_text(df: DataFrame, jaccard: float, row_id: str = "posting_id",
                  text: str = "description", leaders: int = 16, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Link each text to the earliest text whose shingle sets overlap by ``jaccard``. Exact.

    Equal sets collapse first. Two sets that similar must share one of the rarest
    shingles of each (prefix filter), so those shingles are the meeting points. At a
    meeting point texts are compared with its first few members only; the next wave
    takes the next members, for texts that can still find an earlier match. A group of
    near copies is settled by its first member, so pairs are never all produced, and
    the waves go on until nothing is left to test.
    """
    words = df.select(row_id, tx.tokens(text).alias("_words"))
    sets = words.select(row_id, shingles(F.col("_words")).alias("_set"))
    reps, copies = _collapse(sets, "_set", row_id)
    reps = reps.select(F.col(row_id).alias("id"), F.col("_set").alias("set"), F.size("_set").alias("n"))

    each = reps.select("id", "n", F.explode("set").alias("sh"))
    spread = each.groupBy("sh").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    shared = join_counted(each, spread.withColumn("_n", F.col("df")), ["sh"], hot_rows=hot_rows)
    # Shingles found in one text only come first in the rarity order but meet nobody.
    own = Window.partitionBy("id")  # bounded by one text
    prefix_length = F.col("n") - F.ceil(F.col("n") * F.lit(float(jaccard)) - 1e-9) + 1
    members = (
        shared.withColumn("_pos", F.row_number().over(own.orderBy("df", "sh")))
        .withColumn("_shared", F.count(F.lit(1)).over(own))
        .where(F.col("n") - F.col("_shared") + F.col("_pos") <= prefix_length)
        .select("sh", "df", "id", "n")
    )
    members = materialize(members, "meeting-points")
    found = None  # id, dup_of, score of the best match so far
    waiting, width = members, leaders
    while not waiting.isEmpty():
        rank = F.row_number().over(Window.partitionBy("sh").orderBy("id"))
        heads = waiting.withColumn("_rank", rank).where(F.col("_rank") <= width)
        heads = materialize(
            heads.select("sh", "df", F.col("id").alias("other"), F.col("n").alias("other_n")), "heads")
        testers = members if found is None else members.join(
            found.select("id", "dup_of"), "id", "left")
        can_match = (
            (F.col("other") < F.col("id"))
            & (F.col("other_n") >= F.col("n") * jaccard - 1e-9)
            & (F.col("n") >= F.col("other_n") * jaccard - 1e-9)
        )
        if found is not None:
            can_match &= F.col("dup_of").isNull() | (F.col("other") < F.col("dup_of"))
        # Points with very many members are few (shingles / hot_rows), so their heads are broadcast.
        hot = F.col("df") > hot_rows
        meet = testers.where(~hot).join(heads.where(~hot).drop("df"), "sh").unionByName(
            testers.where(hot).join(F.broadcast(heads.where(hot).drop("df")), "sh"))
        pairs = materialize(meet.where(can_match).select("id", "other").distinct(), "pairs")
        wanted = pairs.groupBy("other").agg(F.count(F.lit(1)).alias("_n"))
        theirs = reps.select(F.col("id").alias("other"), F.col("set").alias("_b")).join(wanted, "other")
        mine = pairs.join(reps.select("id", F.col("set").alias("_a")), "id")
        hits = (
            join_counted(mine, theirs, ["other"], hot_rows=hot_rows)
            .withColumn("_common", F.size(F.array_intersect("_a", "_b")))
            .withColumn("score", F.col("_common") / (F.size("_a") + F.size("_b") - F.col("_common")))
            .where(F.col("score") >= jaccard)
            .select("id", F.col("other").alias("dup_of"), "score")
        )
        if found is not None:
            hits = hits.unionByName(found)
        found = materialize(
            hits.groupBy("id").agg(F.min(F.struct("dup_of", "score")).alias("_m"))
            .select("id", "_m.dup_of", "_m.score"), "text-edges"
        )
        # What remains: members past this wave, at points where someone can still gain.
        last = heads.groupBy("sh").agg(F.max("other").alias("_last"))
        open_until = (
            members.join(found.select("id", "dup_of"), "id", "left")
            .groupBy("sh").agg(F.max(F.coalesce("dup_of", "id")).alias("_until"))
        )
        waiting = materialize(
            waiting.join(last, "sh").where(F.col("id") > F.col("_last"))
            .join(open_until, "sh").where(F.col("id") < F.col("_until"))
            .select("sh", "df", "id", "n"), "waiting"
        )
        width *= 4

    if found is None:
        found = reps.select("id", F.col("id").alias("dup_of"), F.lit(1.0).alias("score")).limit(0)
    of_rep = found.select(F.col("id").alias("_rep"), "dup_of", "score")
    of_copies = copies.join(of_rep, "_rep", "left").select(
        row_id, F.coalesce("dup_of", "_rep").alias("dup_of"), F.coalesce("score", F.lit(1.0)).alias("score")
    )
    own = found.select(F.col("id").alias(row_id), "dup_of", "score")
    return own.unionByName(of_copies).withColumn("tier", F.lit("wording"))


def minhash_shape(jaccard: float, recall: float, most_rows: int = 5) -> tuple[int, int]:
    """Bands and rows of a band: as many rows as keep the bands at 128 or fewer."""
    for rows in range(most_rows, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(jaccard ** rows, 1 - 1e-12))))
        if bands <= 128 or rows == 1:
            return bands, rows
    raise AssertionError


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread by two odd factors."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def near_dup_minhash(df: DataFrame, jaccard: float, row_id: str = "posting_id", text: str = "description",
                     recall: float = 0.98, seed: int = 1) -> DataFrame:
    """The approximate form of ``near_dup_text``: MinHash signatures in bands. One row per posting that has an
    earlier similar one; texts with equal shingle sets collapse to a representative first.

    Signatures are minima over the mixed shingle hashes; only ids and band hashes are shuffled to
    find candidates, which are checked on the whole sets.
    """
    bands, rows = minhash_shape(jaccard, recall)
    words = df.select(row_id, tx.tokens(text).alias("_words"))
    sets = words.select(row_id, shingles(F.col("_words")).alias("_set"))
    reps, copies = _collapse(sets, "_set", row_id)
    reps = reps.select(F.col(row_id).alias("id"), F.col("_set").alias("set")).where(F.size("set") > 0)

    kind = dict(reps.dtypes)["id"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.default_rng(seed).integers(0, 2**63, (bands, rows), np.int64).astype(np.uint64)
        for batch in batches:
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            for place, own in enumerate(batch.column("set").to_numpy(zero_copy_only=False)):
                own = np.asarray(own, np.int64).view(np.uint64)
                for band in range(bands):  # one band at a time, so a long text needs no large matrix
                    lowest = _mixed(own[None, :] ^ seeds[band][:, None]).min(1)
                    keys[place, band] = _mixed(np.cumsum(_mixed(lowest + np.uint64(band))))[-1]
            ends = pa.array(np.arange(len(keys) + 1) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel()))], ["id", "keys"])

    signed = reps.mapInArrow(sign, f"id {kind}, keys array<long>")
    members = signed.select("id", F.posexplode("keys").alias("band", "key")).select("id", F.struct("band", "key").alias("point"))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(reps.select("id", F.col("set").alias("a")), "id").join(
            reps.select(F.col("id").alias("other"), F.col("set").alias("b")), "other")
        common = F.size(F.array_intersect("a", "b"))
        return both.withColumn("common", common).withColumn(
            "score", F.col("common") / (F.size("a") + F.size("b") - F.col("common"))).where(F.col("score") >= jaccard)

    return _with_copies(earliest_matches(members, verify), copies, row_id).withColumn("tier", F.lit("wording"))


# ---- transitive closure and survivors -------------------------------------------

def resolve_clusters(edges: DataFrame, a: str = "posting_id", b: str = "dup_of",
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(node, job_id)``: every node with the smallest id of its connected component.

    A leaf, a node with one link that goes to a smaller one, can neither join two components nor be
    the smallest of its own. So leaves are set aside, follow their neighbour at the end and
    are not shuffled in the rounds between.

    The other links go through alternating large-star and small-star rounds (published MapReduce
    connected components): each is a map-side combined ``min`` and a join back, and the number
    of rounds grows with the logarithm of the longest chain. Each round is written to
    the shared folder, so neither lineage nor a lost executor costs earlier rounds, and goes
    when the next one is there.
    """
    links = edges.select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    ).where(F.col("hi").isNotNull() & (F.col("hi") != F.col("lo"))).distinct()
    loops = materialize(edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct(), "loops")
    every = materialize(links, "links", CODEC)
    above = materialize(every.select(F.col("lo").alias("node")).distinct(), "above", CODEC)
    forked = every.groupBy("hi").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(F.col("hi").alias("node"))
    inner = materialize(above.union(forked).distinct().withColumn("inner", F.lit(True)), "inner", CODEC)
    parted = materialize(every.join(inner, F.col("hi") == F.col("node"), "left").select(
        "hi", "lo", F.col("inner").isNotNull().alias("inner")), "links", CODEC)
    discard(every, inner)

    links = materialize(parted.where("inner").select("hi", "lo"), "links")
    while not _settled(links):
        wide = materialize(_large_star(links, hot_rows), "links")
        discard(links)
        links = materialize(_small_star(wide, hot_rows), "links")
        discard(wide)
    members = links.select(F.col("hi").alias("node"), F.col("lo").alias("job_id"))
    leaves = parted.where("NOT inner").select(F.col("hi").alias("leaf"), "lo").join(
        members, F.col("lo") == F.col("node"), "left").select(
        F.col("leaf").alias("node"), F.coalesce("job_id", "lo").alias("job_id"))
    roots = above.union(links.select("lo")).distinct().join(members.select("node"), "node", "left_anti")
    found = members.unionByName(leaves).unionByName(roots.select("node", F.col("node").alias("job_id")))
    if not loops.isEmpty():
        alone = loops.join(found.select("node"), "node", "left_anti")
        found = found.unionByName(alone.select("node", F.col("node").alias("job_id")))
    clusters = materialize(found, "clusters", CODEC)
    discard(loops, above, parted, links)
    return clusters


def _settled(links: DataFrame) -> bool:
    """Whether every node points at one root, and no root points anywhere."""
    forked = links.groupBy("hi").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    chained = links.join(links.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi")
    return forked.isEmpty() and chained.isEmpty()


def _large_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Point every larger neighbour of a node at the node's smallest neighbour."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).select(
        "u", F.least("u", "_m").alias("m"), "_n")
    return (
        join_counted(both.where(F.col("v") > F.col("u")), smallest, ["u"], hot_rows=hot_rows)
        .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    )


def _small_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    smallest = links.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("_n"))
    # A node with one smaller neighbour stays as it is; only the others join back.
    forked = smallest.where(F.col("_n") > 1)
    moved = join_counted(links, forked, ["hi"], hot_rows=hot_rows).where(F.col("lo") != F.col("m")).select(
        F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(smallest.select("hi", F.col("m").alias("lo"))).distinct()


def assign_jobs(postings: DataFrame, clusters: DataFrame, row_id: str = "posting_id") -> DataFrame:
    """Add ``job_id``; a posting without duplicates is its own job."""
    named = clusters.select(F.col("node").alias(row_id), "job_id")
    return postings.join(named, row_id, "left").withColumn("job_id", F.coalesce("job_id", row_id))


def merge_cluster(df: DataFrame, row_id: str = "posting_id") -> DataFrame:
    """One row per job: the earliest posting's wording, merged ranges and counts. Texts are read only of
    the postings that are the earliest of a job, so they are not shuffled for all."""
    jobs = materialize(df.groupBy("job_id").agg(
        F.min(row_id).alias("_first"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("comp_min").alias("comp_min"), F.max("comp_max").alias("comp_max"),
        F.count(F.lit(1)).alias("n_postings"), F.count_distinct("source").alias("n_sources"),
    ), "jobs", CODEC)
    first = jobs.select(F.col("_first").alias(row_id))
    wording = df.select("job_id", row_id, "title", "company").join(first, row_id, "left_semi").groupBy(
        F.col("job_id").alias("_job")).agg(F.min_by("title", row_id).alias("title"), F.min_by("company", row_id).alias("company"))
    return jobs.join(wording, F.col("job_id").eqNullSafe(F.col("_job")), "left").select(
        "job_id", "title", "company", "first_seen", "last_seen", "comp_min", "comp_max", "n_postings", "n_sources")


def provenance(df: DataFrame) -> DataFrame:
    """Where each job was seen, one row per job and source. A table and not an array
    per job, so a job found at very many sources stays distributed."""
    return df.groupBy("job_id", "source").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.count(F.lit(1)).alias("n_postings"),
    )
