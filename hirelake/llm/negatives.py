"""Hard negatives from exact integer scores by matrix products in a residue number system.

Components become whole numbers. Their residues modulo a few primes below 1,024, centred on
zero, are multiplied as float32 matrices; a product sums at most ``CHUNK`` components at a time,
so it never passes 2**24 and stays exact. Chinese remaindering in balanced mixed radix gives
the signed scores back. As many primes are used as the norms of a tile ask for.

Anchors meet all rows in a grid of bounded tiles, twice. First each tile passes on the best
rows of an anchor's own label; the best of all tiles are its positives. Then each tile passes
on, for every positive, the first rows of other labels whose score lies in the positive's
window. A tile is at most ``MOST`` rows and dealt by chance, so neither a common vector, label
or id nor a large table makes it larger; only the few best of each tile are shuffled again.

Rows without an id or label, and null vectors or those with a null or non-finite component,
take no part. Vectors of different lengths are compared as if filled up with zeros, an empty
vector scores 0. A row of the anchor's own id is neither its positive nor its negative. Each row
that repeats counts by itself as a candidate; anchor rows that are all equal are one anchor, and
those that share an id only have lists of their own. Higher scores come first, ties by smaller
id. Pairs whose norms multiply to ``LIMIT`` or more, near the end of 64-bit scores, are left out. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.session import materialize

SCALE = 256
MOST = 32_768  # rows of a tile on either side
FEWEST = 256
CHUNK = 64
AT_ONCE = 4_000_000  # scores held in memory
LIMIT = 2.0**56


def primes_below(bound: int, n: int) -> list[int]:
    """The ``n`` largest primes below the bound."""
    return [p for p in range(bound - 1, 1, -1) if all(p % d for d in range(2, math.isqrt(p) + 1))][:n]


# (p // 2) ** 2 * CHUNK <= 2 ** 24 for each, and six of them cover twice the limit.
PRIMES = primes_below(1024, 6)


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers in float64, moved into -(p // 2) .. p // 2."""
    return x - p * np.rint(x / p)


class Residues:
    """Whole-number vectors by their residues, and their norms."""

    def __init__(self, vectors: list[np.ndarray], dim: int) -> None:
        rows = np.zeros((len(vectors), dim))
        for k, v in enumerate(vectors):
            rows[k, :len(v)] = v
        with np.errstate(over="ignore"):
            big = np.abs(rows) >= 2.0**44  # such a number times SCALE is whole already, and may not be finite
            whole = np.where(big, 0.0, np.floor(rows * SCALE))
            self.norms = np.sqrt(np.square(np.where(big, rows * SCALE, whole)).sum(1))
        self.parts = []
        for p in PRIMES:
            part = np.fmod(whole, p)
            if big.any():
                part = np.where(big, np.fmod(np.fmod(rows, p) * SCALE, p), part)
            self.parts.append(centred(part, p).astype(np.float32))

    def needed(self, other: Residues) -> int:
        """How many primes tell all scores below the limit apart."""
        most = min(LIMIT, float(self.norms.max(initial=0)) * float(other.norms.max(initial=0)) * (1 + 1e-9))
        count, product = 1, PRIMES[0]
        while product <= 2 * most + 2:
            product *= PRIMES[count]
            count += 1
        return count

    def scores(self, other: Residues, some: slice) -> tuple[np.ndarray, np.ndarray | None]:
        """Exact scores of some of these rows with all of the other's, and which pairs are too
        large to have one (None: no pair)."""
        digits: list[np.ndarray] = []
        for k in range(self.needed(other)):
            p, mine, theirs = PRIMES[k], self.parts[k][some], other.parts[k]
            left = np.zeros((len(mine), len(theirs)))
            for c in range(0, mine.shape[1], CHUNK):
                left += mine[:, c:c + CHUNK] @ theirs[:, c:c + CHUNK].T
            # Balanced mixed radix: take the known digits away and divide by their primes.
            for before, digit in zip(PRIMES, digits):
                left = centred(left - digit, p) * pow(before, -1, p)
            digits.append(centred(left, p))
        total = digits[-1].astype(np.int64)
        for p, digit in zip(reversed(PRIMES[:len(digits) - 1]), reversed(digits[:-1])):
            total = total * p + digit.astype(np.int64)
        if float(self.norms.max(initial=0)) * float(other.norms.max(initial=0)) < LIMIT:
            return total, None
        with np.errstate(over="ignore", invalid="ignore"):
            fits = self.norms[some][:, None] * other.norms[None, :] < LIMIT
        return total, ~fits


NONE = np.iinfo(np.int64).min  # below every score


def first_best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``n`` highest scores of each row, ties by column."""
    if scores.shape[1] > n:
        least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    else:
        least = np.full(len(scores), NONE)
    row, col = np.nonzero((scores >= least[:, None]) & (scores > NONE))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], col[place < n]


def usable(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & fine


def side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, labels and vectors, in order of id."""
    table = table.sort_by("id")
    vectors = [np.asarray(v, np.float64) for v in table.column("vector").to_numpy()]
    return table.column("id").to_numpy(), table.column("label").to_numpy(), vectors


def met(anchors: pa.Table, rows: pa.Table):
    """Scores of a tile, a bounded number of anchors at a time: the anchors' places, scores,
    and where the row has the anchor's label or takes no part."""
    if not anchors.num_rows or not rows.num_rows:
        return
    own, ids, labels = anchors.column("id").to_numpy(), *side(rows)[:2]
    theirs, mine = side(rows)[2], [np.asarray(v, np.float64) for v in anchors.column("vector").to_numpy()]
    dim = max(map(len, [*mine, *theirs]))
    left, right = Residues(mine, dim), Residues(theirs, dim)
    step = max(1, AT_ONCE // len(ids))
    for begin in range(0, len(own), step):
        some = slice(begin, begin + step)
        scores, wide = left.scores(right, some)
        out = own[some][:, None] == ids[None, :]
        if wide is not None:
            out |= wide
        same = anchors.column("label").to_numpy()[some][:, None] == labels[None, :]
        yield some, ids, scores, same, out


def tiled(anchors: DataFrame, rows: DataFrame, kernel, schema: str, n_anchors: int, n_rows: int) -> DataFrame:
    """Run the kernel on every tile of the grid. Sides of a tile are as small as there are
    partitions to work on them, and never above ``MOST`` rows by expectation."""
    spread = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-n_rows // MOST), min(spread, n_rows // FEWEST))
    down = max(1, -(-n_anchors // MOST))
    chance = lambda seed, n: F.floor(F.rand(seed) * n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = rows.withColumn("across", chance(3, across)).withColumn("down", every(down))
    there = anchors.withColumn("down", chance(5, down)).withColumn("across", every(across))
    return there.groupBy("across", "down").cogroup(here.groupBy("across", "down")).applyInArrow(kernel, schema)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100) -> DataFrame:
    """For every anchor row of ``id``, ``label``, ``vector`` its best rows of the same label, and
    for each of them the first rows of other labels that score between ``low`` and ``high``
    percent of it: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector").where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector"))
    asked = materialize(rows.where(anchors).distinct().withColumn("key", F.xxhash64("label", "vector")), "anchors")
    n_rows, n_anchors = rows.count(), asked.count()

    def best_of_label(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for some, ids, scores, same, gone in met(left, right):
            scores[~same | gone] = NONE
            row, col = first_best(scores, positives)
            out.append((left.column("id").to_numpy()[some][row], left.column("key").to_numpy()[some][row], ids[col], scores[row, col]))
        columns = [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(columns, ["anchor_id", "key", "positive_id", "score"])

    found = tiled(asked, rows, best_of_label, "anchor_id long, key long, positive_id long, score long", n_anchors, n_rows)
    nearest = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "positive_id")
    chosen = found.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= positives)
    lists = chosen.groupBy(F.col("anchor_id").alias("id"), "key").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("found"))
    judged = materialize(asked.join(lists, ["id", "key"]).select(
        "id", "key", "label", "vector", F.col("found.positive_id").alias("positives"), F.col("found.score").alias("scores")), "positives")

    def in_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        names = left.column("positives").to_numpy() if left.num_rows else []
        wanted = left.column("scores").to_numpy() if left.num_rows else []
        for some, ids, scores, same, gone in met(left, right):
            scores[same | gone] = NONE
            order = np.argsort(-np.where(scores == NONE, NONE + 1, scores), axis=1, kind="stable")
            falling = np.take_along_axis(scores, order, 1)
            for place in range(positives):
                has = np.flatnonzero([len(w) > place for w in wanted[some]])
                score = np.array([w[place] for w in wanted[some][has]], np.int64)
                name = np.array([w[place] for w in names[some][has]], np.int64)
                top, bottom = high * score // 100, -(-low * score // 100)
                first = (scores[has] > top[:, None]).sum(1)
                for k in range(min(negatives, len(ids))):
                    at = first + k
                    within = np.flatnonzero(at < len(ids))
                    value = falling[has[within], at[within]]
                    fits = value >= bottom[within]
                    who, at, value = within[fits], at[within][fits], value[fits]
                    out.append((left.column("id").to_numpy()[some][has[who]], left.column("key").to_numpy()[some][has[who]],
                                np.full(len(who), place), name[who], score[who], ids[order[has[who], at]], value))
        columns = [np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 7
        return pa.table(columns, ["anchor_id", "key", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    hard = tiled(judged, rows, in_windows, "anchor_id long, key long, place long, positive_id long, positive_score long, "
                 "negative_id long, negative_score long", n_anchors, n_rows)
    hardest = Window.partitionBy("anchor_id", "key", "place").orderBy(F.desc("negative_score"), "negative_id")
    return hard.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
