"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are parted into bands of like norm, a quarter of an octave wide, each with its own buckets;
a query visits all bands. In a band the largest inner product becomes nearest distance: a
vector gets one more component that brings its norm to the largest of the band; a query is
scaled to that norm and gets 0. So a few long vectors do not crowd the others together. A
table hashes with ``HASHES`` Gaussian projections cut into slots. A query visits the
``PROBES`` buckets around its own in order of estimated success: the sum of squared
distances to the slot borders that a perturbation crosses. Candidates of all tables meet in
the exact inner product, in double precision.

A bucket is cut into tiles of about ``TILE`` vectors, so a bucket with a third of all rows is
many tasks, and a task passes on only its best ``k`` of a query. Queries that found fewer
than ``k`` meet every vector, in tiles. Parameters do not depend on the number of rows, so
recall does not fall as data grows. On vectors without any structure, as those measured
here, recall over 0.9 means looking at most of them; on clustered ones few buckets hold them.

Null, empty or zero vectors and those with null or non-finite components take no part.
Products too large for a double are infinite, ties among them go by id; a sum of opposite
infinities is no score. Only vectors of equal length are compared. Ties go to the smaller id. A row that repeats
an id is no neighbour of that id, and stands once in a result, with its best score. Rows
without an id take no part. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from hirelake.session import materialize

TABLES, HASHES, WIDTH, PROBES = 4, 6, 2.5, 30
TILE = 4096
SLACK = 1e-9  # matrix products of equal vectors may differ in the last bits


def usable(vector: str) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, one row each."""
    return np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)])


def norm_of(vector: str) -> Column:
    """Euclidean norm, by the largest component first, so that no square overflows."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    # The array binds the largest component, so it is found once and not for every component.
    return F.transform(F.array(largest), lambda m: m * F.sqrt(F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + (x.cast("double") / m) * (x.cast("double") / m))))[0]


def directions(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Hashes:
    """The tables' projections for one vector length, the same in every task and band."""

    def __init__(self, dim: int, seed: int) -> None:
        rng = np.random.default_rng([seed, dim])
        self.dim = dim
        self.lines = rng.normal(size=(TABLES, dim + 1, HASHES))
        self.shift = rng.uniform(0, WIDTH, (TABLES, 1, HASHES))
        self.steps = np.array(list(product((0, -1, 1), repeat=HASHES)), np.int64)

    def keys(self, slots: np.ndarray, band: int) -> np.ndarray:
        """A number for band, table and bucket; ``slots``: tables x rows x hashes."""
        flat = np.ascontiguousarray(slots.astype(np.int32)).reshape(TABLES, -1, HASHES)
        seeds = [(band + 5000 << 32) + self.dim * TABLES + t for t in range(TABLES)]
        return np.array([[xxhash.xxh3_64_intdigest(bucket.tobytes(), seed=seed) >> 1 for bucket in table]
                         for seed, table in zip(seeds, flat)], np.int64).reshape(slots.shape[:-1])

    def places(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.lines + self.shift) / WIDTH

    def stored(self, vectors: np.ndarray, band: int, bound: float) -> np.ndarray:
        inside = vectors / bound
        more = np.sqrt(np.maximum(0, 1 - (inside ** 2).sum(1)))
        return self.keys(np.floor(self.places(np.hstack([inside, more[:, None]]))), band)

    def slots_visited(self, vectors: np.ndarray) -> np.ndarray:
        """Tables x rows x probes x hashes, most promising first; the same in every band."""
        at = self.places(np.hstack([directions(vectors), np.zeros((len(vectors), 1))]))
        slot = np.floor(at)
        inside = at - slot
        # Squared distance to the border below and above, summed over the hashes that move.
        cost = (inside ** 2) @ (self.steps.T == -1) + ((1 - inside) ** 2) @ (self.steps.T == 1)
        best = np.argsort(cost, axis=-1, kind="stable")[..., :PROBES]
        return slot[:, :, None, :] + self.steps[best]


def hashed(vectors: DataFrame, bounds: dict[int, float], seed: int, queries: bool) -> DataFrame:
    """``key, id, vector``: a row for each bucket that a vector is stored in, or visits. ``bounds``
    holds the largest norm of each band: at most a few thousand, whatever the table."""
    kind = dict(vectors.dtypes)["vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Hashes] = {}
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("vector").to_numpy(zero_copy_only=False)])
            bands = np.zeros_like(lengths) if queries else batch.column("band").to_numpy()
            for dim, band in sorted(set(zip(lengths.tolist(), bands.tolist()))):
                part = batch.filter(pa.array((lengths == dim) & (bands == band)))
                if dim not in known:
                    known[dim] = Hashes(dim, seed)
                rows = matrix(part.column("vector"))
                if queries:
                    slots = known[dim].slots_visited(rows)
                    keys = np.concatenate([known[dim].keys(slots, b) for b in sorted(bounds)], axis=2)
                else:
                    keys = known[dim].stored(rows, band, bounds[band])[:, :, None]
                keys = keys.transpose(1, 0, 2).reshape(len(rows), -1)
                at = pa.array(np.repeat(np.arange(len(rows)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), part.column("id").take(at), part.column("vector").take(at)], ["key", "id", "vector"])

    return vectors.mapInArrow(run, f"key long, id long, vector {kind}")


def scored(stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every query in every tile where both meet: ``query_id, vec_id, score``."""
    both = asked.select("key", "tile", F.lit(1).alias("asks"), "id", "vector").unionByName(
        stored.select("key", "tile", F.lit(0).alias("asks"), "id", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_ids, held, base_ids, base = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, tile, asks = (batch.column(c).to_numpy() for c in ("key", "tile", "asks"))
            ids, vectors = batch.column("id").to_numpy(), matrix_or_parts(batch.column("vector"))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(tile) != 0) | (np.diff(asks) != 0)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(key)]):
                where = (key[first], tile[first])
                if where != now:
                    now, held_ids, held, base = where, [], [], None
                if not asks[first]:
                    held_ids.append(ids[first:last])
                    held.append(vectors[first:last])
                    continue
                if not held:
                    continue  # nobody is stored here
                if base is None:
                    base_ids, base = np.concatenate(held_ids), np.concatenate(held)
                yield best_of(ids[first:last], vectors[first:last], base_ids, base, k)

    return both.repartition("key", "tile").sortWithinPartitions("key", "tile", "asks", "id").mapInArrow(
        run, "query_id long, vec_id long, score double")


def matrix_or_parts(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix; of several lengths, as an array of rows (a key has one)."""
    rows = [np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]
    if len({len(r) for r in rows}) == 1:
        return np.stack(rows)
    out = np.empty(len(rows), object)
    out[:] = rows
    return out


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pa.RecordBatch:
    if queries.dtype == object:
        queries = np.stack(list(queries))
    if vectors.dtype == object:
        vectors = np.stack(list(vectors))
    with np.errstate(over="ignore", invalid="ignore"):
        rough = queries @ vectors.T
        scale = SLACK * np.linalg.norm(queries, axis=1) * max(1e-300, float(np.linalg.norm(vectors, axis=1).max()))
    scale = np.minimum(scale, 1e300)
    rough[np.isnan(rough)] = -np.inf
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(rough), -np.inf)
    row, col = np.nonzero((rough >= (least - scale)[:, None]) & (rough > -np.inf))
    with np.errstate(over="ignore", invalid="ignore"):
        exact = (queries[row] * vectors[col]).sum(1)
    fine = ~np.isnan(exact)
    row, col, exact = row[fine], col[fine], exact[fine]
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, int)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    top = place < k
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[row[top]], pa.int64()), pa.array(ids[col[top]], pa.int64()), pa.array(exact[top])],
        ["query_id", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 5, tile: int = TILE) -> DataFrame:
    """``query_id, rank, vec_id, score`` from two frames of ``id`` and ``vector``."""
    vectors, queries = (d.select(F.col("id").cast("long").alias("id"), "vector").where(usable("vector") & F.col("id").isNotNull())
                        for d in (vectors, queries))
    normed = vectors.withColumn("norm", norm_of("vector")).withColumn("band", F.floor(F.log2("norm") * 4 + 0.5).cast("int"))
    bounds = {r.band: r.norm for r in normed.groupBy("band").agg(F.max("norm").alias("norm")).collect()}
    stored = hashed(normed.select("id", "vector", "band"), bounds, seed, queries=False)
    # The tiles of a bucket, for those that have more than one.
    crowded = stored.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")).where("tiles > 1")
    tiles = F.coalesce("tiles", F.lit(1))
    inside = stored.join(crowded, "key", "left").withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int"))
    asked = hashed(queries, bounds or {0: 1.0}, seed, queries=True).join(crowded, "key", "left").withColumn(
        "tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    top = materialize(ranked(scored(inside, asked, k), k), "nearest")
    full = top.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = materialize(queries.join(full, "id", "left_anti"), "short")
    if not short.isEmpty():
        many = max(1, -(-vectors.count() // tile))
        everyone = vectors.select(F.size("vector").cast("long").alias("key"), F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("tile"), "id", "vector")
        again = short.withColumn("key", F.size("vector").cast("long")).withColumn(
            "tile", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        top = ranked(scored(everyone, again, k).unionByName(top.select("query_id", "vec_id", "score")), k)
    return top.select("query_id", "rank", "vec_id", "score")
