"""Similarity join on word shingles with a count-vector R-tree.

A document is the set of its distinct five-word shingles. Two link when their Jaccard
similarity is at least 0.8. The join is exact and goes in four steps.

1. Equal sets are one point; only one document of each goes on.
2. Points that can link share one of their first ``n - ceil(0.8 n) + 1`` shingles in any
   common order. The order here is by how often a shingle's hash group occurs in the corpus,
   counted over all documents, so passages shared by many come last.
3. Shingles are also hashed into ``GROUPS`` groups and the group counts are points of an
   R-tree, one for the documents that meet at a shingle. The summed coordinate minima of a
   point and a node's upper corner bound the overlap with everything below it; nodes and
   points under the overlap that a link needs are passed over. Pairs of long documents are
   bounded once more on ``FINE`` groups, as few groups tell them less apart. Connected
   components of the surviving pairs hold all possible links. (Where more than ``BLOCK`` documents meet at a
   shingle, neighbours in size become edges instead, which holds no less.)
4. Surviving pairs of a component are verified on the whole shingle sets, bounded first by the
   R-tree again; pairs that are connected already are passed over.

A component is split into tiles of a bounded number of shingles, so no task holds a group
that grows: tiles are joined within, then with the first tile, and at last all that is not
yet part of the largest component found meets the others.

Empty and null texts have no shingles and link with nothing. With fewer than five words the
whole sequence is the only shingle. Rows that repeat an id are one document that links by
each of its texts. Rows without an id link with nothing and have no component. Ties go to
the smaller id. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from hirelake.llm.words import WordHashes, rolling, words_of
from hirelake.operators.dedupe import resolve_clusters
from hirelake.session import materialize

WIDTH = 5
GROUPS = 128
FULL = 65_535  # a count of this or more
COUNTERS = 1 << 16
LONG, FINE, FULL_FINE = 1024, 4096, 255
LEAF = 32
PAIRS = 512
BLOCK = 20_000
TILE = 2_000_000  # shingles held together by one task


def shingles(hashes: WordHashes, text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    window = rolling(hashes.of(words), min(WIDTH, len(words)))
    # A short sequence is no shingle of five, whatever its hash.
    return np.unique(window) if len(words) >= WIDTH else window ^ np.uint64(len(words))


def needed(both: np.ndarray | int):
    """The least overlap of linked sets of ``both`` shingles together: 9 * overlap >= 4 * both."""
    return (4 * both + 8) // 9


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= 80 * (len(a) + len(b) - common)


# ---- points, their classes and their prefixes ------------------------------------

def _points(docs: DataFrame) -> DataFrame:
    """``doc_id``, set size ``n`` and a 128-bit digest of the set; and, in rows of their own,
    the counts of shingles by hash group that each task has seen."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            sizes, digests, seen = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(hashes, text)
                seen.append((own & np.uint64(COUNTERS - 1)).astype(np.int64))
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_intdigest(own.tobytes()))
            if seen:
                counts += np.bincount(np.concatenate(seen), minlength=COUNTERS)
            half = np.array([[d >> 64, d & (1 << 64) - 1] for d in digests], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(half[:, 0]), pa.array(half[:, 1]),
                 pa.nulls(len(sizes), pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "counts"])
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array([counts.tolist()], pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        read, "doc_id long, n long, d1 long, d2 long, counts array<long>")


def group_counts(own: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The point of a set: how many of its shingles fall into each group."""
    return np.bincount((own >> np.uint64(32) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def _prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """One row for each distinct set: its smallest id, its point, and its rarest shingles,
    as many as a link must touch."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often = WordHashes(), shared.value
        for batch in batches:
            firsts, digests, sizes, points, fine = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(hashes, text)
                n = len(own)
                order = np.argsort(often[(own & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                firsts.append(own[order[:n - (4 * n + 4) // 5 + 1 if n else 0]].view(np.int64))
                digests.append(xxhash.xxh3_128_intdigest(own.tobytes()))
                sizes.append(n)
                points.append(np.minimum(group_counts(own), FULL).astype(np.uint16).tobytes())
                fine.append(np.minimum(group_counts(own, FINE), FULL_FINE).astype(np.uint8).tobytes() if n >= LONG else None)
            half = np.array([[d >> 64, d & (1 << 64) - 1] for d in digests], np.uint64).reshape(-1, 2).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            flat = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(half[:, 0]), pa.array(half[:, 1]),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(points, pa.binary()),
                 pa.array(fine, pa.binary())], ["doc_id", "n", "d1", "d2", "keys", "point", "fine"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return known.mapInArrow(
        read, "doc_id long, n long, d1 long, d2 long, keys array<long>, point binary, fine binary").where("n > 0").groupBy(
        "d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("point").alias("point"),
        F.first("fine").alias("fine"))


def _meetings(docs: DataFrame, counts: np.ndarray, block: int) -> DataFrame:
    """Edges whose components hold every link. Where neighbours in size at a shared shingle
    differ too much, so does everything on either side of them."""
    sets = materialize(_prefixes(docs, counts).select("id", "n", "keys", "point", "fine"), "prefixes")
    at_key = Window.partitionBy("key")
    by_size = at_key.orderBy("n", "id")
    meet = (
        sets.select("id", "n", F.explode("keys").alias("key"))
        .select("id", "n", "key", F.lag("id").over(by_size).alias("before"), F.lag("n").over(by_size).alias("less"),
                F.lead("n").over(by_size).alias("more"), F.count(F.lit(1)).over(at_key).alias("c"))
        .withColumn("near", F.coalesce(F.col("less") * 5 >= F.col("n") * 4, F.lit(False)))
        .where("near or n * 5 >= more * 4")
    )
    meet = materialize(meet.select("id", "n", "key", F.when(F.col("near"), F.col("before")).alias("before"), "c"), "meetings")
    # Other points may have the same id where rows repeat it; those are one document anyway.
    crowded = meet.where((F.col("c") > block) & F.col("before").isNotNull()).select(
        F.least("id", "before").alias("a"), F.greatest("id", "before").alias("b"))
    points = sets.select("id", "n", "point")
    met = meet.where(F.col("c") <= block).select("id", "n", "key").join(points, ["id", "n"])
    near = materialize(met.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(
        _survivors, "a long, b long, long boolean").where("a <> b").distinct(), "near")
    fine = sets.where("fine is not null").groupBy("id").agg(F.max("fine").alias("fine"), F.count(F.lit(1)).alias("texts"))
    left, right = (fine.select(F.col("id").alias(x), F.col("fine").alias(f"fine_{x}"), F.col("texts").alias(f"texts_{x}"))
                   for x in "ab")
    pairs = near.where("long").join(left, "a").join(right, "b").mapInArrow(_refined, "a long, b long")
    return near.where("not long").select("a", "b").unionByName(pairs).unionByName(crowded.where("a <> b")).distinct()


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of long documents that the bound on ``FINE`` groups lets pass. An id with
    several texts has several points, and its pairs pass unseen."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in ("fine_a", "fine_b"))
        both, least = one.sum(1, dtype=np.int64) + two.sum(1, dtype=np.int64), np.minimum(one, two)
        full = (least == FULL_FINE).any(1) | (one == FULL_FINE).any(1) | (two == FULL_FINE).any(1)
        several = (batch.column("texts_a").to_numpy() > 1) | (batch.column("texts_b").to_numpy() > 1)
        good = full | several | (least.sum(1, dtype=np.int64) >= needed(both))
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs at one shingle whose points allow a link: all of them for a few documents, as
    stars of their components for many."""

    def edges(key: np.ndarray, ids: np.ndarray, sizes: np.ndarray, points: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lengths = np.diff(np.append(starts, len(key)))
        few = np.repeat(lengths <= LEAF, lengths)
        left = np.repeat(starts + lengths, lengths) - np.arange(len(key)) - 1  # rows after this one in its block
        for step in range(1, LEAF):
            x = np.flatnonzero(few & (left >= step))
            if not len(x):
                break
            y = x + step
            fits = sizes[x] * 5 >= sizes[y] * 4
            x, y = x[fits], y[fits]
            good = np.minimum(points[x], points[y]).sum(1) >= needed(sizes[x] + sizes[y])
            x, y = x[good], y[good]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])),
                pa.array((sizes[x] >= LONG) & (sizes[y] >= LONG))], ["a", "b", "long"])
        for first, length in zip(starts[lengths > LEAF], lengths[lengths > LEAF]):
            own, forest = slice(first, first + length), Forest()
            tree, names = CountTree(points[own], sizes[own]), ids[own].tolist()
            pairs = []
            for i in range(length):
                x, n = names[i], int(sizes[first + i])
                for j in tree.probe(points[first + i], n).tolist():
                    if length <= PAIRS and n >= LONG and sizes[first + j] >= LONG:
                        if j > i:
                            pairs.append((min(x, names[j]), max(x, names[j]), True))
                    else:
                        forest.join(x, names[j])
            pairs += [(forest.root(x), x, False) for x in dict.fromkeys(names)]
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "long"), p)) for p in pairs], pa.schema(
                [("a", pa.int64()), ("b", pa.int64()), ("long", pa.bool_())]))

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        points = np.frombuffer(b"".join(batch.column("point").to_pylist()), np.uint16).reshape(-1, GROUPS).astype(np.int32)
        points[points == FULL] = 1 << 22
        now = [batch.column("key").to_numpy(), batch.column("id").to_numpy(), batch.column("n").to_numpy(), points]
        if held:
            now = [np.concatenate(x) for x in zip(held, now)]
        end = int(np.searchsorted(now[0], now[0][-1]))  # the last block may go on in the next batch
        if end:
            yield from edges(*[x[:end] for x in now])
        held = [x[end:] for x in now]
    if held:
        yield from edges(*held)


# ---- the R-tree and the join of a tile -------------------------------------------

class CountTree:
    """R-tree over group counts: leaves of ``LEAF`` points that are alike in size, nodes of
    ``LEAF`` children, and of each its upper corner and its range of sizes."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        # Tile by size, then by the coordinate that varies most.
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * 8)
        self.order = np.lexsort((counts[:, counts.var(0).argmax()] if len(counts) else sizes, slab))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        corner, low, high = self.counts, self.sizes, self.sizes
        self.levels = []
        while True:
            cuts = np.arange(0, len(corner), LEAF)
            corner, low, high = (np.maximum.reduceat(corner, cuts), np.minimum.reduceat(low, cuts),
                                 np.maximum.reduceat(high, cuts))
            self.levels.append((corner, low, high))
            if len(corner) <= LEAF:
                break

    def probe(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places of the points whose bound on the overlap allows a link, best bound first."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[depth]
            low, high = low[at], high[at]
            fits = (high * 5 >= size * 4) & (low * 4 <= size * 5) & (
                np.minimum(corner[at], point).sum(1) >= needed(size + np.maximum(low, -(-4 * size // 5))))
            below = len(self.counts) if depth == 0 else len(self.levels[depth - 1][0])
            at = (at[fits, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        bound = np.minimum(self.counts[at], point).sum(1)
        good = bound >= needed(size + self.sizes[at])
        return self.order[at[good][np.argsort(-bound[good], kind="stable")]]


class Forest:
    """Connected ids; the smallest is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


class Tile:
    """The documents that one task compares."""

    def __init__(self) -> None:
        self.ids, self.sets, self.left, self.right, self.labels = [], [], [], [], []

    def add(self, doc_id: int, own: np.ndarray, left: bool, right: bool, label: int) -> None:
        self.ids.append(doc_id)
        self.sets.append(own)
        self.left.append(left)
        self.right.append(right)
        self.labels.append(label)

    def stars(self) -> Iterator[tuple[int, int]]:
        """Links found, as edges from each document to the smallest id it is connected with here."""
        forest = Forest()
        root, join = forest.root, forest.join
        for doc_id, label in zip(self.ids, self.labels):
            join(doc_id, label)
        sizes = np.array([len(s) for s in self.sets])
        counts = np.array([group_counts(s) for s in self.sets])
        right = np.flatnonzero(self.right)
        if len(right):
            tree = CountTree(counts[right], sizes[right])
            for i in np.flatnonzero(self.left):
                for j in right[tree.probe(counts[i], int(sizes[i]))].tolist():
                    if root(self.ids[i]) != root(self.ids[j]) and linked(self.sets[i], self.sets[j]):
                        join(self.ids[i], self.ids[j])
        for doc_id in self.ids:
            if root(doc_id) != doc_id:
                yield doc_id, root(doc_id)


def _joined(tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """Run the tile join. ``tasks``: ``task, id, is_left, is_right, label``, by document and task."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    rows = tasks.join(texts, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, tile = WordHashes(), None, Tile()

        def out() -> pa.RecordBatch:
            pairs = list(tile.stars())
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                               pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for task, doc_id, left, right, label, text in zip(*(batch.column(c).to_pylist() for c in (
                    "task", "id", "is_left", "is_right", "label", "text"))):
                if task != now:
                    if len(tile.ids) > 1:
                        yield out()
                    now, tile = task, Tile()
                own = shingles(hashes, text)
                if len(own):
                    tile.add(doc_id, own, left, right, label)
        if len(tile.ids) > 1:
            yield out()

    return rows.repartition("task").sortWithinPartitions("task", "id").mapInArrow(run, "a long, b long")


def _links(meetings: DataFrame, sizes: DataFrame, docs: DataFrame, tile: int) -> DataFrame:
    """Edges whose components are those of all links."""
    members = resolve_clusters(meetings, "a", "b").select(F.col("node").alias("id"), F.col("job_id").alias("shelf"))
    placed = members.join(sizes, "id")
    shelves = placed.groupBy("shelf").agg(F.ceil(F.sum("n") / tile).cast("int").alias("tiles"))
    placed = materialize(
        placed.join(shelves, "shelf").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")), "shelves")
    both = [F.lit(True).alias("is_left"), F.lit(True).alias("is_right"), F.col("id").alias("label")]
    within = placed.select(F.struct("shelf", "tile").alias("task"), "id", *both)
    found = materialize(_joined(_named(within), docs), "links")
    large = placed.where("tiles > 1")
    if large.isEmpty():
        return found
    # Every other tile of a large shelf meets its first one.
    star = large.where("tile > 0").select(F.struct("shelf", "tile").alias("task"), "id", F.lit(True).alias("is_left"),
                                          F.lit(False).alias("is_right"), F.col("id").alias("label"))
    first = large.where("tile = 0").withColumn("other", F.explode(F.sequence(F.lit(1), F.col("tiles") - 1))).select(
        F.struct("shelf", F.col("other").alias("tile")).alias("task"), "id", F.lit(False).alias("is_left"),
        F.lit(True).alias("is_right"), F.col("id").alias("label"))
    found = materialize(found.unionByName(_joined(_named(star.unionByName(first)), docs)), "links")
    # What is outside the largest component of its shelf meets the whole shelf.
    labels = _labels(found)
    labelled = materialize(large.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    most = labelled.groupBy("shelf", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("shelf").agg(
        F.max(F.struct("c", "label"))["label"].alias("main"))
    rest = labelled.join(most, "shelf").where("label <> main")
    tiles_of_rest = rest.groupBy("shelf").agg(F.ceil(F.sum("n") / tile).cast("int").alias("rest_tiles"))
    lefts = rest.join(tiles_of_rest, "shelf").withColumn(
        "l", F.pmod(F.xxhash64("id"), F.col("rest_tiles")).cast("int")).withColumn(
        "r", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rights = labelled.join(tiles_of_rest, "shelf").withColumn("r", F.col("tile")).withColumn(
        "l", F.explode(F.sequence(F.lit(0), F.col("rest_tiles") - 1)))
    pair = F.struct("shelf", "l", "r").alias("task")
    crossed = lefts.select(pair, "id", F.lit(True).alias("is_left"), F.lit(False).alias("is_right"), "label").unionByName(
        rights.select(pair, "id", F.lit(False).alias("is_left"), F.lit(True).alias("is_right"), "label"))
    return found.unionByName(_joined(_named(crossed), docs))


def _named(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("task", F.to_json("task"))


def _labels(edges: DataFrame) -> DataFrame:
    return resolve_clusters(edges, "a", "b").select(F.col("node").alias("id"), F.col("job_id").alias("label"))


def components(docs: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``."""
    points = materialize(_points(docs), "points")
    totals = points.where("counts is not null").select(F.posexplode("counts").alias("group", "c")).groupBy("group").agg(
        F.sum("c").alias("c"))
    counts = np.zeros(COUNTERS, np.int64)
    for row in totals.collect():  # COUNTERS rows, however large the corpus
        counts[row.group] = row.c
    rows = points.where("counts is null").drop("counts")
    full = rows.where("doc_id is not null and n > 0")
    classes = full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"))
    meetings = _meetings(docs, counts, block)
    sizes = classes.groupBy("id").agg(F.max("n").alias("n"))
    links = _links(meetings, sizes, docs, tile)
    # A document with several texts stands in several classes and connects them.
    texts = full.join(classes, ["d1", "d2", "n"]).groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    several = full.join(texts.where("a < z"), "doc_id").join(classes, ["d1", "d2", "n"]).where("id > a").select("a", F.col("id").alias("b"))
    labels = _labels(links.unionByName(several))
    named = classes.join(labels, "id", "left").select(
        "d1", "d2", "n", F.coalesce("label", "id").alias("component_id"))
    kept = full.join(named, ["d1", "d2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("doc_id is null or n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return kept.unionByName(alone)


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents with one of each component: the one with the smallest id that stands once.

    A document is decided by its id and its text: rows that share an id but not the text are judged
    apart, and so are rows without an id; both come last in a component. Of rows that repeat both
    id and text one stays, also of null and empty texts. Rows travel as structs, so no column name can clash.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    lean = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    often = materialize(lean.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "id", F.lit(True).alias("often")), "repeated-ids")
    # An id that stands once names its row. The others get a 62-bit digest, above usual ids.
    digest = F.xxhash64("id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    unsure = F.col("id").isNull() | F.col("often").isNotNull()
    named = lean.join(often, "id", "left").withColumn("unsure", unsure).withColumn("key", F.when(unsure, digest).otherwise(F.col("id")))
    found = components(named.select(F.col("key").alias("doc_id"), "text"), **how)
    kept = named.join(found.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti")
    once = kept.where("not unsure").select("row.*")
    if often.isEmpty() and lean.where("id is null").isEmpty():
        return once
    return once.unionByName(kept.where("unsure").dropDuplicates(["key"]).select("row.*"))


SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM texts
  UNION
  SELECT r.doc_id, ways.y FROM reach r JOIN ways ON ways.x = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
