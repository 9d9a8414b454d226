"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (A-Z) and parted at white space and ASCII punctuation. Karp-Rabin
hashes of ``SEED`` words find the places that a document and a test item share. Then the
longest match of unmarked words is marked in both texts, again and again, until none of
``SEED`` words is left; the share of the item's words that are marked is its coverage.
Tiles may stand in any order, so shuffled passages count. Items of fewer words must be
matched whole.

Ties between matches go to the earlier place in the item, then in the document. Null or
empty texts and items match nothing. Repeated documents or items are judged each for
itself. An empty benchmark flags nothing. Other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hirelake.llm.words import WordHashes, rolling

SEED = 4
COVERAGE = 0.6
BLOCK_BYTES = 8_000_000

# ASCII punctuation parts words as white space does.
_PARTED = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)


def parted(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_PARTED).split() if text else []


class Items:
    """A block of test items and the hashes of all their seeds."""

    def __init__(self, rows: list, seed: int = SEED) -> None:
        hashes = WordHashes()
        self.ids, self.words, self.seeds = [], [], {}
        found: dict[int, list] = {}
        for item_id, text in rows:
            words = parted(text)
            if not words:
                continue
            width, item = min(seed, len(words)), len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            window = rolling(hashes.of(words), width)
            found.setdefault(width, []).append((window, np.full(len(window), item), np.arange(len(window))))
        for width, parts in found.items():
            window, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(window, kind="stable")
            self.seeds[width] = window[order], item[order], at[order]

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(item, width, places in the document, places in the item)`` for items that share a seed."""
        for width, (windows, items, places) in self.seeds.items():
            mine = rolling(hashes, width)
            first = np.searchsorted(windows, mine)
            at = np.flatnonzero(windows[np.minimum(first, len(windows) - 1)] == mine)
            if not len(at):
                continue
            last = np.searchsorted(windows, mine[at], "right")
            many = last - first[at]
            spot = np.repeat(first[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            doc_at, item, item_at = np.repeat(at, many), items[spot], places[spot]
            order = np.argsort(item, kind="stable")
            cuts = np.flatnonzero(np.diff(item[order])) + 1
            for part in np.split(order, cuts):
                yield int(item[part[0]]), width, doc_at[part], item_at[part]


def tiles(doc: list[bytes], test: list[bytes], width: int, doc_at: np.ndarray, test_at: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiling from the shared seeds: ``(place in doc, place in test, words)``."""
    order = np.lexsort((doc_at, doc_at - test_at))
    doc_at, test_at = doc_at[order], test_at[order]
    doc_free, test_free = np.ones(len(doc), bool), np.ones(len(test), bool)
    found = []
    while len(doc_at):
        # Runs of neighbouring seeds on one diagonal are maximal matches of unmarked words.
        new = np.concatenate([[True], (np.diff(doc_at) != 1) | (np.diff(doc_at - test_at) != 0)])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(doc_at))) + width - 1
        best = min(range(len(starts)), key=lambda k: (-lengths[k], test_at[starts[k]], doc_at[starts[k]]))
        i, j, n = int(doc_at[starts[best]]), int(test_at[starts[best]]), int(lengths[best])
        if doc[i:i + n] != test[j:j + n]:  # equal hashes of other words
            real = [doc[x:x + width] == test[y:y + width] for x, y in zip(doc_at, test_at)]
            doc_at, test_at = doc_at[real], test_at[real]
            continue
        found.append((i, j, n))
        doc_free[i:i + n] = test_free[j:j + n] = False
        doc_taken, test_taken = np.cumsum(np.append(0, ~doc_free)), np.cumsum(np.append(0, ~test_free))
        open_ = (doc_taken[doc_at + width] == doc_taken[doc_at]) & (test_taken[test_at + width] == test_taken[test_at])
        doc_at, test_at = doc_at[open_], test_at[open_]
    return found


def judged(items: Items, hashes: WordHashes, text: str | None, coverage: float) -> list[tuple]:
    """``(item_id, words, covered, tiles)`` of the items that the text covers enough."""
    words = parted(text)
    out = []
    for item, width, doc_at, item_at in items.hits(hashes.of(words)):
        test = items.words[item]
        touched = np.zeros(len(test) + 1, int)
        np.add.at(touched, item_at, 1)
        np.add.at(touched, item_at + width, -1)
        if (np.cumsum(touched)[:-1] > 0).sum() < coverage * len(test):
            continue  # even with all seeds it would not do
        laid = tiles(words, test, width, doc_at, item_at)
        covered = sum(n for _, _, n in laid)
        if covered >= coverage * len(test):
            out.append((items.ids[item], len(test), covered, len(laid)))
    return out


def blocks(benchmark: DataFrame, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> Iterator:
    """The benchmark in broadcast blocks of about ``block_bytes`` each, whatever its size;
    every block meets all documents."""
    tests = benchmark.select("item_id", "text").where(F.octet_length("text") > 0)
    total = tests.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    many = -(-total // block_bytes)
    for block in range(many):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == block).collect()
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in rows], seed))


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **how) -> DataFrame:
    """A row for every document and test item that it covers: the whole list, one pass over
    the documents per block of the benchmark and no shuffle."""
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {kind}, n_tokens int, n_covered int, n_tiles int, coverage double"
    lean = docs.select("doc_id", "text")
    found = None
    for block in blocks(benchmark, **how):
        def judge(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                        for hit in judged(block.value, hashes, text, coverage)]
                if rows:
                    doc, item, n, covered, laid = zip(*rows)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(doc, batch.schema.field("doc_id").type), "item_id": list(item),
                        "n_tokens": pa.array(n, pa.int32()), "n_covered": pa.array(covered, pa.int32()),
                        "n_tiles": pa.array(laid, pa.int32()),
                        "coverage": pa.array([c / t for c, t in zip(covered, n)], pa.float64())})

        part = lean.mapInArrow(judge, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **how) -> DataFrame:
    """The documents that cover no test item, with all their columns."""
    for block in blocks(benchmark, **how):
        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                yield batch.filter(pa.array(
                    [not judged(block.value, hashes, t, coverage) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
