"""Many phrases found in many texts by one walk over the words.

The phrases form a trie over words. Its edges are one sorted array of ``node * words + word``, so
all words of an Arrow batch take a step at once by binary search. Every word is a possible start,
and most leave the walk at the first step. A text gives its distinct hits, not its word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hirelake.session import materialize

#: Bytes of phrases and answers in one broadcast part of a dictionary.
PART_BYTES = 16_000_000


class Trie:
    """Phrases of words with the answers that each one gives."""

    def __init__(self, entries: list[tuple[str, str]], longest: int) -> None:
        self.words: dict[str, int] = {}
        nodes: dict[tuple[int, int], int] = {}
        answers: dict[int, list[int]] = {}
        self.answers = sorted({answer for _, answer in entries})
        place = {answer: i for i, answer in enumerate(self.answers)}
        self.depth = 0
        for phrase, answer in entries:
            parts = phrase.split(" ")
            if len(parts) > longest:
                continue
            self.depth, node = max(self.depth, len(parts)), 0
            for part in parts:
                step = node, self.words.setdefault(part, len(self.words))
                node = nodes.setdefault(step, len(nodes) + 1)
            answers.setdefault(node, []).append(place[answer])
        self.size = len(nodes) + 1
        edges = np.array([node * len(self.words) + word for node, word in nodes], np.int64)
        order = np.argsort(edges)
        self.edges = edges[order]
        self.targets = np.array(list(nodes.values()), np.int64)[order]
        counts = np.zeros(self.size + 1, np.int64)
        for node, found in answers.items():
            counts[node + 1] = len(found)
        self.starts = np.cumsum(counts)
        self.flat = np.array([a for node in sorted(answers) for a in answers[node]], np.int64)

    def hits(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``(row, answer)`` of a batch of word lists."""
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        if not len(self.edges) or not len(flat):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = flat.dictionary_encode()
        known = np.array([self.words.get(w, -1) for w in kinds.dictionary.to_pylist()], np.int64)
        codes = known[kinds.indices.to_numpy()]
        rows, ends = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.cumsum(lengths), lengths)
        at = np.flatnonzero(codes >= 0)
        node, first = np.zeros(len(at), np.int64), at
        found_rows, found = [], []
        for _ in range(self.depth):
            wanted = node * len(self.words) + codes[at]
            edge = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            on = self.edges[edge] == wanted
            node, first, at = self.targets[edge[on]], first[on], at[on]
            n = self.starts[node + 1] - self.starts[node]
            offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(self.flat[np.repeat(self.starts[node], n) + offsets])
            found_rows.append(np.repeat(rows[first], n))
            on = at + 1 < ends[first]
            node, first, at = node[on], first[on], at[on] + 1
            on = codes[at] >= 0
            node, first, at = node[on], first[on], at[on]
        pairs = np.unique(np.concatenate(found_rows) * len(self.answers) + np.concatenate(found))
        return np.divmod(pairs, len(self.answers))


def mentions(words: DataFrame, dictionary: DataFrame, row_id: str, column: str, phrase: str, answer: str,
             longest: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """``row_id, answer`` for each phrase among the words of a row, distinct within the row.

    The dictionary goes round in broadcast parts of at most about ``part_bytes``, cut by a hash of
    the phrase, and each part costs one pass over the words. Phrases of more than ``longest`` words,
    null phrases and null answers are not looked for.
    """
    entries = materialize(dictionary.where(F.col(phrase).isNotNull() & F.col(answer).isNotNull()).select(phrase, answer).distinct(),
                          "dictionary")
    size = entries.agg(F.sum(F.octet_length(phrase) + F.octet_length(answer) + 64)).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    found = None
    for part in range(parts):
        of_part = F.pmod(F.xxhash64(phrase), F.lit(parts)) == part
        hits = _part(words, entries.where(of_part), row_id, column, answer, longest)
        found = hits if found is None else found.unionByName(hits)
    return found


def _part(words: DataFrame, entries: DataFrame, row_id: str, column: str, answer: str, longest: int) -> DataFrame:
    # The tables of the trie travel, not its class: executors get that with the task.
    shared = words.sparkSession.sparkContext.broadcast(vars(Trie([tuple(r) for r in entries.collect()], longest)))
    kind = dict(words.dtypes)[row_id]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.__new__(Trie)
        vars(trie).update(shared.value)
        names = pa.array(trie.answers, pa.string())
        for batch in batches:
            rows, found = trie.hits(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), names.take(pa.array(found))], [row_id, answer])

    return words.select(row_id, column).mapInArrow(find, f"`{row_id}` {kind}, `{answer}` string")
