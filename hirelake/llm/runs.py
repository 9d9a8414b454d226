"""Periodic runs of words by internal pattern matching.

The words of a batch of texts are numbered per text, and prefix doubling gives for every power
of two the class of the stretch of that length at every place, and at the end the suffix array.
Every dyadic block of ``b`` words asks where it occurs again in the neighbouring window, from
``2b - 1`` to ``4b - 2`` words on: a range-successor query of a wavelet tree over the suffix
array, within the range of the suffixes that begin with the block. A run with period ``q`` in
that range holds an aligned block and its copy ``q`` words on, so no run is missed. Occurrences
that overlap by half form a progression, which one longest common extension gives as a whole.
The distances are the candidate periods; each is extended to both sides by the classes,
and among equal stretches the smallest period stays.

A run is a stretch of words with smallest period ``q`` and at least ``max(least, 2 * q)`` words
that no neighbouring word extends. Words are compared byte by byte. A null, empty or blank text
has no words and no runs. Rows that repeat give the same rows again, an empty table none. Only
the id and the text are read. A text is worked on whole; memory grows with the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12  # words of the shortest run
TOGETHER = 150_000  # words of texts that are worked on together
# The lowest level covers periods of 1 to 14 with blocks of four words, three words apart: a run
# of 12 words and period 6 repeats six words, which hold one of them.
LOWEST, APART, NEAREST, FURTHEST = 4, 3, 1, 14


class WaveletTree:
    """Bits of a sequence of numbers, from the highest down, with counts of zeros before."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max()).bit_length())
        self.zeros, self.split = [], []
        for bit in reversed(range(self.bits)):
            ones = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in each range are under the bound (which fits the bits)."""
        count = np.zeros(len(low), np.int64)
        for level, bit in enumerate(reversed(range(self.bits))):
            zeros, up = self.zeros[level], (bound >> bit) & 1 == 1
            left, right = zeros[low], zeros[high]
            count += np.where(up, right - left, 0)
            low = np.where(up, low - left + self.split[level], left)
            high = np.where(up, high - right + self.split[level], right)
        return count

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value of each range, from 0; n is less than the range."""
        value = np.zeros(len(low), np.int64)
        for level, bit in enumerate(reversed(range(self.bits))):
            zeros = self.zeros[level]
            left, right = zeros[low], zeros[high]
            up = n >= right - left
            n = np.where(up, n - (right - left), n)
            value |= up.astype(np.int64) << bit
            low = np.where(up, low - left + self.split[level], left)
            high = np.where(up, high - right + self.split[level], right)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of each range that is not under the bound, or -1."""
        out = np.full(len(low), -1, np.int64)
        some = np.flatnonzero(bound < 1 << self.bits)
        n = self.below(low[some], high[some], bound[some])
        fits = n < high[some] - low[some]
        some, n = some[fits], n[fits]
        out[some] = self.nth(low[some], high[some], n)
        return out


class Stretches:
    """Classes of all stretches of 1, 2, 4, … symbols, and the suffix array.

    The class of a stretch is the place of its first suffix in the suffix array. The text ends
    with symbols that occur once, so no class of two places reaches over a text's end."""

    def __init__(self, symbols: np.ndarray, deepest: int = 64) -> None:
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        sorted_ = symbols[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.classes, width = [rank], 1
        while len(self.classes) <= deepest:
            rank = self.classes[-1]
            size = np.bincount(rank, minlength=n)
            open_ = np.flatnonzero(size[rank[order]] > 1)  # places of the suffix array not yet told apart
            if not len(open_):
                break
            suffix = order[open_]
            group, follow = rank[suffix], rank[suffix + width]
            inner = np.lexsort((follow, group))
            suffix, group, follow = suffix[inner], group[inner], follow[inner]
            order[open_] = suffix
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
            finer = rank.copy()
            finer[suffix] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            self.classes.append(finer)
            width *= 2
        self.order = order

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from both places on."""
        length = np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.classes))):
            rank = self.classes[level]
            length += (rank[i + length] == rank[j + length]).astype(np.int64) << level
        return length

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends just before both places."""
        length = np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.classes))):
            rank, width = self.classes[level], 1 << level
            a, b = i - length - width, j - length - width
            same = (a >= 0) & (b >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
            length += same.astype(np.int64) << level
        return length


def candidates(text: Stretches, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which a block occurs again. ``places``: where the texts start."""
    n, tree = len(text.order), None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    inside = np.arange(n) - np.repeat(places, np.diff(np.append(places, n)))  # place within its text
    for level in range(LOWEST.bit_length() - 1, len(text.classes)):
        block = 1 << level
        rank = text.classes[level]
        size = np.bincount(rank, minlength=n)
        repeats = np.flatnonzero(size[rank] > 1)
        if not len(repeats):
            break  # longer blocks do not occur twice either
        if tree is None:
            tree = WaveletTree(text.order)
        lowest = block == LOWEST
        p = repeats[inside[repeats] % (APART if lowest else block) == 0]
        near, far = (NEAREST, FURTHEST) if lowest else (2 * block - 1, 4 * block - 2)
        low = rank[p].astype(np.int64)
        high, x, end = low + size[low], p + near, p + far
        while len(p):
            y = tree.successor(low, high, x)
            hit = (y >= 0) & (y <= end)
            p, low, high, end, y = p[hit], low[hit], high[hit], end[hit], y[hit]
            found.append((p, y - p))
            z = tree.successor(low, high, y + 1)
            hit = (z >= 0) & (z <= end)
            p, low, high, end, y, z = p[hit], low[hit], high[hit], end[hit], y[hit], z[hit]
            found.append((p, z - p))
            step = z - y
            x = z + 1
            chain = np.flatnonzero(2 * step <= block)
            if len(chain):
                # All copies within the periodic stretch of y and z, at once.
                a, b, d = y[chain], z[chain], step[chain]
                last = np.minimum(b + text.ahead(a, b) - block, end[chain])
                # A block in the same periodic stretch has no further period but multiples of the step.
                apart = p[chain] + text.ahead(p[chain], p[chain] + d) + d < b
                more = np.where(apart | lowest, np.maximum(0, (last - b) // d), 0)
                at = np.repeat(np.arange(len(chain)), more)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + 1
                found.append((p[chain][at], b[at] + nth * d[at] - p[chain][at]))
                x[chain] = np.maximum(x[chain], last + 1)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def runs_of(symbols: np.ndarray, places: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in texts laid one after the other, each with an
    end symbol of its own and no symbol of another text; in order of start and period."""
    text = Stretches(symbols)
    at, period = candidates(text, places)
    if len(at):
        start = at - text.back(at, at + period)
        length = at + period + text.ahead(at, at + period) - start
        fits = length >= np.maximum(least, 2 * period)
        start, length, period = start[fits], length[fits], period[fits]
    else:
        start = length = period = at
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # the smallest period of each stretch
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_in(texts: list[list[bytes]], least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of each text, given as its words."""
    nothing = np.empty(0, np.int64)
    out = [(nothing, nothing, nothing)] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    long = np.flatnonzero(sizes >= least)
    if not len(long):
        return out
    # Objects, not fixed-width bytes: a zero byte at a word's end counts.
    flat = np.empty(int(sizes[long].sum()), object)
    flat[:] = [w for k in long for w in texts[k]]
    number = pd.factorize(flat)[0].astype(np.int64)
    kinds = int(number.max()) + 2
    place = np.cumsum(sizes[long] + 1) - (sizes[long] + 1)
    symbols = np.repeat(np.arange(len(long)) * kinds, sizes[long] + 1)
    words = np.ones(len(symbols), bool)
    words[place + sizes[long]] = False  # the end symbol is the smallest of each text
    symbols[words] += number + 1
    # Texts where no four words in a row come twice have no run.
    classes = Stretches(symbols, deepest=2).classes
    four = classes[2] if len(classes) > 2 else np.arange(len(symbols))
    twice = np.add.reduceat(np.bincount(four, minlength=len(four))[four] > 1, place) > 0
    if not twice.any():
        return out
    kept = np.repeat(twice, sizes[long] + 1)
    long, symbols = long[twice], symbols[kept]
    place = np.cumsum(sizes[long] + 1) - (sizes[long] + 1)
    start, length, period = runs_of(symbols, place, least)
    cuts = np.searchsorted(start, place[1:])
    for k, begin, a, b, c in zip(long, place, np.split(start, cuts), np.split(length, cuts), np.split(period, cuts)):
        out[k] = (a - begin, b, c)
    return out



def kept(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find_runs(docs: DataFrame, least: int = LEAST, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id``, ``runs`` (start, length and period in words, by start and period) and
    ``collapsed``: the text's words without those that a run repeats, one space between them."""
    rows = docs.select(row_id, text)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, collapsed, begin = [], [], 0
            texts = [t.encode().split() if t else [] for t in batch.column(1).to_pylist()]
            while begin < len(texts):
                end, words = begin + 1, len(texts[begin])
                while end < len(texts) and words + len(texts[end]) <= TOGETHER:
                    words += len(texts[end])
                    end += 1
                found.extend(runs_in(texts[begin:end], least))
                begin = end
            for words, some in zip(texts, found):
                collapsed.append(b" ".join(kept(words, *some) if len(some[0]) else words).decode())
            ends = pa.array(np.cumsum([0, *(len(s[0]) for s in found)]), pa.int32())
            columns = [pa.array(np.concatenate([np.empty(0, np.int64), *(s[k] for s in found)])) for k in range(3)]
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(collapsed, pa.string())], [row_id, "runs", "collapsed"])

    kind = dict(rows.dtypes)[row_id]
    return rows.mapInArrow(run, f"`{row_id}` {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
