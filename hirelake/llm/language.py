"""Language by rank-order profiles: out-of-place distance between lists of frequent n-grams.

A language's profile is its ``TOP`` most frequent letter 1- to 3-grams over all training
texts; a document's is made alike from its whole text. Words are padded with one blank.
The distance adds up how far each n-gram of the document is out of place, ``TOP`` for one
that the profile lacks. Ties in frequency go to the smaller n-gram, ties in distance to
the smaller language code. Null texts and texts without a letter give ``und`` and 0, as
does a corpus that has no training text. Null languages are not learned. Repeated rows
count and predict like others; columns other than those named are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

TOP = 400
BLANK = 32
HELD = 4_000_000  # n-grams that a task gathers before it hands them on
CHUNK = 8_000_000  # letters looked at together


def letter_table() -> np.ndarray:
    """For code points below 2**16: the lower-case letter, or a blank."""
    out = np.full(1 << 16, BLANK, np.uint16)
    for point in range(1 << 16):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            out[point] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else point
    return out


class Grams:
    """Counts the n-grams of many texts at once: ``(text, gram, count)`` in order."""

    def __init__(self) -> None:
        self.letters = letter_table()

    def codes(self, text: str | None) -> np.ndarray:
        points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        if len(points) and points.max() >= 1 << 16:
            # Letters beyond the first plane keep their low bits, which tells scripts apart.
            kinds, at = np.unique(points, return_inverse=True)
            out = np.array([self.letters[p] if p < 1 << 16 else p & 0x7FFF | 0x8000 if chr(p).isalpha() else BLANK
                            for p in kinds.tolist()], np.uint16)[at]
        else:
            out = self.letters[points]
        blank = out == BLANK
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # one blank after each word
        return out[keep]

    def count(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In groups of texts of bounded length; a single longer text is a group of its own."""
        group, first, size = [], 0, 0
        for i, text in enumerate(texts):
            n = len(text or "")
            if group and (size + n > CHUNK or len(group) >= 30_000):
                yield self._count(group, first)
                group, first, size = [], i, 0
            group.append(text)
            size += n
        if group:
            yield self._count(group, first)

    def _count(self, texts: list[str | None], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = [self.codes(t) for t in texts]
        lengths = [len(e) + 2 for e in each]
        ends = np.array([BLANK], np.uint16)
        joined = np.concatenate([x for e in each for x in (ends, e, ends)]).astype(np.uint64)
        doc = np.repeat(np.arange(len(each), dtype=np.uint64), lengths) << np.uint64(48)
        grams = []
        letter = joined != BLANK
        grams.append((doc | joined)[letter])
        two = (doc[1:] | joined[:-1] << np.uint64(16) | joined[1:])[(letter[1:] | letter[:-1]) & (doc[1:] == doc[:-1])]
        grams.append(two)
        # A 3-gram has a letter in its middle: it lies in one word, blanks at its ends allowed.
        three = (doc[2:] | joined[:-2] << np.uint64(32) | joined[1:-1] << np.uint64(16) | joined[2:])[
            letter[1:-1] & (doc[2:] == doc[:-2])]
        grams.append(three)
        every = np.concatenate(grams)
        every.sort()
        if not len(every):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        counts = np.diff(np.append(starts, len(every)))
        kinds = every[starts]
        return ((kinds >> np.uint64(48)).astype(np.int64) + first,
                (kinds & np.uint64((1 << 48) - 1)).astype(np.int64), counts)


def learn(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang``, ``gram``, ``place`` (from 0): the profile of every language of ``docs``.
    Counts are gathered within tasks; what is shuffled are distinct n-grams per task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, parts = Grams(), 0, {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, pieces in parts.items():
                g, n = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
                kinds, place = np.unique(g, return_inverse=True)
                total = np.bincount(place, n, len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(kinds), pa.string()), pa.array(kinds), pa.array(total)], ["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for doc, gram, n in grams.count(batch.column("text").to_pylist()):
                spoken = langs[doc]
                for lang in set(langs):
                    mine = spoken == lang
                    kinds, place = np.unique(gram[mine], return_inverse=True)
                    if len(kinds):
                        parts.setdefault(lang, []).append((kinds, np.bincount(place, n[mine], len(kinds))))
                        held += len(kinds)
                if held > HELD:
                    yield from handed_on()
                    held, parts = 0, {}
        yield from handed_on()

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    totals = known.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < top).drop("n")


class Profiles:
    """Profiles laid out to compare many documents at once. They hold ``top`` n-grams for
    each language code, however large the corpus is."""

    def __init__(self, rows: list, top: int = TOP) -> None:
        self.top = top
        self.langs = sorted({r.lang for r in rows})
        self.grams = np.array(sorted({r.gram for r in rows}), np.int64)
        at = {g: i for i, g in enumerate(self.grams.tolist())}
        self.places = np.full((len(self.langs), len(self.grams) + 1), -1, np.int32)
        for r in rows:
            self.places[self.langs.index(r.lang), at[r.gram]] = r.place

    def predict(self, grams: Grams, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Language code and score of every text; the score is 1 less the distance's share
        of the largest one possible."""
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        for doc, gram, n in grams.count(texts):
            if not len(doc):
                continue
            order = np.lexsort((-n, doc))  # stable: ties stay in order of the n-gram
            doc, gram = doc[order], gram[order]
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            place = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
            mine = place < self.top
            doc, gram, place = doc[mine], gram[mine], place[mine]
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            at[self.grams[at] != gram] = len(self.grams)
            far = []
            for places in self.places:
                theirs = places[at]
                far.append(np.add.reduceat(np.where(theirs < 0, self.top, np.abs(theirs - place)), starts))
            far = np.stack(far)
            best, which = far.argmin(0), doc[starts]
            sizes = np.diff(np.append(starts, len(doc)))
            lang[which] = np.array(self.langs, object)[best]
            score[which] = 1 - far.min(0) / (sizes * self.top)
        return lang, score


def fitted(docs: DataFrame, top: int = TOP) -> Profiles:
    return Profiles(learn(docs, top).collect(), top)


def with_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names give way."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = docs.drop("lang_pred", "score")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            lang, score = shared.value.predict(grams, batch.column("text").to_pylist())
            slim = batch.drop_columns(["text"]) if "_thin" in batch.schema.names else batch
            yield slim.append_column("lang_pred", pa.array(lang, pa.string())).append_column("score", pa.array(score, pa.float64()))

    fields = [f for f in kept.schema.fields if not ("_thin" in kept.columns and f.name == "text")]
    schema = type(kept.schema)(fields).add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(predicted, schema)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether the CRC of the id as text falls into the held-out fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    profiles = fitted(docs.where(~held_out()), top)
    lean = docs.select("doc_id", held_out().alias("held_out"), "text", F.lit(True).alias("_thin"))
    return with_language(lean, profiles).drop("_thin")
