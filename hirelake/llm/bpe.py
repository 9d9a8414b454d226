"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of many texts are parted by character classes, equal words are encoded once, and
the symbols of all different words lie in one flat array. A round looks up the ranks of
changed neighbours by binary search over the sorted pair keys, takes the lowest rank of every
word and merges all its places from left to right; a word that has no known pair is done.
That equals one merge at a time, since a pair that holds a merged symbol ranks after the merge
that makes it; a vocabulary where this does not hold is refused.

Texts are encoded whole. Long ones are cut only where a word ends before white space, so memory
is bounded by ``BLOCK`` characters and the longest word, besides the text itself. Strings of
added tokens in a text become their ids, as without ``encode_special_tokens``. A null text is
empty and has no ids. Rows that repeat are encoded alike, an empty table gives no rows, and
only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from hirelake.llm.words import mix64

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK = 2_000_000  # characters encoded together
SHORT = 15  # bytes of a word that fit two numbers together with its length
NEVER = np.int64(1 << 40)  # rank of a pair that is not merged

SPACE, LETTER, NUMBER, OTHER = range(4)
# Endings that are words of their own after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

# A word always ends before white space. Python's white space holds all of the vocabulary's.
_CUT = re.compile(r"(?<=\S)[ \n]")


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the file: printable ones of Latin-1 for
    themselves, the others numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def character_kinds() -> np.ndarray:
    """The class of every code point. Points that Python's Unicode does not know yet are asked
    of the tokenizers' own splitter, whose version may lie between Python's and ``regex``'s."""
    points = "".join(map(chr, range(0xD800))) + "\ud800" * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    kinds = np.full(len(points), OTHER, np.uint8)
    for kind, name in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(name, points):
            kinds[found.start():found.end()] = kind
    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for point in np.flatnonzero((kinds == LETTER) | (kinds == NUMBER)).tolist():
        if unicodedata.category(chr(point)) == "Cn":
            places = {at[0] for _, at in splitter.pre_tokenize_str(f"a{chr(point)}1{chr(point)}")}
            kinds[point] = LETTER if 1 not in places else NUMBER if 2 not in places else OTHER
    return kinds


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the stretches, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """Tables made from a tokenizer file. It is read on the driver and broadcast; its size is
    that of the vocabulary and of the code points, whatever the corpus."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        plain = (model["type"] == "BPE" and splitter["type"] == "ByteLevel" and splitter["use_regex"]
                 and not splitter["add_prefix_space"] and not spec["normalizer"]
                 and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix",
                                                    "end_of_word_suffix", "byte_fallback", "ignore_merges"))
                 and not any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip", "normalized")))
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        number, byte = model["vocab"], byte_characters()
        tokens = {k: bytes(byte[c] for c in token) for token, k in number.items()}
        for t in added:
            known = all(c in byte for c in t["content"])
            tokens[t["id"]] = bytes(byte[c] for c in t["content"]) if known else t["content"].encode()
        self.added = {t["content"]: t["id"] for t in added}
        self.single = np.array([number[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])], np.int64)
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        for k, token in tokens.items():
            self.sizes[k] = len(token)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.text = np.frombuffer(b"".join(tokens.get(k, b"") for k in range(len(self.sizes))), np.uint8)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([number[x] for x in side], np.int64) for side in
                             ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        birth = np.full(len(self.sizes), -1, np.int64)
        birth[made] = np.arange(len(made))
        if len(set(made.tolist())) < len(made) or (np.maximum(birth[left], birth[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path} has merges out of order")
        keys = self.keys_of(left, right)
        self.rank = np.argsort(keys)
        self.keys, self.made = keys[self.rank], made
        self.kinds = character_kinds()

    @staticmethod
    def keys_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left << np.int64(32)) | right

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, by binary search over the sorted keys."""
        asked = self.keys_of(left, right)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.rank[at], NEVER)

    # ---- words of texts ------------------------------------------------------------

    def words(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where words start in texts laid one after the other; ``begins``: first point of each text."""
        kinds = self.kinds[points]
        first = np.zeros(len(points) + 1, bool)
        first[begins] = first[-1] = True
        start = first[:-1].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        # The last of several blanks goes apart from the others, and a plain one with the word after it.
        inside = ~first[1:-1]
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & inside)
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        # An apostrophe that starts a word takes one of the endings and leaves the other letters.
        quote = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kinds[1:] == LETTER) & inside)
        padded = np.concatenate([points, [0, 0]])
        for ending in ENDINGS:
            size = len(ending)
            fits = (padded[quote + 1] == ord(ending[0])) & (
                True if size == 1 else (padded[quote + 2] == ord(ending[1])) & ~first[np.minimum(quote + 2, len(points))])
            taken = quote[fits]
            start[taken + 1] = False
            after = taken + 1 + size
            start[after[after < len(points)]] = True
        return np.flatnonzero(start)

    # ---- merges --------------------------------------------------------------------

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words given as the ids of their bytes, and how many each word has."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names, sizes, ids = np.arange(len(lengths)), lengths.copy(), symbols
        rank = np.full(len(ids), NEVER)
        rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[np.cumsum(sizes) - 1] = NEVER
        while len(ids):
            best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            live = best < NEVER
            if not live.all():
                on = np.repeat(live, sizes)
                done.append((names[~live], sizes[~live], ids[~on]))
                names, sizes, best, ids, rank = names[live], sizes[live], best[live], ids[on], rank[on]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            # Places that overlap (aaa) are taken from the left, every other one.
            opens = np.concatenate([[True], np.diff(hits) != 1])
            nth = np.arange(len(hits))
            hits = hits[(nth - np.maximum.accumulate(np.where(opens, nth, 0))) % 2 == 0]
            ids[hits] = self.made[rank[hits]]
            stays = np.ones(len(ids), bool)
            stays[hits + 1] = False
            # A merged symbol is the last of its word if the one it took was; else it is looked up.
            rank[hits] = rank[hits + 1]
            word = np.repeat(np.arange(len(sizes)), sizes)
            sizes = sizes - np.bincount(word[hits], minlength=len(sizes))
            at = (np.cumsum(stays) - 1)[hits]
            ids, rank = ids[stays], rank[stays]
            starts = np.zeros(len(ids) + 1, bool)
            starts[np.cumsum(sizes)] = True
            starts[0] = True
            changed = np.concatenate([at, at[~starts[at]] - 1])
            inner = changed[~starts[changed + 1]]
            rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        counts = np.zeros(len(lengths), np.int64)
        for who, size, _ in done:
            counts[who] = size
        out, begin = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for who, size, some in done:
            out[spans(begin[who], size)] = some
        return out, counts

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after the other, and the number of each. Texts hold no added tokens."""
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        chars = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(chars) - chars
        starts = self.words(points, begins[chars > 0])
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        raw = joined.encode()
        at = offset[starts]
        size = np.diff(np.append(at, len(raw)))
        which, kind = different(raw, at, size)
        flat = self.single[np.frombuffer(raw, np.uint8)[spans(at[which], size[which])]]
        ids, counts = self.merged(flat, size[which])
        first = np.cumsum(counts) - counts
        of_word = counts[kind]
        per_text = np.bincount(np.searchsorted(begins + chars, starts, side="right"), of_word, len(texts))
        return ids[spans(first[kind], of_word)], per_text.astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text."""
        added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, int, str]] = []
        held = 0

        def flush() -> None:
            ids, counts = self.block([part for _, _, part in waiting])
            for (row, place, _), some in zip(waiting, np.split(ids, np.cumsum(counts)[:-1])):
                out[row][place] = some
            waiting.clear()

        for row, text in enumerate(texts):
            parts = added.split(text) if text and added and any(x in text for x in self.added) else [text or ""]
            for k, part in enumerate(parts):
                if k % 2:
                    out[row].append(np.array([self.added[part]], np.int32))
                    continue
                for piece in pieces(part):
                    waiting.append((row, len(out[row]), piece))
                    out[row].append(None)
                    held += len(piece)
                    if held >= BLOCK:
                        flush()
                        held = 0
        if waiting:
            flush()
        return [some[0] if len(some) == 1 else np.concatenate(some) for some in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of some ids; those that the vocabulary does not know say nothing."""
        known = ids[(ids >= 0) & (ids < len(self.sizes))]
        return self.text[spans(self.places[known], self.sizes[known])].tobytes()


def pieces(text: str) -> Iterator[str]:
    """A text cut where a word ends before white space, about every ``BLOCK`` characters."""
    begin = 0
    while len(text) - begin > BLOCK:
        found = _CUT.search(text, begin + BLOCK)
        if not found:
            break
        yield text[begin:found.start()]
        begin = found.start()
    yield text[begin:]


def different(raw: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different word, and for every word which of them it is. A short word
    and its length are packed into two numbers, so equal numbers are equal words; long words
    stand for themselves."""
    numbers = np.frombuffer(raw + bytes(24 - len(raw) % 8), "<u8")
    short = np.flatnonzero(size <= SHORT)
    byte, shift = at[short] >> 3, ((at[short] & 7) << 3).astype(np.uint64)
    carry = np.where(shift > 0, np.uint64(64) - shift, np.uint64(0))

    def eight(k: int) -> np.ndarray:
        low, high = numbers[np.minimum(byte + k, len(numbers) - 1)], numbers[np.minimum(byte + k + 1, len(numbers) - 1)]
        return np.where(shift > 0, (low >> shift) | (high << carry), low)

    def lowest(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        bits = (np.clip(n, 0, 8) << 3).astype(np.uint64)
        return np.where(bits == 64, x, x & ((np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1)))

    low, high = lowest(eight(0), size[short]), lowest(eight(1), size[short] - 8) | (size[short].astype(np.uint64) << np.uint64(56))
    codes, kinds = pd.factorize(mix64(low) ^ mix64(high + np.uint64(1)))
    first = np.empty(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(short))[::-1]
    if not ((low[first[codes]] == low) & (high[first[codes]] == high)).all():  # mixed numbers met by chance
        _, first, codes = np.unique(np.stack([low, high], 1), axis=0, return_index=True, return_inverse=True)
        codes = codes.ravel()
    long = np.flatnonzero(size > SHORT)
    kind = np.empty(len(at), np.int64)
    kind[short], kind[long] = codes, len(first) + np.arange(len(long))
    return np.concatenate([short[first], long]), kind


def encode(docs: DataFrame, path: str = VOCABULARY, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id`` and ``ids``: the token ids of every whole text, in order."""
    rows = docs.select(row_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate([np.empty(0, np.int32), *found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], [row_id, "ids"])

    return rows.mapInArrow(run, f"`{row_id}` {dict(rows.dtypes)[row_id]}, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY, row_id: str = "doc_id") -> DataFrame:
    """``row_id``, ``ids`` and ``decoded``: the text that the ids spell. Bytes that are no
    UTF-8 become replacement characters, null ids and null lists spell nothing."""
    rows = encoded.select(row_id, "ids")
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                some = np.empty(0, np.int32) if not ids.is_valid else ids.values.drop_null().to_numpy()
                texts.append(shared.value.decode(some).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [row_id, "ids", "decoded"])

    return rows.mapInArrow(run, f"`{row_id}` {dict(rows.dtypes)[row_id]}, ids array<int>, decoded string")
