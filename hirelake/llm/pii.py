"""Personal data in whole texts, disguised or not, as spans of the original.

Plain identifiers are found first. Then small transducers rewrite the text and remember
which source characters each new character stands for: invisible characters go, look-alike
letters, other scripts' digits and character references become ASCII, spelled numbers below a
hundred and ``double`` or ``triple`` digits become digits, and ``at`` and ``dot`` written as
words, in brackets or between hyphens or underscores become signs. A spelled digit counts where
it stands beside another one, a
written digit or a dot; whether prose or a number is meant there, the text does not tell, so
it has several readings (only runs of three or more; all of them; all of them, joined to the
written digits beside them). What the same detectors find in any reading is mapped back to
source characters; it is added if its source differs from what was found. Plain spans always
stay.

An ``at`` without brackets is a sign before a name with a disguised dot, or before a plain name
with a known ending, if what stands before it is not a word that prose puts there.

A null text counts as empty and has no spans. Ties in a start are ordered by kind, then by
end. Repeated rows and null ids are rows like others; other columns are not read. Texts
without a trace of a disguise skip the transducers, which does not change their result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Kinds in their order, and the shapes of identifiers.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like ASCII ones, pair by pair.
LOOK_ALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјкорсухԁԛԝһ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορικ",
    "ABESIJKMHOPCTYXaesijkopcyxdqwh" "ABEZHIKMNOPTYXavopik")) | dict.fromkeys("‐‑‒–—−", "-")
INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
# Digits as words.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
           "seven": "7", "eight": "8", "nine": "9"}
TEENS = {"ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15",
         "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19"}
TENS = {"twenty": "2", "thirty": "3", "forty": "4", "fifty": "5", "sixty": "6", "seventy": "7", "eighty": "8", "ninety": "9"}
TIMES = {"double": 2, "triple": 3}
# Endings of names, and words that stand before a plain "at" in prose.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz io co ai app dev me tv uk de fr it es pt nl eu ch at be se no fi dk pl cz ie ru ua "
    "jp cn kr in br us ca au nz mx za example test".split())
NOT_NAMES = frozenset(
    "a about all also am and answers app are arrive arrived article as at available based be been blog bought but buy call "
    "came check code come contact details docs email event everyone find follow for found from go guide had has have he help "
    "held her here him hosted i in information is it items job join learn learned listed live located login look looked "
    "looking me meet meeting met more not now of on one online open or order out page people photos play posted published "
    "read register released reservations s see seen she shop sign site sold start store stories study talk team that the "
    "them then there they this those tickets time to today up us user version video visit was we website were what work "
    "worked working works write writes you your".split())

_STRANGE = re.compile(
    "[\u00a0\u00ad\u0370-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2000-\u200d\u2010-\u2014\u2024\u202f"
    "\u2060\u2212\u24b6-\u24e9\ufe52\ufe6b\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_", "hyphen": "-", "nbsp": " "}
_REFERENCE = re.compile(rf"&(?:#0{{0,5}}([0-9]{{2,3}})|#x0{{0,4}}([0-9a-f]{{2}})|({'|'.join(_NAMED)}));", re.I)
_DIGIT = "(?:" + "|".join(SPELLED) + ")"
_WORD = (rf"(?:{'|'.join(TEENS)}|(?:{'|'.join(TENS)})(?:[\s-]{_DIGIT}(?![A-Za-z]))?"
         rf"|(?:(?:{'|'.join(TIMES)})[\s-])?{_DIGIT})")
_RUN = re.compile(rf"(?<![A-Za-z]){_WORD}(?:[\s,-]{{1,3}}{_WORD}){{2,}}(?![A-Za-z])", re.I)
_ONE = re.compile(_WORD, re.I)
_SOME = rf"(?P<run>(?<![A-Za-z]){_WORD}(?:[\s,-]{{1,3}}{_WORD})*)(?![A-Za-z])"
_SPACED = re.compile(_SOME, re.I)
_JOINED = re.compile(rf"(?:(?<=[0-9])[\s,-]{{1,3}})?{_SOME}(?:[\s,-]{{1,3}}(?=[0-9]))?", re.I)
_BEFORE = re.compile(r"(?:[0-9][\s,().-]{0,3}|\.)\Z")
_AFTER = re.compile(r"[\s,().-]{0,3}[0-9]|\.")
_PLUS = re.compile(r"(?<![A-Za-z])plus\s+(?=\+?[0-9])", re.I)
_BRACKETS = re.compile(r"\s*(?:\(\s*(at|@|dot|\.)\s*\)|\[\s*(at|@|dot|\.)\s*\]|\{\s*(at|@|dot|\.)\s*\}|<\s*(at|dot)\s*>)\s*", re.I)
_DOTTED = re.compile(r"(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.I)
_RAILED = re.compile(r"(?<=[A-Za-z0-9])\s*([_-])dot\1\s*(?=[A-Za-z0-9])", re.I)
_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:\s+at\s+|\s*([_-])at\1\s*)(?=[A-Za-z0-9-])", re.I)
_HINT = re.compile(
    rf"[(\[{{<]\s*(?:at|@|dot|\.)\s*[)\]}}>]|\sdot\s|(?<![A-Za-z])plus\s+\+?[0-9]|[_-]dot[_-]|{_REFERENCE.pattern}"
    rf"|(?:\s|[_-])at(?:\s+|[_-]\s*)[A-Za-z0-9-]+\.[A-Za-z0-9-]"
    rf"|(?<![A-Za-z]){_WORD}(?:[\s,-]{{1,3}}{_WORD}(?![A-Za-z])|\.{_WORD}(?![A-Za-z])|[\s,().-]{{0,3}}[0-9])"
    rf"|[0-9][\s,().-]{{0,3}}{_WORD}(?![A-Za-z])", re.I)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def local_before(text: str, end: int) -> str:
    start = end
    while start and text[start - 1] in LOCAL:
        start -= 1
    return text[start:end]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their signs: a run of local characters, the sign, a domain."""
    end, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, sign + 1) if start < sign else None
        if found:
            end = found.end()
            yield start, end
        sign = text.find("@", end if found else sign + 1)


def plain(text: str) -> list[Span]:
    """Identifiers of a text as it stands, by start and kind."""
    out = [("email", *span) for span in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub("[^0-9]", "", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Rewritten:
    """A text with, for every character, the source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def apply(self, pattern: re.Pattern, by: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replace matches; ``by`` gives new characters with their places in the old text."""
        pieces, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            pieces.append(self.text[last:m.start()])
            starts += self.starts[last:m.start()]
            ends += self.ends[last:m.start()]
            for char, first, end in by(m):
                pieces.append(char)
                starts.append(self.starts[first])
                ends.append(self.ends[end - 1])
            last = m.end()
        if last:
            self.text = "".join(pieces) + self.text[last:]
            self.starts, self.ends = starts + self.starts[last:], ends + self.ends[last:]


def ascii_of(char: str) -> str:
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    same = unicodedata.normalize("NFKC", char)
    if len(same) == 1 and same.isascii():
        return same
    value = unicodedata.decimal(char, None)
    return char if value is None else str(value)


def referred(m: re.Match) -> list[tuple[str, int, int]]:
    """The printable ASCII character that a reference names; other references stay."""
    code, hexadecimal, name = m.groups()
    char = _NAMED[name.lower()] if name else chr(int(code) if code else int(hexadecimal, 16))
    return [(char, *m.span())] if " " <= char <= "~" else untouched(m)


def untouched(m: re.Match) -> list[tuple[str, int, int]]:
    return [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m.group())]


def digits_of(word: str) -> str:
    """The digits that a spelled number stands for."""
    parts = re.split(r"[\s-]", word.lower())
    if parts[0] in TIMES:
        return SPELLED[parts[1]] * TIMES[parts[0]]
    if parts[0] in TENS:
        return TENS[parts[0]] + (SPELLED[parts[1]] if len(parts) > 1 else "0")
    return TEENS.get(parts[0]) or SPELLED[parts[0]]


def spelled_out(m: re.Match, first: int, last: int) -> list[tuple[str, int, int]]:
    return [(digit, *w.span()) for w in _ONE.finditer(m.string, first, last) for digit in digits_of(w.group())]


def as_digits(m: re.Match) -> list[tuple[str, int, int]]:
    """A run of spelled digits as digits; a single one only beside a written digit or a dot."""
    first, last = m.span("run")
    digits = spelled_out(m, first, last)
    alone = len({start for _, start, _ in digits}) < 2
    if alone and not _BEFORE.search(m.string, max(0, first - 4), first) and not _AFTER.match(m.string, last):
        return untouched(m)
    return digits


def disguised(text: str) -> list[Span]:
    """Identifiers of the rewritten text in any of its readings, as source spans."""
    found: dict[Span, None] = {}
    read = set()
    for spelled in (None, _SPACED, _JOINED):
        new = rewritten(text, spelled)
        if new.text not in read:
            read.add(new.text)
            found.update(dict.fromkeys((kind, new.starts[a], new.ends[b - 1]) for kind, a, b in plain(new.text)))
    return list(found)


def rewritten(text: str, spelled: re.Pattern | None) -> Rewritten:
    """One reading: ``spelled`` finds the digits as words, after the dots have become signs;
    without it, only runs of three or more are digits."""
    new = Rewritten(text)
    new.apply(_REFERENCE, referred)
    new.apply(_STRANGE, lambda m: [] if m.group() in INVISIBLE else [(ascii_of(m.group()), m.start(), m.end())])
    if not spelled:
        new.apply(_RUN, lambda m: spelled_out(m, *m.span()))
        new.apply(_PLUS, lambda m: [("+", m.start(), m.end())])
    new.apply(_BRACKETS, lambda m: [("@" if next(filter(None, m.groups())).lower() in ("at", "@") else ".", m.start(), m.end())])
    for dot in (_DOTTED, _RAILED):
        new.apply(dot, lambda m: [(".", m.start(), m.end())])
    if spelled:
        new.apply(spelled, as_digits)
        new.apply(_PLUS, lambda m: [("+", m.start(), m.end())])
    if "." in new.text:
        masked = {i for i, c in enumerate(new.text) if c == "." and new.ends[i] - new.starts[i] > 1}

        def sign(m: re.Match) -> list[tuple[str, int, int]]:
            name = DOMAIN.match(new.text, m.end())
            known = name and name.group().rsplit(".", 1)[1].lower() in ENDINGS
            if name and (known and local_before(new.text, m.start()).strip("._%+-").lower() not in NOT_NAMES
                         or any(i in masked for i in range(*name.span()))):
                return [("@", m.start(), m.end())]
            return untouched(m)

        new.apply(_AT, sign)
    return new


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """Plain spans, and those that only the transducers bring to light."""
    text = text or ""
    base = plain(text)
    if not (_STRANGE.search(text) if not text.isascii() else None) and not _HINT.search(text):
        return base, []
    known = set(base)
    return base, [s for s in disguised(text) if s not in known]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """A row for every document: plain spans counted by kind and digested, all spans as text."""
    names = [f"n_{kind}" for kind in KINDS]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(text) for text in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts,
                 pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([written(ordered(base + more)) for base, more in found], pa.string()),
                 pa.array([len(more) for _, more in found], pa.int64())],
                ["doc_id", *names, "base_sha256", "spans", "n_added"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        find, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, n_added long")
