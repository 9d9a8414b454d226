"""Scalar normalization of posting fields as native column expressions.

Nothing here is a Python UDF. Higher-order functions (``transform``, ``filter``) are
interpreted inside the generated code; the others are compiled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Abbreviations written out in titles.
TITLE_ABBREVIATIONS = {
    "sr": "senior",
    "snr": "senior",
    "jr": "junior",
    "jnr": "junior",
    "eng": "engineer",
    "engr": "engineer",
    "dev": "developer",
    "mgr": "manager",
    "swe": "software engineer",
}
# Legal forms dropped from the end of company names.
LEGAL_SUFFIXES = (
    "inc", "llc", "ltd", "limited", "gmbh", "ag", "sa", "s a", "corp", "corporation",
    "co", "company", "plc", "bv", "nv", "oy", "ab", "srl",
)
# HTML entities worth decoding; the ampersand must come last.
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}
# Paid units in a year.
UNITS_PER_YEAR = {"hour": 2080, "day": 260, "week": 52, "month": 12}
# How the units are written.
UNIT_WORDS = {"hour": "hour|hr|h", "day": "day", "week": "week|wk", "month": "month|mo"}
UNIT_ADVERBS = {"hour": "hourly", "day": "daily", "week": "weekly", "month": "monthly"}
# What every way to write a unit holds, so that most texts need no pattern.
UNIT_HINTS = {"hour": "h", "day": "da", "week": "w", "month": "mo"}
# Query parameters that say where a click came from, not which job it is.
TRACKING = "utm_[^=&]*|gclid|fbclid|msclkid|ref"

WORD_BREAK = r"[^\p{L}]+"
NOT_ALNUM = r"[^\p{L}\p{N}+#]+"
URL_HEAD = r"^(?:\s|[a-z][a-z0-9+.-]*://)+"
URL_SITE = r"^(?:(?:www|m)\.)+([^/?#:\s]*\.)"  # only where a domain with a dot remains
URL_TAIL = r"(?:\s|/|\.html?)+$"
AMOUNT = r"[0-9]+(?:[.,][0-9]+)*(?:m\b| *(?:k|mn|mio|millions?)\b)?"
CURRENCY = r"(?:[$€£]|\b(?:usd|eur|gbp|chf)\b)"
_RANGE = rf"{AMOUNT}(?: *(?:-|–|—|to) *{CURRENCY}? *{AMOUNT})?"
_SCALED = r"[0-9]+(?:[.,][0-9]+)* *(?:k|mn|mio|millions?)\b"
# Amounts beside a currency, in thousands or in millions; other numbers of such a text are not pay.
# A bare "m" is no million: it may be a length or a month.
PAY = rf"{CURRENCY} *{_RANGE}|{_RANGE} *{CURRENCY}|{AMOUNT} *(?:-|–|—|to) *{_SCALED}|{_SCALED}"
THOUSANDS = r"[0-9] *k\b"
MILLIONS = r"[0-9](?:m| *(?:mn|mio|millions?))\b"
# What becomes of "401k", first to last: the savings plan goes, pay beside a currency or in a range
# is written so that the last rule leaves it, and what is left is the plan.
PLAN_RULES = (
    (r"\b401 *(?:\(k\)|k *(?:match|plan|contribution|retirement|benefit|saving))", " ", ""),
    (rf"([0-9k] *(?:to|-|–|—) *|{CURRENCY} *)401 *k\b", "", " 401.0k"),
    (rf"\b401 *k( *(?:(?:-|–|—|to) *{CURRENCY}? *[0-9]|[€£]|(?:usd|eur|gbp|chf)\b))", "401.0k ", ""),
    (r"\b401 *k\b", " ", ""),
)


def paid_per(unit: str) -> str:
    """A pattern for an amount followed by its unit, or a named rate."""
    words, adverb = UNIT_WORDS[unit], UNIT_ADVERBS[unit]
    return (rf"[0-9] *k?(?: *{CURRENCY})? *(?:(?:per|an?|each|/) *(?:{words})\b|{adverb}\b)"
            rf"|\b{adverb} (?:pay|rate|salary|wage)")


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_url(c) -> Column:
    """Scheme, ``www.``/``m.``, fragment, trailing slash, ``.html`` and tracking parameters
    removed; the other parameters, which may name the job, are kept in order of their text."""
    url = F.regexp_replace(F.lower(_column(c)), r"#.*$", "")
    path = F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), URL_HEAD, "")
    path = F.regexp_replace(F.regexp_replace(path, URL_SITE, "$1"), URL_TAIL, "")
    query = F.trim(F.regexp_extract(url, r"\?(.*)$", 1))
    telling = F.regexp_replace(query, rf"(?<=^|&) *(?:{TRACKING})(?:=[^&]*)? *(?=&|$)", "")
    kept = F.array_join(F.array_sort(F.array_remove(F.split(F.trim(telling), " *& *"), "")), "&")
    return F.when(F.coalesce(kept, F.lit("")) == "", path).otherwise(F.concat(path, F.lit("?"), kept))


def posting_key(source, external_id) -> Column:
    """Stable key of one posting at one source; null when either part is missing."""
    source, external_id = _column(source), _column(external_id)
    return F.when(
        source.isNotNull() & external_id.isNotNull(),
        F.sha2(F.concat_ws("\u001f", source, external_id), 256),
    )


def _words(c: Column) -> Column:
    spaced = F.regexp_replace(F.lower(c), NOT_ALNUM, " ")
    return F.trim(spaced)


def norm_title(c) -> Column:
    """Lower case, bracketed notes and punctuation dropped, abbreviations written out."""
    bare = F.regexp_replace(_column(c), r"\([^()]*\)", " ")
    long_form = F.create_map(*[F.lit(x) for pair in TITLE_ABBREVIATIONS.items() for x in pair])
    words = F.split(_words(bare), " ")
    return F.array_join(
        F.transform(words, lambda w: F.coalesce(F.try_element_at(long_form, w), w)), " "
    )


def norm_company(c) -> Column:
    """Lower case, punctuation and trailing legal forms dropped."""
    suffix = "( (" + "|".join(LEGAL_SUFFIXES) + "))+$"
    return F.regexp_replace(_words(_column(c)), suffix, "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def parse_comp(c) -> Column:
    """Yearly ``struct<min, max>`` from free text; nulls when it holds no amount.

    Amounts beside a currency, in thousands or in millions count; only a text without any is
    read for bare numbers. A point or comma before three digits groups thousands. "401k" is
    a savings plan unless a currency or a range makes it pay.
    """

    def without_plans(text: Column) -> Column:
        out = text
        for pattern, before, after in PLAN_RULES:
            group = "$1" if re.compile(pattern).groups else ""
            out = F.regexp_replace(out, pattern, before + group + after)
        return F.when(text.contains("401"), out).otherwise(text)

    def amounts(text: Column) -> Column:
        def amount(found: Column, pay: Column) -> Column:
            whole = F.regexp_replace(F.regexp_replace(found, r"[.,]([0-9]{3})\b", "$1"), ",", ".")
            value = F.regexp_replace(whole, "[^0-9.]", "").try_cast("double")
            return _let(value, lambda v: F.when(v >= 1000, v).when(found.contains("m"), v * 1_000_000.0)
                        .when(pay["k"], v * 1000.0).when(pay["m"], v * 1_000_000.0).otherwise(v))

        def found(pay: Column) -> Column:
            each = F.regexp_extract_all(pay, F.lit(AMOUNT), F.lit(0))
            scale = F.struct(pay.rlike(THOUSANDS).alias("k"), pay.rlike(MILLIONS).alias("m"))
            return _let(scale, lambda k: F.transform(each, lambda x: amount(x, k)))

        marked = F.array_join(F.regexp_extract_all(text, F.lit(PAY), F.lit(0)), " ; ")
        return _let(F.when(marked != "", marked).otherwise(text), found)

    def spread(text: Column) -> Column:
        factor = F.lit(1.0)
        for unit, many in reversed(UNITS_PER_YEAR.items()):
            paid = text.contains(UNIT_HINTS[unit]) & text.rlike(paid_per(unit))
            factor = F.when(paid, F.lit(float(many))).otherwise(factor)
        return _let(F.struct(amounts(text).alias("a"), factor.alias("f")), lambda x: F.struct(
            (F.array_min(x["a"]) * x["f"]).alias("min"), (F.array_max(x["a"]) * x["f"]).alias("max")))

    return _let(F.lower(_column(c)), lambda text: _let(without_plans(text), spread))


def seniority(title_norm) -> Column:
    """Bucket of a normalized title: intern, junior, mid, senior or lead."""
    t = _column(title_norm)
    word = lambda *names: t.rlike(f"(^| )({'|'.join(names)})( |$)")
    return (
        F.when(word("intern", "trainee"), "intern")
        .when(word("junior", "entry", "graduate"), "junior")
        .when(word("lead", "principal", "staff", "head", "director"), "lead")
        .when(word("senior"), "senior")
        .when(t.isNotNull(), "mid")
    )


def html_title(c) -> Column:
    raw = F.regexp_extract(_column(c), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return _collapse(_decode(raw))


def html_to_text(c) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed."""
    text = _column(c)
    for block in (
        r"(?is)<script[^>]*>.*?</script *>",
        r"(?is)<style[^>]*>.*?</style *>",
        r"(?s)<!--.*?-->",
        r"<[^>]+>",
    ):
        text = F.regexp_replace(text, block, " ")
    return _collapse(_decode(text))


def _decode(c: Column) -> Column:
    for entity, plain in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def _collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c) -> Column:
    """Lower-case letter runs of the whole text, in order."""
    return F.filter(F.split(F.lower(_column(c)), WORD_BREAK), lambda w: w != "")


def word_ngrams(words: Column, n: int) -> Column:
    """The ``n``-grams of a token array, in order. Pass a column and not a fresh
    expression, since it is read ``n`` times."""
    grams = words
    for i in range(1, n):
        rest = F.slice(words, F.lit(i + 1), F.size(words))
        grams = F.zip_with(grams, rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda g: g.isNotNull()) if n > 1 else grams


def ngrams(words: Column, longest: int) -> Column:
    """Distinct 1..``longest``-grams of a token array."""
    return F.array_distinct(F.concat(*[word_ngrams(words, n) for n in range(1, longest + 1)]))
