import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hirelake.functions import text as tx


def values(spark, items, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r.x for r in rows.select("i", expr("v").alias("x")).orderBy("i").collect()]


def test_canonical_url(spark):
    got = values(spark, [
        "https://www.Example.com/Jobs/1/?utm_source=x#top", "http://m.example.com/jobs/1.html",
        "HTTP://WWW.EXAMPLE.COM/JOBS/1", "http://10.0.0.1:8080/a/", None, "", "example.com/jobs/1",
    ], tx.canonical_url)
    assert got == ["example.com/jobs/1"] * 3 + ["10.0.0.1:8080/a", None, "", "example.com/jobs/1"]


def test_canonical_url_keeps_what_names_the_job(spark):
    got = values(spark, [
        "https://a.com/jobs?id=1", "https://a.com/jobs?id=2", "https://a.com/jobs/?utm_medium=x&id=2&gclid=7#t",
        "a.com/j?b=2&a=1&ref=home", "a.com/j?a=1&b=2", "http://m.co/1", "http://co/1", "http://www.m.co/1",
        "a.com/j?reference=4", "https://", "a.com/?gclid &x",
    ], tx.canonical_url)
    assert got == ["a.com/jobs?id=1", "a.com/jobs?id=2", "a.com/jobs?id=2", "a.com/j?a=1&b=2", "a.com/j?a=1&b=2",
                   "m.co/1", "co/1", "m.co/1", "a.com/j?reference=4", "", "a.com?x"]


def test_titles_and_companies(spark):
    assert values(spark, ["Sr.  Software Eng (m/f/d)", "SENIOR software engineer", "Jr Dev", "Köchin/Koch", "", None],
                  tx.norm_title) == ["senior software engineer", "senior software engineer", "junior developer",
                                     "köchin koch", "", None]
    assert values(spark, ["Acme, Inc.", "ACME  Co. Ltd", "acme", "Müller GmbH", "Inc", None], tx.norm_company) == [
        "acme", "acme", "acme", "müller", "inc", None]


@pytest.mark.parametrize("text, low, high", [
    ("$120k–150k", 120_000.0, 150_000.0), ("120,000", 120_000.0, 120_000.0), ("$120-150k", 120_000.0, 150_000.0),
    ("$50 per hour", 104_000.0, 104_000.0), ("competitive", None, None), ("", None, None), (None, None, None),
    ("from 90,000.50 a year", 90_000.5, 90_000.5), ("$8,000 per month", 96_000.0, 96_000.0),
    ("$400 per day", 104_000.0, 104_000.0), ("$2k a week", 104_000.0, 104_000.0), ("90.000 EUR", 90_000.0, 90_000.0),
    ("$120k plus 5 weeks vacation", 120_000.0, 120_000.0), ("$30/hour, 40 hours", 62_400.0, 62_400.0),
    ("45,50 € / hr", 94_640.0, 94_640.0), ("$100k, 4 days a week", 100_000.0, 100_000.0),
    ("monthly salary: €5.000 to €6.000", 60_000.0, 72_000.0),
    ("up to $1.5m", 1_500_000.0, 1_500_000.0), ("$1.2-1.5m", 1_200_000.0, 1_500_000.0),
    ("$900k - $1.1m", 900_000.0, 1_100_000.0), ("2 million USD", 2_000_000.0, 2_000_000.0),
    ("1.2 to 1.5 million", 1_200_000.0, 1_500_000.0), ("$80,000, desk 2m wide", 80_000.0, 80_000.0),
    ("401k match, $90,000", 90_000.0, 90_000.0), ("$90k plus 401(k)", 90_000.0, 90_000.0), ("401k", None, None),
    ("$401k", 401_000.0, 401_000.0), ("350k to 401k", 350_000.0, 401_000.0), ("401k - 450k", 401_000.0, 450_000.0),
    ("$100k - 401k match", 100_000.0, 100_000.0), ("401k EUR", 401_000.0, 401_000.0),
])
def test_comp(spark, text, low, high):
    assert values(spark, [text], tx.parse_comp) == [(low, high)]


def test_seniority(spark):
    assert values(spark, ["Sr. Eng", "Jr Dev", "Lead Cook", "Cook", "Trainee cook", "Seniority expert", None],
                  lambda c: tx.seniority(tx.norm_title(c))) == [
        "senior", "junior", "lead", "mid", "intern", "mid", None]


def test_html(spark):
    page = ("<html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head>"
            "<body><!-- x --><p>One<br>two &lt;3</p></body></html>")
    assert values(spark, [page, None], tx.html_to_text) == ["A & B One two <3", None]
    assert values(spark, [page, "no title"], tx.html_title) == ["A & B", ""]


def test_ngrams(spark):
    rows = spark.createDataFrame([("a b c",), ("a",), ("",), ("a a a",)], "t string").select(tx.tokens("t").alias("w"))
    got = [r.g for r in rows.select(tx.ngrams(F.col("w"), 3).alias("g")).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], [], ["a", "a a", "a a a"]]


def test_posting_key_keeps_sources_apart(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", None)], "s string, e string")
    keys = [r.k for r in rows.select(tx.posting_key("s", "e").alias("k")).collect()]
    assert keys[0] != keys[1] and keys[2] is None


printable = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=30)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(printable, st.sampled_from(["http://www.http://a.html/.html", "Sr. Sr", "A Inc. Ltd", "m.m.co?b &a&ref", "x?a?b&&"])),
                min_size=1, max_size=30))
def test_normal_forms_are_stable(spark, items):
    for f in (tx.canonical_url, tx.norm_title):
        once = values(spark, items, f)
        assert values(spark, once, f) == once


def test_hints_of_units_are_in_every_way_to_write_them(spark):
    for unit, hint in tx.UNIT_HINTS.items():
        assert all(hint in word for word in [*tx.UNIT_WORDS[unit].split("|"), tx.UNIT_ADVERBS[unit]])
    assert set(tx.UNIT_HINTS) == set(tx.UNITS_PER_YEAR)
    texts = {"$50 an hour": 104_000.0, "$400 / day": 104_000.0, "$2k a wk": 104_000.0, "$5,000 monthly": 60_000.0,
             "$60k - $70k": 60_000.0, "$60k with health": 60_000.0}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.low for r in frame.select("t", tx.parse_comp("t")["min"].alias("low")).collect()} == texts
