"""Skills and keywords from posting text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hirelake.functions import text as tx
from hirelake.operators import aliases
from hirelake.plans.skew import join_counted


def _found(df: DataFrame, dictionary: DataFrame, row_id: str, text: str, longest: int) -> DataFrame:
    words = df.select(row_id, tx.tokens(text).alias("_words"))
    lower = dictionary.select(F.lower("alias").alias("alias"), "skill")
    return aliases.mentions(words, lower, row_id, "_words", "alias", "skill", longest)


def skill_mentions(df: DataFrame, dictionary: DataFrame, row_id: str = "posting_id",
                   text: str = "description", longest: int = 3) -> DataFrame:
    """Distinct ``(row_id, skill)`` for every dictionary alias found in the whole text.

    The aliases form a trie that goes round in parts of bounded size, and a text is walked once
    for each; what is shuffled is the mentions, not the word sequences of the texts.
    """
    return _found(df, dictionary, row_id, text, longest).distinct()


def extract_skills(df: DataFrame, dictionary: DataFrame, row_id: str = "posting_id",
                   text: str = "description", longest: int = 3) -> DataFrame:
    """``(row_id, skills)``: one array per row, at most as long as the dictionary."""
    return _found(df, dictionary, row_id, text, longest).groupBy(row_id).agg(
        F.array_sort(F.collect_set("skill")).alias("skills"))


def term_counts(df: DataFrame, row_id: str = "posting_id", text: str = "description") -> DataFrame:
    """``(row_id, term, tf)``, counted inside each row: sorted tokens are cut where the
    term changes, so nothing is shuffled."""
    words = df.select(row_id, F.sort_array(tx.tokens(text)).alias("_w"))
    word = F.col("_w")
    cuts = words.select(row_id, "_w", F.filter(
        F.sequence(F.lit(0), F.size("_w") - 1),
        lambda i: (i == 0) | (F.get(word, i) != F.get(word, i - 1))).alias("_cut"))
    ends = F.concat(F.slice("_cut", F.lit(2), F.size("_cut")), F.array(F.size("_w")))
    runs = F.zip_with("_cut", ends, lambda a, b: F.struct(
        F.get(word, a).alias("term"), (b - a).cast("bigint").alias("tf")))
    # A text without tokens gives one empty run.
    return cuts.select(row_id, F.inline(runs)).where(F.col("tf") > 0)


def keywords(df: DataFrame, k: int, row_id: str = "posting_id", text: str = "description") -> DataFrame:
    """Top ``k`` terms per row by ``tf * ln((1 + N) / (1 + df))``; ties by term.

    The document frequencies are counted map-side in a first pass; in the second they
    join the terms of each row, and only ``k`` rows per text and task are shuffled.
    """
    total = df.count()
    spread = (
        df.select(F.explode(F.array_distinct(tx.tokens(text))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("_n", F.col("df"))
    )
    idf = F.log(F.lit(1.0 + total) / (F.col("df") + 1.0))
    scored = join_counted(term_counts(df, row_id, text), spread, ["term"]).withColumn(
        "weight", F.round(F.col("tf") * idf, 6))
    order = Window.partitionBy(row_id).orderBy(F.desc("weight"), "term")
    return (
        scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(row_id, "term", "tf", "weight", "rank")
    )


def jobs_asking(jobs: DataFrame, keys: list[str], row_id: str, unique: bool) -> DataFrame:
    """``keys, skill, n_asking``: postings that ask for each skill.

    ``unique`` says that a posting has one row. Then distinct skills per row are counted
    map-side; otherwise (key, skill, posting) triples must be shuffled to be told apart.
    """
    asked = jobs.select(*keys, row_id, F.explode(F.array_distinct("skills")).alias("skill"))
    n = F.count(F.lit(1)) if unique else F.count_distinct(row_id)
    return asked.groupBy(*keys, "skill").agg(n.alias("n_asking"))


def skill_weights(jobs: DataFrame, skills: str = "skills") -> DataFrame:
    """Rarity of each skill over the postings: ``ln((1 + N) / (1 + df))``."""
    total = jobs.count()
    return (
        jobs.select(F.explode(F.array_distinct(skills)).alias("skill"))
        .groupBy("skill").agg(F.count(F.lit(1)).alias("df"))
        .select("skill", F.log(F.lit(1.0 + total) / (F.col("df") + 1.0)).alias("weight"))
    )
