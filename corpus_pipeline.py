"""Documents to a clean, mixed and sharded training corpus, stage by stage.

Each stage reads all that its predecessor kept. The first four return the columns of the
documents they were given; the last one returns the place of every document. Stages treat
nulls, empty and repeated rows as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hirelake.llm import jaccard, language, mixing, sharding, tiling
from hirelake.llm.words import ready, table
from hirelake.session import materialize

# Texts further than this from every profile are in no language of the corpus. Clean prose
# scores 0.45 and more; chance agreement of unrelated scripts stays below 0.1.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text is in none of the languages learned from ``docs`` itself."""
    ready(spark)
    profiles = language.fitted(docs)
    judged = language.with_language(docs.select(F.struct("*").alias("row"), "text"), profiles)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    ready(spark)
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return tiling.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin out documents towards the weights of their sources."""
    ready(spark)
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle the mix and give every document its shard and slot."""
    ready(spark)
    return sharding.shard_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Rank-order profiles, tiling and connected components are beyond plain SQL; tests hold the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
