"""The registered queries of this folder: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from hirelake.llm import (attention, bayes, bpe, jaccard, language, materialise, mixing, nearest, negatives, pii, runs,
                          sharding, tiling)
from hirelake.llm.words import WORD, table
from hirelake.session import fresh_dir


def op1_decontamination(spark, sf):
    return tiling.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op2_quality(spark, sf):
    """A document's host is its source, its path the language section of that source."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "text")
    return bayes.quality(docs, table(spark, sf, "labels"))


def op3_nearest(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest.nearest(vectors, vectors.where("id % 20 = 0"))


def op4_mix_sources(spark, sf):
    return mixing.mixing_plan(table(spark, sf, "documents"))


def op5_ngram_jaccard(spark, sf):
    return jaccard.components(table(spark, sf, "documents"))


def op6_pii(spark, sf):
    return pii.find_pii(table(spark, sf, "documents"))


def op7_language(spark, sf):
    return language.identify(table(spark, sf, "documents"))


def op8_training_order(spark, sf):
    docs = table(spark, sf, "documents")
    return materialise.write_shards(docs, fresh_dir(spark, "training-order"))


def op9_lm_score(spark, sf):
    return attention.score(table(spark, sf, "documents"))


def op10_sharding(spark, sf):
    return sharding.shard_documents(table(spark, sf, "documents"))


def with_repeats(docs):
    """In a tenth of the texts, chosen by their id, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))

    def planted(t):
        n = F.size(t["words"])
        a = (t["g"] % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + t["g"] % 8))).cast("int")
        return F.array_join(F.transform(
            t["words"], lambda w, i: F.when(i < a, w).otherwise(F.get(t["words"], a + (i - a) % p))), " ")

    # The array binds the words, so they are taken once and not for every place.
    changed = F.transform(F.array(F.struct(words.alias("words"), g.alias("g"))), planted)[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD), changed).otherwise(F.col("text")).alias("text"))


def op11_runs(spark, sf):
    found = runs.find_runs(with_repeats(table(spark, sf, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length",
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return negatives.hard_negatives(vectors, F.col("id") % 100 == 0)


def op13_bpe(spark, sf):
    spelled = bpe.decode(bpe.encode(table(spark, sf, "documents")))
    return spelled.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in [
    op1_decontamination, op2_quality, op3_nearest, op4_mix_sources, op5_ngram_jaccard, op6_pii, op7_language,
    op8_training_order, op9_lm_score, op10_sharding, op11_runs, op12_hard_negatives, op13_bpe,
]}
QUERIES["pipeline"] = corpus_pipeline.run

SQL = {"op4_mix_sources": mixing.SQL, "op5_ngram_jaccard": jaccard.SQL, "op12_hard_negatives": negatives.SQL}
