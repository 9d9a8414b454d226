"""Embedding and text generation behind swappable providers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hirelake.functions.text import WORD_BREAK, tokens


class EmbeddingProvider(Protocol):
    """A model that turns texts into vectors. Loaded once per partition."""

    model_id: str

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class LLMProvider(Protocol):
    """A model that completes prompts. Loaded once per partition."""

    def complete(self, prompts: list[str]) -> list[str]: ...


class HashingEmbedding:
    """Default provider: hashed term counts scaled to unit length, wholly in the JVM.

    It has no fitted state, so vectors made on different days stay comparable and new
    postings can be embedded without re-reading the corpus.
    """

    def __init__(self, dim: int = 256):
        self.dim = dim
        self.model_id = f"hashing-tf-{dim}"

    def embed_frame(self, df: DataFrame, text: str) -> DataFrame:
        filled = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        words = RegexTokenizer(
            inputCol="_text", outputCol="_words", pattern=WORD_BREAK, toLowercase=True)
        hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=self.dim)
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)
        out = unit.transform(hashed.transform(words.transform(filled)))
        return out.withColumn(
            "embedding", vector_to_array("_unit", "float32")
        ).drop("_text", "_words", "_tf", "_unit")


class WordSlots(dict):
    """The slot of a word, remembered for frequent ones; emptied when it is full."""

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        slot = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        return slot

    def counts(self, words: list[str] | None) -> np.ndarray:
        return np.bincount(np.fromiter(map(self.__getitem__, words or ()), np.int64), minlength=self.dim)


class FittedEmbedding:
    """Hashed term counts weighted by inverse document frequency and scaled to unit length.

    The fitted state is how many texts use each slot, ``dim`` numbers however large the corpus. Its
    digest is part of ``model_id``: vectors of another fit are never compared with these, and
    ``pending_embeddings`` asks for all texts again when the model changes. A slot that no fitted
    text uses has the highest weight; a text without words has the zero vector.
    """

    def __init__(self, n_texts: int, uses: list[int]) -> None:
        self.n_texts, self.uses, self.dim = n_texts, list(uses), len(uses)
        said = f"{n_texts}:{','.join(map(str, self.uses))}"
        self.model_id = f"idf-{self.dim}-{hashlib.md5(said.encode()).hexdigest()[:12]}"

    @classmethod
    def fit(cls, df: DataFrame, text: str = "description", dim: int = 256) -> FittedEmbedding:
        """Count the slots that each text uses, map-side; one row per task is summed up."""
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots, uses, n = WordSlots(dim), np.zeros(dim, np.int64), 0
            for batch in batches:
                for words in batch.column(0).to_pylist():
                    uses += slots.counts(words) > 0
                    n += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([n]), pa.array([uses.tolist()], pa.list_(pa.int64()))], ["n", "uses"])

        counted = df.select(tokens(text).alias("words")).mapInArrow(count, "n long, uses array<long>")
        total = counted.select("n", F.posexplode("uses").alias("slot", "c")).groupBy("slot").agg(
            F.sum("c").alias("c"), F.sum("n").alias("n")).orderBy("slot").collect()  # ``dim`` rows
        return cls(total[0].n if total else 0, [r.c for r in total] or [0] * dim)

    def save(self, spark: SparkSession, path: str) -> None:
        """Keep this version beside others; the folder holds one small table per model."""
        spark.createDataFrame([(self.model_id, self.n_texts, self.uses)], "model_id string, n_texts long, uses array<long>").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/{self.model_id}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, model_id: str) -> FittedEmbedding:
        row = spark.read.parquet(f"{path}/{model_id}").first()
        return cls(row.n_texts, row.uses)

    def embed_frame(self, df: DataFrame, text: str) -> DataFrame:
        weights = np.log((self.n_texts + 1.0) / (np.array(self.uses) + 1.0))
        dim, names = self.dim, df.columns

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = WordSlots(dim)
            for batch in batches:
                raw = np.array([slots.counts(w) for w in batch.column(len(names)).to_pylist()]).reshape(-1, dim) * weights
                norms = np.sqrt((raw ** 2).sum(1, keepdims=True))
                unit = (raw / np.where(norms == 0, 1.0, norms)).astype(np.float32)
                ends = pa.array(np.arange(len(unit) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(names)], pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], [*names, "embedding"])

        schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        return df.select("*", tokens(text)).mapInArrow(encode, f"{schema}, embedding array<float>")


def text_hash(text):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def embed(df: DataFrame, provider, text: str = "description", batch: int = 256) -> DataFrame:
    """Add ``embedding``, ``model_id`` and ``text_hash``."""
    if hasattr(provider, "embed_frame"):
        out = provider.embed_frame(df, text)
    else:
        schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts = frame[text].fillna("").tolist()
                vectors = []
                for start in range(0, len(texts), batch):
                    vectors.extend(list(map(float, v)) for v in provider.encode(texts[start:start + batch]))
                yield frame.assign(embedding=vectors)

        out = df.mapInPandas(encode, schema)
    return out.withColumn("model_id", F.lit(provider.model_id)).withColumn("text_hash", text_hash(text))


def assert_same_model(*frames: DataFrame) -> str:
    """The one model all frames were embedded with; raises if there are several."""
    found = set()
    for frame in frames:
        found.update(r[0] for r in frame.select("model_id").distinct().limit(2).collect())
    if len(found) > 1:
        raise ValueError(f"vectors of different models cannot be compared: {sorted(map(str, found))}")
    return next(iter(found), "")


def pending_embeddings(posts: DataFrame, store: DataFrame, model_id: str,
                       text: str = "description", row_id: str = "posting_id") -> DataFrame:
    """Postings that are new, whose text changed, or that another model embedded."""
    wanted = posts.withColumn("text_hash", text_hash(text)).withColumn("model_id", F.lit(model_id))
    have = store.where(F.col("model_id") == model_id).select(row_id, "model_id", "text_hash")
    return wanted.join(have, [row_id, "model_id", "text_hash"], "left_anti")


def current_embeddings(posts: DataFrame, store: DataFrame, model_id: str,
                       text: str = "description", row_id: str = "posting_id") -> DataFrame:
    """``row_id, model_id, text_hash, embedding``: of an append-only store, the vector of each posting's
    present text by one model, once however often it was appended. Postings that are still
    pending have none. Only the model's folder is read, and ids travel with a hash, not texts."""
    wanted = posts.select(row_id, text_hash(text).alias("text_hash"))
    have = store.where(F.col("model_id") == model_id).select(row_id, "text_hash", "embedding")
    return (
        have.join(wanted, [row_id, "text_hash"], "left_semi").dropDuplicates([row_id, "text_hash"])
        .select(row_id, F.lit(model_id).alias("model_id"), "text_hash", "embedding")
    )


class TemplateProvider:
    """Offline default: completes a prompt by fixed rules, without a model."""

    def __init__(self, opening: str = "Dear hiring team,", closing: str = "Kind regards"):
        self.opening, self.closing = opening, closing

    def complete(self, prompts: list[str]) -> list[str]:
        return [f"{self.opening}\n\n{p}\n\n{self.closing}" for p in prompts]

    def complete_column(self, prompt: Column) -> Column:
        """The same as an expression, so that no row leaves the JVM."""
        return F.concat(F.lit(f"{self.opening}\n\n"), F.coalesce(prompt, F.lit("")), F.lit(f"\n\n{self.closing}"))


def generate(df: DataFrame, prompt_col: str, provider: LLMProvider, out: str = "completion",
             batch: int = 64) -> DataFrame:
    """Complete a prompt column: by the provider's expression if it has one, else in Arrow batches."""
    if hasattr(provider, "complete_column"):
        return df.withColumn(out, provider.complete_column(F.col(prompt_col)))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def complete(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts, answers = frame[prompt_col].fillna("").tolist(), []
            for start in range(0, len(prompts), batch):
                answers.extend(provider.complete(prompts[start:start + batch]))
            yield frame.assign(**{out: answers})

    return df.mapInPandas(complete, schema)
