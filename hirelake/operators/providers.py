"""Embedding and text models chosen by one configuration value each.

``hirelake.embedding`` and ``hirelake.llm`` of the session name a provider, with an argument after
a colon where it takes one: ``hashing:512``, ``fitted:s3://shared/models/idf-256-…``, ``template``.
Another model is registered under a name of its own and switched on by that value; jobs
and resumes must be embedded again, which ``embed.pending_embeddings`` sees by the model id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from hirelake.operators.embed import EmbeddingProvider, FittedEmbedding, HashingEmbedding, LLMProvider, TemplateProvider

EMBEDDING, LLM = "hirelake.embedding", "hirelake.llm"


def _fitted(spark: SparkSession, where: str) -> FittedEmbedding:
    folder, model_id = where.rstrip("/").rsplit("/", 1)
    return FittedEmbedding.load(spark, folder, model_id)


_KNOWN: dict[str, dict[str, Callable]] = {
    EMBEDDING: {"hashing": lambda spark, dim: HashingEmbedding(int(dim or 256)), "fitted": _fitted},
    LLM: {"template": lambda spark, opening: TemplateProvider(opening) if opening else TemplateProvider()},
}
_DEFAULT = {EMBEDDING: "hashing:256", LLM: "template"}


def register(setting: str, name: str, make: Callable[[SparkSession, str], EmbeddingProvider | LLMProvider]) -> None:
    """Make a provider known; ``make`` gets the session and what follows the colon."""
    _KNOWN[setting][name] = make


def _made(spark: SparkSession, setting: str):
    name, _, argument = spark.conf.get(setting, _DEFAULT[setting]).partition(":")
    if name not in _KNOWN[setting]:
        raise ValueError(f"{setting} names {name!r}, known are {sorted(_KNOWN[setting])}")
    return _KNOWN[setting][name](spark, argument)


def embedding(spark: SparkSession) -> EmbeddingProvider:
    return _made(spark, EMBEDDING)


def llm(spark: SparkSession) -> LLMProvider:
    return _made(spark, LLM)
