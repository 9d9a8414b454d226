"""Quality by hierarchical empirical Bayes: document evidence, host and path.

A logistic classifier on the shape of a whole text gives each document its evidence. Sums
of it per path and per host give posteriors: a path is drawn towards its host and a host
towards the corpus, the more so the fewer documents it has. How strongly is estimated from
how far sites differ beyond chance (method of moments). A document's own evidence is taken
out of its sites' sums before they meet, so that it counts once.

The classifier is fitted on at most ``FITTED`` labelled rows, those with the smallest hash
of their id. Everything else covers all documents. Null texts count as empty. Null hosts or
paths are sites of their own. Null labels are not learned from; without labels of both
kinds the evidence is 0.5. Rows that repeat are documents like others. Extra columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hirelake.session import materialize

FITTED = 20_000
SHAPES = 14

_KIND = np.zeros(256, np.int64)  # of a UTF-8 byte: 0 other mark, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[32], _KIND[9:14], _KIND[10] = 1, 2, 3, 6, 4, 4, 5
_MARKS = b"!|#$%*.,"


def shape(text: str | None) -> list[float]:
    """Shares of kinds of characters, words that repeat, lines that repeat, and lengths."""
    data = (text or "").encode()
    size = max(1, len(data))
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7) / size
    words, lines = data.lower().split(), [x for x in data.split(b"\n") if x.strip()]
    marks = [data.count(bytes([m])) / max(1, len(words)) for m in (_MARKS[0], _MARKS[1])]
    odd = sum(data.count(bytes([m])) for m in _MARKS[2:6]) / max(1, len(words))
    return [*kinds[[0, 2, 3, 4, 5, 6]], *marks, odd, size / max(1, len(words)) / 10, len(set(words)) / max(1, len(words)),
            len(set(lines)) / max(1, len(lines)), float(np.log1p(len(words))), float(np.log1p(len(words)) ** 2) / 10]


class Classifier:
    """Logistic regression on standardized shapes, fitted by Newton's method."""

    def __init__(self, shapes: np.ndarray, good: np.ndarray, ridge: float = 1.0) -> None:
        self.weights = None
        if len(set(good.tolist())) < 2:
            return
        self.mean, self.spread = shapes.mean(0), shapes.std(0) + 1e-9
        x = self._laid_out(shapes)
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - good) + ridge * w
            w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), slope)
        self.weights = w

    def _laid_out(self, shapes: np.ndarray) -> np.ndarray:
        z = np.clip((shapes - self.mean) / self.spread, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z ** 2])

    def evidence(self, shapes: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(shapes), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._laid_out(shapes) @ self.weights, -12, 12)))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FITTED) -> Classifier:
    """``labels``: ``doc_id`` and ``quality`` (0 or 1). At most ``rows`` labels are read."""
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(
        F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([shape(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())),
                 batch.column("quality").cast(pa.float64())], ["shape", "good"])

    # One text for each label, however often documents repeat an id.
    got = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).mapInArrow(run, "shape array<double>, good double").collect()
    return Classifier(np.array([r["shape"] for r in got], float).reshape(len(got), SHAPES), np.array([r.good for r in got]))


def with_evidence(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, host, path, p_doc`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = np.array([shape(t) for t in batch.column("text").to_pylist()], float).reshape(batch.num_rows, SHAPES)
            yield batch.drop_columns(["text"]).append_column("p_doc", pa.array(shared.value.evidence(shapes)))

    lean = docs.select("doc_id", "host", "path", "text")
    schema = type(lean.schema)([f for f in lean.schema.fields if f.name != "text"]).add("p_doc", "double")
    return lean.mapInArrow(run, schema)


def strength(total: str, count: str, centre: Column) -> Column:
    """How many documents the prior is worth: from the spread of site means around their
    centre beyond what their counts explain. An aggregate expression over sites."""
    mean = F.col(total) / F.col(count)
    chance = centre * (1 - centre) / F.col(count)
    between = F.avg((mean - centre) ** 2 - chance)
    inside = F.avg(centre * (1 - centre))
    return F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), F.coalesce(F.when(between > 0, inside / between - 1), F.lit(10_000.0))))


def logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def quality(docs: DataFrame, labels: DataFrame, rows: int = FITTED) -> DataFrame:
    """``docs``: ``doc_id, host, path, text``. Evidence, posteriors and the verdict for every row."""
    scores = materialize(with_evidence(docs, fitted(docs, labels, rows)), "evidence")
    paths = scores.groupBy("host", "path").agg(F.sum("p_doc").alias("path_sum"), F.count(F.lit(1)).alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    # Three numbers for the whole corpus come to the driver.
    overall = hosts.agg((F.sum("host_sum") / F.sum("host_n")).alias("p")).first().p
    p_all = F.lit(0.5 if overall is None else overall)
    host_prior = F.lit(hosts.agg(strength("host_sum", "host_n", p_all)).first()[0])
    centre = (F.col("host_sum") + host_prior * p_all) / (F.col("host_n") + host_prior)
    inside = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
    path_prior = F.lit(inside.agg(strength("path_sum", "path_n", centre)).first()[0])
    sites = inside.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "path_sum", "path_n", "host_sum", "host_n")
    joined = scores.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    others = lambda name: F.col(f"{name}_sum") - F.col("p_doc")
    return (
        joined.withColumn("p_host", (others("host") + host_prior * p_all)
                          / (F.col("host_n") - 1 + host_prior))
        .withColumn("p_path", (others("path") + path_prior * F.col("p_host"))
                    / (F.col("path_n") - 1 + path_prior))
        .withColumn("p_quality", 1 / (1 + F.exp(-(logit(F.col("p_doc")) + logit(F.col("p_path")) - logit(p_all)))))
        .select("doc_id", "host", "path", "p_doc", "p_host", "p_path", "p_quality", (F.col("p_quality") >= 0.5).alias("keep"))
    )
