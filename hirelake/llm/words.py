"""Words, their hashes and per-task helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from hirelake.session import tune

# The white space that separates words is U+0020 and U+0009 to U+000D.
# ``bytes.split`` splits on exactly these, and ``bytes.lower`` touches A-Z only.
WORD = r"[^\x20\x09-\x0D]+"
CACHED_WORDS = 400_000


def ready(spark: SparkSession) -> SparkSession:
    """Runtime settings, and Arrow batches that stay small when texts are long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a whole text; a null text has none."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered for the frequent ones; emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` values, modulo 2**64 and then mixed."""
    if len(hashes) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(hashes) - width + 1 + k]
    return mix64(out)
