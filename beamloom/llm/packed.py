"""Hashes of words and of runs of words, and the number of slices of the hash space.

Operators that match many short keys (a few for each document or position) send them through
Spark's shuffle as arrays: one row holds the keys of one batch that fall into one bucket. A
partition then sorts its keys with numpy. Rows and bytes are a fraction of one row a key.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

MASK = (1 << 64) - 1
CACHED_WORDS = 150_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for each worker up to CACHED_WORDS."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k word hashes; order matters."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def buckets(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
