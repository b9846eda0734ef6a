"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import checkpointed


__all__ = ["Windows", "WordHasher", "checkpointed", "digests_of", "first_by_hash", "fresh", "gram_hashes", "mixed", "raw_text", "table", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_text(name: str = "text") -> Column:
    """A text column as UTF-8 bytes, which Python splits and lower-cases by ASCII rules alone."""
    return F.col(name).cast("binary")


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return text.split() if text else []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until df has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name += "_"
        out.append(f"_{name}")
    return out


def first_by_hash(df: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """The rows of the `most` least keys (well-mixed longs; rows of one key are equal, and one stands for them), in order; total: rows of df.

    Of the keys only a share comes to be ordered that twice as many are expected in, so that tasks send few rows.
    """
    share = min(1.0, (2 * most + 100) / max(total, 1))
    low = F.col(key).cast("double") < (share - 0.5) * 2.0**64 if share < 1 else F.lit(True)
    return df.where(low).dropDuplicates([key]).orderBy(key).limit(most)


class WordHasher:
    """64-bit hashes of words. Hashing a word takes less time than looking it up among those seen before."""

    def __call__(self, found: list[bytes]) -> np.ndarray:
        return digests_of(found)


def digests_of(found: Iterable[bytes | memoryview]) -> np.ndarray:
    """64-bit digests; as bytes they are joined without a Python number for each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), ">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word sequences that begin at each word but the last n-1, put together from those of halves."""
    out, held, span, done = None, hashes, 1, 0
    factor = BASE
    count = max(0, len(hashes) - n + 1)
    while span <= n:
        if n & span:
            # sequences of the lower bits of n begin where this one ends
            tail = held[n - done - span : n - done - span + count]
            out = tail if out is None else tail * np.uint64(pow(BASE, done, 1 << 64)) + out
            done += span
        if 2 * span <= n:
            held = held[: max(0, len(held) - span)] * np.uint64(factor) + held[span:]
            factor = factor * factor % (1 << 64)
        span *= 2
    return mixed(out + np.uint64(n))


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Windows:
    """Hashes of all windows of a length, by one running sum."""

    def __init__(self) -> None:
        self.up, self.down = _powers(BASE, 1 << 12), _powers(INVERSE, 1 << 12)

    def __call__(self, hashes: np.ndarray, length: int) -> np.ndarray:
        n = len(hashes)
        if n < length:
            return np.empty(0, np.uint64)
        while len(self.up) < n:
            self.up, self.down = _powers(BASE, 2 * len(self.up)), _powers(INVERSE, 2 * len(self.down))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.up[:n])))
        return mixed((total[length:] - total[:-length]) * self.down[: n - length + 1])

    def between(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hashes of the stretches of small numbers from each start to before its stop."""
        while len(self.up) < len(symbols):
            self.up, self.down = _powers(BASE, 2 * len(self.up)), _powers(INVERSE, 2 * len(self.down))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((symbols + np.uint64(1)) * self.up[: len(symbols)])))
        return mixed((total[stops] - total[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))
