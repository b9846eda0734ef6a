"""Nearest neighbours by inner product with multi-index hashing of learned binary codes.

Fit, on a bounded sample: `rotations` learned rotations (iterative quantization: alternate the signs
of the rotated vectors and the orthogonal map that brings the vectors nearest to them) give one bit
a rotated component. The Hamming radius is the one that, in the sample, holds `coverage` of the true
neighbours of its queries.

Index: every row's code is computed once and cut into 16-bit substrings, each indexed by its value. If
two codes differ in at most r bits, some substring j differs in at most a_j bits, for any a_j with
sum(a_j + 1) = r + 1 (pigeonhole); so probing the buckets within a_j of the query's substring finds
every code within r. What the probes find is tested on whole codes, and what is within r is ranked by
the original vectors in double precision.

How much of the table the probes would find is measured in the fit. Where it is at most `selective`,
probes and buckets meet in an equi-join of Spark. Where it is more, buckets spare nothing: neighbours
of vectors without structure differ in more than a third of their bits, and any bucket index of such
codes reaches most rows. Then the same codes are compared with the queries' in blocks of bounded
size, and the index is in what the radius spares: the products of all but a few of a hundred rows.
Both ways find every code within the radius; a query with fewer than `neighbours` of them also gets
the rows of nearest codes of each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import checkpointed

#: Bits of an indexed substring.
WIDTH = 16


@dataclass(frozen=True)
class Codes:
    """Rotations (one below the other), the radius that a search covers, the vectors' length, and the share of rows that probes find.

    Where lengths differ (longest > 0), a row gets one more component that makes all rows equally long,
    and a query a 0 there, so that directions order as inner products do.
    """

    rotations: np.ndarray
    radius: int
    dimension: int
    longest: float = 0.0
    found: float = 1.0

    def of(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Codes as rows of 16-bit substrings, of the directions alone."""
        return np.packbits(lengthened(vectors, self.longest, queries) @ self.rotations.T > 0, axis=1).view(np.uint16)

    def reach(self) -> np.ndarray:
        """The most bits by which substring j may differ, for codes within the radius (below 0: not probed)."""
        substrings = len(self.rotations) // WIDTH
        total = self.radius + 1 - substrings
        return total // substrings + (np.arange(substrings) < total % substrings)


def lengthened(vectors: np.ndarray, longest: float, queries: bool) -> np.ndarray:
    """Vectors of one length, in the same order by inner product with a query."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    if not longest:
        return vectors / norm
    if queries:
        return np.hstack([vectors / norm, np.zeros_like(norm)])
    return np.hstack([vectors / longest, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))])


def learned_rotation(vectors: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """A rotation whose signs lose least: iterative quantization from a random start."""
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((vectors.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(vectors.T @ np.where(vectors @ rotation > 0, 1.0, -1.0))
        rotation = u @ v
    return rotation.T


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of each code of a to each of b."""
    out = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(np.ascontiguousarray(a).view(np.uint64).T, np.ascontiguousarray(b).view(np.uint64).T, strict=True):
        out += np.bitwise_count(x[:, None] ^ y[None, :])
    return out


def probed(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether each code of a and each of b share a bucket within reach."""
    out = np.zeros((len(a), len(b)), bool)
    for j, most in enumerate(reach.tolist()):
        out |= np.bitwise_count(a[:, j][:, None] ^ b[:, j][None, :]) <= most
    return out


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (key, vector) that can take part: finite components, not all zero."""
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(key).isNotNull() & x.isNotNull()).where(fine).select(F.col(key).alias("key"), x.alias("vector"))


def fit(rows: DataFrame, rotations: int = 4, sample: int = 4000, neighbours: int = 20, coverage: float = 0.97) -> Codes | None:
    """Codes learned from the `sample` ids of smallest hash; None without rows.

    The dimension is that of most sampled vectors. Of rows that repeat an id one is taken.
    """
    # the ids are ranked without their vectors, of which every task would send as many
    chosen = rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample)
    got = rows.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).orderBy("key").toPandas()
    if not len(got):
        return None
    size = got["vector"].map(len)
    x = np.array(got["vector"][size == size.mode().iloc[0]].tolist())
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    low, high = rows.where(F.size("vector") == x.shape[1]).agg(F.min(norm), F.max(norm)).first()
    longest = high if low < 0.999 * high else 0.0
    long = lengthened(x, longest, queries=False)
    d = long.shape[1]
    padded = np.pad(long, ((0, 0), (0, -d % 64)))
    maps = np.concatenate([learned_rotation(padded, n)[:, :d] for n in range(rotations)])
    codes = Codes(maps, len(maps), x.shape[1], longest)
    asked = x[: min(len(x), 500)]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    # in the whole table neighbours are nearer than in a sample, so this errs to the wide side
    best = np.argsort(-near, axis=1)[:, : max(1, min(neighbours, len(x) - 1))]
    rows_of, asked_of = codes.of(x), codes.of(asked, queries=True)
    radius = int(np.quantile(np.take_along_axis(apart(asked_of, rows_of), best, 1), coverage))
    codes = Codes(maps, radius, x.shape[1], longest)
    return Codes(maps, radius, x.shape[1], longest, float(probed(asked_of[:200], rows_of, codes.reach()).mean()))


def coded(rows: DataFrame, codes: Codes, queries: bool = False) -> DataFrame:
    """rows with code: the words of 64 bits of each vector's code, as longs."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            words = len(codes.rotations) // 64
            found = codes.of(batch.flatten().to_numpy().reshape(len(batch), codes.dimension), queries).view(np.int64) if len(batch) else np.empty((0, words), np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * words), pa.array(found.ravel()))

    return rows.where(F.size("vector") == codes.dimension).withColumn("code", run("vector"))


def _by_index(rows: DataFrame, asked: DataFrame, codes: Codes) -> DataFrame:
    """query_id, vec_id and score of the rows within the radius: probes and buckets in an equi-join, each pair at its first bucket."""
    words, reach = len(codes.rotations) // 64, codes.reach().tolist()
    part = lambda code, j: F.shiftrightunsigned(F.get(code, F.lit(j // 4)), 16 * (j % 4)).bitwiseAND(F.lit(0xFFFF))
    masks = [[sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(WIDTH), n)] for most in reach]

    def within(code: Column, j: int, probes: bool) -> Column:
        """(j, value) of the bucket of substring j, or of those within reach."""
        tried = F.array(*(F.lit(m).cast("long") for m in (masks[j] if probes else [0])))
        return F.transform(tried, lambda mask: F.struct(F.lit(j).alias("j"), part(code, j).bitwiseXOR(mask).alias("value")))

    def buckets(code: Column, probes: bool) -> Column:
        return F.explode(F.concat(*(within(code, j, probes) for j in range(len(reach)) if reach[j] >= 0)))

    index = rows.select(F.col("key").alias("vec_id"), F.col("code").alias("row_code"), buckets(F.col("code"), False).alias("bucket"))
    probes = asked.select(F.col("key").alias("query_id"), F.col("code").alias("query_code"), buckets(F.col("code"), True).alias("bucket"))
    met = index.join(probes, "bucket").where("vec_id != query_id")
    bits = lambda j: F.bit_count(part(F.col("row_code"), j).bitwiseXOR(part(F.col("query_code"), j)))
    earlier = F.lit(False)
    for j in range(len(reach)):
        earlier = earlier | ((F.col("bucket.j") > j) & (bits(j) <= reach[j]))
    whole = sum((F.bit_count(F.get("row_code", F.lit(w)).bitwiseXOR(F.get("query_code", F.lit(w)))) for w in range(words)), F.lit(0))
    # distinct, as rows that repeat an id are joined in by it
    pairs = met.where(~earlier & (whole <= codes.radius)).select("query_id", "vec_id").distinct()
    both = pairs.join(rows.select(F.col("key").alias("vec_id"), "vector"), "vec_id").join(asked.select(F.col("key").alias("query_id"), F.col("vector").alias("asked")), "query_id")
    score = F.aggregate(F.zip_with("vector", "asked", lambda x, y: x * y), F.lit(0.0), lambda a, v: a + v)
    return both.select("query_id", "vec_id", score.alias("score"))


def _in_blocks(rows: DataFrame, asked: DataFrame, codes: Codes, neighbours: int, row_block: int, query_block: int) -> DataFrame:
    """query_id, vec_id and score of each query's best rows in each block: within the radius, or of the `neighbours` nearest codes."""
    row_blocks, query_blocks = max(1, -(-rows.count() // row_block)), max(1, -(-asked.count() // query_block))
    dealt = rows.select(F.lit(False).alias("query"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(row_blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), "key", "vector", "code")
    sent = asked.select(F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("key", F.lit(2)), F.lit(query_blocks)).cast("int").alias("q"), "key", "vector", "code")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        is_query = group["query"].to_numpy()
        x, code = (np.array(group[c].tolist()).reshape(len(group), -1) for c in ("vector", "code"))
        ids = group["key"].to_numpy()
        own, own_ids, at, at_ids = x[is_query], ids[is_query], x[~is_query], ids[~is_query]
        out = []
        for low in range(0, len(own) if len(at) else 0, 64):
            far = apart(code[is_query][low : low + 64], code[~is_query])
            # itself, wherever it is in the block, and k more
            kth = np.partition(far, min(neighbours, len(at) - 1), axis=1)[:, min(neighbours, len(at) - 1)]
            near = far <= np.maximum(kth, codes.radius)[:, None]
            for n in range(len(far)):
                hit = np.flatnonzero(near[n] & (at_ids != own_ids[low + n]))
                score = (at[hit] * own[low + n]).sum(axis=1)
                best = np.lexsort((at_ids[hit], -score))[:neighbours]
                out.append(pd.DataFrame({"query_id": own_ids[low + n], "vec_id": at_ids[hit[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    return dealt.unionByName(sent).groupBy("b", "q").applyInPandas(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, neighbours: int = 20, key: str = "vec_id", column: str = "embedding", codes: Codes | None = None, selective: float = 0.02, row_block: int = 8192, query_block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's nearest rows, itself left out by id.

    Score: inner product in double precision; ties go to the smaller id. Vectors that are null, zero
    or hold null or non-finite components, and null ids, take no part, nor do vectors of another
    length than most. A query with fewer candidates gets those that there are. Repeated ids are ranked
    each; an empty table gives no rows. Only the key and the vector are read, so other columns may have
    any name, those of the result too. Results are approximate: a neighbour beyond the radius is missed.
    """
    rows = usable(vectors, key, column)
    codes = codes or fit(rows, neighbours=neighbours)
    if codes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = checkpointed(coded(rows, codes)), checkpointed(coded(usable(queries, key, column), codes, queries=True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
    if codes.found > selective:
        return best(_in_blocks(rows, asked, codes, neighbours, row_block, query_block))
    found = checkpointed(best(_by_index(rows, asked, codes)))
    full = found.where(F.col("rank") == neighbours).select(F.col("query_id").alias("key"))
    rest = best(_in_blocks(rows, asked.join(full, "key", "left_anti"), codes, neighbours, row_block, query_block))
    return found.join(full.distinct().withColumnRenamed("key", "query_id"), "query_id", "left_semi").unionByName(rest)
