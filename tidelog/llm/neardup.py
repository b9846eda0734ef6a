"""Near-duplicate documents by b-bit MinHash.

1. Every document becomes its set of word shingles. Rows of equal sets are one node from here on.
2. A node keeps `bands * width` minima. Each band of `width` minima is hashed to a bucket; of all
   minima only the low `bits` bits stay, packed into longs.
3. In each bucket the least node is paired with the others (a star, not all pairs). The packed
   signatures of a pair are compared by bit counts; equal low bits by chance are corrected for:
   similarity = (matches - 2^-bits) / (1 - 2^-bits). Pairs far below the threshold end here.
4. What is left is confirmed on the full shingle sets, and the links give components.
5. Two members of a bucket that are in different components then were perhaps never compared. In
   blocks of bounded size, signatures tell which components may belong together, and full sets
   which do: each member outside a family's largest component meets all others. Only links that
   connect components are put out, never all pairs. So no link within a bucket is lost.

With 30 bands of 5, a pair at the threshold of 0.8 shares no bucket with probability 7e-6, and
the signature bound (5 standard deviations) loses fewer than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidelog.llm.common import WordHasher, checkpointed, fresh, gram_hashes, mixed, raw_text, words
from tidelog.operators.components import components

SKETCH = "struct<n_shingles:long,set_low:long,set_high:long,bands:array<long>,signature:array<long>>"


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 80
    bands: int = 30
    width: int = 5
    bits: int = 2
    block: int = 256
    lower: bool = True

    @property
    def minima(self) -> int:
        return self.bands * self.width

    @property
    def most_misses(self) -> int:
        """Signature places in which a pair at the threshold may differ, with 5 standard deviations."""
        chance = 2.0**-self.bits
        match = chance + (1 - chance) * self.percent / 100
        return int(self.minima * (1 - match) + 5 * np.sqrt(self.minima * match * (1 - match)))


def shingles(found: list[bytes], hasher: WordHasher, n: int) -> np.ndarray:
    """Distinct n-word shingles as sorted 64-bit hashes; fewer words are one shingle, none are none."""
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hasher(found), min(n, len(found))))


def shingled(texts: list[bytes | None], hasher: WordHasher, params: Params) -> list[np.ndarray]:
    return [shingles(words(t.lower() if t and params.lower else t), hasher, params.shingle) for t in texts]


def sketches(sets: list[np.ndarray], params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits (int64) of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    seeds = mixed(np.arange(1, 2 * params.minima + 1, dtype=np.uint64)).astype(np.uint32)
    minima = np.empty((params.minima, len(sets)), np.uint32)
    for k in range(params.minima):
        minima[k] = np.minimum.reduceat(flat * (seeds[2 * k] | np.uint32(1)) + seeds[2 * k + 1], starts)
    bands = np.empty((len(sets), params.bands), np.uint64)
    for b in range(params.bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for row in minima[b * params.width : (b + 1) * params.width]:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
        bands[:, b] = key
    a_long = 64 // params.bits
    low = np.zeros((-(-params.minima // a_long) * a_long, len(sets)), np.uint64)
    # the low bits of a minimum are far from uniform for large sets, so those of its hash are taken
    low[: params.minima] = mixed(minima.astype(np.uint64)) & np.uint64(2**params.bits - 1)
    shifts = (np.arange(a_long, dtype=np.uint64) * np.uint64(params.bits))[None, :, None]
    packed = np.bitwise_or.reduce(low.reshape(-1, a_long, len(sets)) << shifts, axis=1)
    return bands.view(np.int64), np.ascontiguousarray(packed.T).view(np.int64)


def sketch(text: Column, params: Params) -> Column:
    """A struct of a document's sketch; null where it has no words."""

    @F.arrow_udf(SKETCH)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for batch in batches:
            rows: list[dict | None] = []
            for at in range(0, len(batch), 256):
                sets = shingled(batch[at : at + 256].to_pylist(), hasher, params)
                full = [s for s in sets if len(s)]
                found = iter(zip(*sketches(full, params), strict=True)) if full else iter(())
                for s in sets:
                    if not len(s):
                        rows.append(None)
                        continue
                    bands, signature = next(found)
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    low, high = np.frombuffer(key, np.int64).tolist()
                    rows.append({"n_shingles": len(s), "set_low": low, "set_high": high, "bands": bands, "signature": signature})
            yield pa.array(rows, kind)

    kind = pa.struct([("n_shingles", pa.int64()), ("set_low", pa.int64()), ("set_high", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64()))])
    return run(text)


def misses(a: Column, b: Column, params: Params) -> Column:
    """Places in which two packed signatures differ."""
    ones = sum(1 << k for k in range(0, 64, params.bits))
    ones = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones)
    total = F.lit(0)
    for n in range(-(-params.minima * params.bits // 64)):
        x = a[n].bitwiseXOR(b[n])
        for k in range(1, params.bits):
            x = x.bitwiseOR(F.shiftrightunsigned(a[n].bitwiseXOR(b[n]), k))
        total = total + F.bit_count(x.bitwiseAND(ones))
    return total


def similar(a: Column, b: Column, params: Params) -> Column:
    """Whether the full shingle sets of two texts reach the threshold."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        last, held = None, np.empty(0, np.uint64)
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, held = x, shingled([x], hasher, params)[0]
                other = shingled([y], hasher, params)[0]
                both = np.isin(other, held, assume_unique=True).sum()
                out.append(bool(100 * both >= params.percent * (len(held) + len(other) - both)))
            yield pa.array(out, pa.bool_())

    return run(a, b)


def _confirmed(stars: DataFrame, nodes: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """The pairs (a, b) of nodes whose signatures and then full sets are similar; a is the centre of a star."""
    sign = nodes.select("node", "signature", "first.row_id", "first.text_hash")
    # dealt by b, of which no value is frequent; by a, a large partition can be split
    pairs = stars.repartition("b").dropDuplicates(["a", "b"])
    for end in "ba":
        pairs = pairs.join(sign.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("signature", "row_id", "text_hash"))), end)
    pairs = pairs.where(misses(F.col("signature_a"), F.col("signature_b"), params) <= params.most_misses).drop("signature_a", "signature_b")
    for end in "ba":
        pairs = pairs.join(texts.select(F.col("row_id").alias(f"row_id_{end}"), F.col("text_hash").alias(f"text_hash_{end}"), F.col("raw").alias(f"raw_{end}")), [f"row_id_{end}", f"text_hash_{end}"])
    return pairs.where(similar(F.col("raw_a"), F.col("raw_b"), params)).select("a", "b")


def _dealt(members: DataFrame, group: str, block: int) -> DataFrame:
    """Members once for each pair (i, j) of blocks that they are compared in; j < 0 is a block of main members.

    Blocks hold about `block` members. Stray blocks meet each other and every main block; main blocks,
    whose members are linked already, don't meet. members: group, node, main and more columns.
    """
    counts = members.groupBy(group).agg(F.count_if(~F.col("main")).alias("s"), F.count_if(F.col("main")).alias("m")).where("s > 0")
    counts = counts.select(group, *(F.ceil(F.col(c) / block).alias(c) for c in "sm"))
    dealt = members.join(counts, group).withColumn("own", F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("main"), F.col("m")).otherwise(F.col("s")), F.lit(1))))

    def up_to(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))

    with_strays = F.transform(up_to("s"), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    with_main = F.transform(up_to("m"), lambda k: F.struct(F.col("own").alias("i"), (-1 - k).alias("j")))
    from_main = F.transform(up_to("s"), lambda k: F.struct(k.alias("i"), (-1 - F.col("own")).alias("j")))
    return dealt.withColumn("g", F.explode(F.when(F.col("main"), from_main).otherwise(F.concat(with_strays, with_main)))).select("*", "g.i", "g.j").drop("g", "own", "s", "m")


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
    """Pairs of components that the matrix links, no more than it takes to connect them."""
    names, of = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, x in enumerate(of[: len(left)].tolist()):
        for y in np.unique(of[len(left) :][linked[i]]).tolist():
            if (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                out.append((names[x], names[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _compared(dealt: DataFrame, group: str, linked) -> DataFrame:
    """Pairs of components (a, b) that a block pair links. linked(rows of one side, rows of the other): a matrix."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[~rows["main"]]
        right = rows[rows["main"]] if rows["j"].iloc[0] < 0 else left
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        apart = left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
        return _forest(linked(left, right) & apart, left["component"].to_numpy(), right["component"].to_numpy())

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, group, "i", "j").groupBy(group, "i", "j").applyInPandas(run, "a long, b long")


def _near_signatures(params: Params):
    ones = np.uint64(sum(1 << k for k in range(0, 64, params.bits)))

    def linked(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        a, b = (np.array(x["signature"].tolist(), np.int64).view(np.uint64) for x in (left, right))
        apart = np.zeros((len(a), len(b)), np.int64)
        for w in range(a.shape[1]):
            x = a[:, w][:, None] ^ b[:, w][None, :]
            y = x.copy()
            for k in range(1, params.bits):
                y |= x >> np.uint64(k)
            apart += np.bitwise_count(y & ones)
        return apart <= params.most_misses

    return linked


def _near_sets(params: Params, columns: int = 20_000):
    """Exact comparison: sizes of all intersections as products of 0/1 matrices, some shingles at a time."""

    def linked(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        hasher = WordHasher()
        a = shingled(left["raw"].tolist(), hasher, params)
        b = a if right is left else shingled(right["raw"].tolist(), hasher, params)
        both = np.intersect1d(np.concatenate(a), np.concatenate(b))
        shared = np.zeros((len(a), len(b)), np.float64)
        for at in range(0, len(both), columns):
            some = both[at : at + columns]
            x, y = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
            for matrix, sets in ((x, a), (y, b)):
                for n, s in enumerate(sets):
                    place = np.minimum(np.searchsorted(some, s), len(some) - 1)
                    matrix[n, place[some[place] == s]] = 1
            shared += x @ y.T
        sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :]
        return 100 * shared >= params.percent * (sizes - shared)

    return linked


def _rest(shared: DataFrame, labels: DataFrame, texts: DataFrame, params: Params) -> DataFrame | None:
    """Links (a, b) between components that share a bucket and that stars have left apart; None where there are none.

    Signatures first tell, in each unsettled bucket, which components may belong together; components
    that may form families. In a family every member outside its largest component is compared with
    all others on full sets, once, however many buckets they share.
    """
    labelled = shared.where("n > 2").select("key", "node", "centre").join(labels.select("node", "component"), "node")
    of_centre = F.max(F.when(F.col("node") == F.col("centre"), F.col("component")))
    unsettled = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), of_centre.alias("of_centre")).where("low < high").select("key", "of_centre")
    members = labelled.join(unsettled, "key").select("key", "node", "component", (F.col("component") == F.col("of_centre")).alias("main"))
    dealt = _dealt(members, "key", params.block).join(labels.select("node", "signature"), "node")
    may = checkpointed(_compared(dealt, "key", _near_signatures(params)))
    if may.isEmpty():
        return None
    families = components(may).select(F.col("node").alias("component"), F.col("component").alias("family"))
    inside = labels.select("node", "component", "first.row_id", "first.text_hash").join(families, "component")
    largest = inside.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    inside = inside.join(largest, "family").select("family", "node", "component", "row_id", "text_hash", (F.col("component") == F.col("largest")).alias("main"))
    dealt = _dealt(inside, "family", params.block).join(texts, ["row_id", "text_hash"])
    # a row that is repeated gives its text again
    return checkpointed(_compared(dealt.dropDuplicates(["family", "node", "i", "j"]), "family", _near_sets(params)))


def near_duplicates(documents: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (least doc_id that links reach) and kept, a row for each row.

    Documents without words (null, empty, blank) have 0 shingles, link with nothing and are kept.
    Rows of a null id take part and get their component's least id (null where all are null); such a
    row is kept only where its component has no id. Of rows that repeat an id, all that carry the
    component's id are kept. Texts count whole, however long; an empty table gives no rows. Ids may be
    of any type that has an order. Other columns are not read.
    """
    drawn, labels = _labelled(documents, params)
    least = labels.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    of_node = labels.select("node", "component").join(least, "component").select("node", "component_id")
    out = drawn.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.col("set_low").alias("node")).join(of_node, "node", "left")
    component_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def without_copies(documents: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """documents with one row of each group, with all columns: that of the least id (null ids last, then the text).

    Of documents without words, which are in no group, all stay, but of rows that repeat an id and a text one.
    """
    _, labels = _labelled(documents, params)
    row, key, mark = fresh(documents, "row", "hash", "kept")
    kept = labels.groupBy("component").agg(F.min("first").alias("f")).select(F.col("f.row_id").alias(row), F.col("f.text_hash").alias(key), F.lit(True).alias(mark))
    row_id, text_hash = _row_key(documents)
    one = documents.withColumns({row: row_id, key: text_hash}).dropDuplicates([row, key])
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return one.join(kept, [row, key], "left").where(F.col(mark).isNotNull() | ~has_words).select(*documents.columns)


def _row_key(documents: DataFrame) -> tuple[Column, Column]:
    """Two longs that name a row: its id (hashed, if it is no number; its text's hash, if it is null), and its text's hash."""
    own = F.col("doc_id").cast("long") if isinstance(documents.schema["doc_id"].dataType, IntegralType) else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return F.coalesce(own, F.xxhash64("text")), F.xxhash64("text")


def _labelled(documents: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and set_low of each row; node, component and first (least row, null ids last) of each set."""
    row_id, text_hash = _row_key(documents)
    rows = documents.select("doc_id", raw_text().alias("raw"), row_id.alias("row_id"), text_hash.alias("text_hash"))
    texts = rows.select("row_id", "text_hash", "raw")
    drawn = checkpointed(rows.select("doc_id", "row_id", "text_hash", sketch(F.col("raw"), params).alias("s")).select("doc_id", "row_id", "text_hash", "s.*"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id", "text_hash")).alias("first")
    nodes = drawn.where("n_shingles > 0").groupBy(F.col("set_low").alias("node"), "set_high").agg(first, F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"))
    nodes = checkpointed(nodes.drop("set_high"))

    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    # computed anew, the key is dealt anew, so that the join can split a bucket of very many members
    buckets = buckets.withColumn("key", F.col("key").bitwiseXOR(F.lit(0)))
    shared = checkpointed(banded.join(buckets, "key"))
    stars = shared.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = checkpointed(_confirmed(stars, nodes, texts, params))

    labels = nodes.select("node", "first", "signature").join(components(links), "node", "left")
    labels = checkpointed(labels.withColumn("component", F.coalesce("component", "node")))
    if (more := _rest(shared, labels, texts, params)) is not None:
        moved = components(more).select(F.col("node").alias("component"), F.col("component").alias("to"))
        labels = labels.join(moved, "component", "left").withColumn("component", F.coalesce("to", "component"))
    return drawn, labels
