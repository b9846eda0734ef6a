"""Document fingerprints from Lempel-Ziv phrases, and how near they are to an edited text's and the next document's.

Fingerprint: a text's UTF-8 bytes are parsed as LZ78 does: the next phrase is the longest one known so
far plus one byte, and becomes known. The set of phrases is what a compressor would have learned of the
text, so texts that help compress each other share phrases. Each phrase is hashed, and the `size` least
32-bit hashes are the fingerprint. Of two fingerprints the least hashes of both together are a sample of
the union of the phrase sets, and the share of them that both hold estimates the sets' Jaccard likeness
(exact where the union has at most `size` phrases).

Neighbours in order: each document needs the one of the next smaller id. Ids are cut into ranges by
their quantiles, every row goes to the task of its range once, and the first row of each range also to
the range before, so that a task reads its rows in order and holds two texts at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Windows

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@dataclass(frozen=True)
class Params:
    """size: hashes of a fingerprint. most_phrases: the dictionary starts anew beyond these, as a bound of memory for
    very long texts (the phrase set goes on). range_bytes, most_ranges: about how much text a task reads."""

    size: int = 128
    most_phrases: int = 1 << 20
    range_bytes: int = 16 << 20
    most_ranges: int = 10_000


class Phrases:
    """LZ78 parses of a text, and of others that begin alike."""

    STEP = 1 << 16

    def __init__(self, most: int):
        self.most, self.resets = most, 0
        self.known: dict[int, int] = {}
        self.node = 0

    def clear(self) -> None:
        self.known.clear()
        self.node = 0

    def more(self, data: bytes, at: int) -> list[int]:
        """Where the phrases of data end, data being at position `at` of the text; goes on from what was parsed."""
        known, ends = self.known, []
        # steps begin at the same places of the text, wherever data begins
        for low in [0, *range(self.STEP - at % self.STEP, len(data), self.STEP)] if data else []:
            if len(known) > self.most and (at + low) % self.STEP == 0:
                if self.node:
                    ends.append(at + low)
                self.clear()
                self.resets += 1
            # a node is its number times 256, so that node and byte are one key
            get, node, free = known.get, self.node, len(known) + 1
            for n, byte in enumerate(data[low : low + self.STEP - (at + low) % self.STEP], at + low + 1):
                key = node | byte
                node = get(key)
                if node is None:
                    known[key] = free << 8
                    free += 1
                    ends.append(n)
                    node = 0
            self.node = node
        return ends


class Fingerprints:
    """Fingerprints of texts as arrays of ascending 32-bit hashes."""

    def __init__(self, params: Params):
        self.params, self.parse, self.windows = params, Phrases(params.most_phrases), Windows()

    def _least(self, data: bytes, ends: list[int]) -> np.ndarray:
        if not ends:
            return np.empty(0, np.uint32)
        stops = np.array(ends)
        starts = np.concatenate((np.zeros(1, np.int64), stops[:-1]))
        found = np.unique((self.windows.between(np.frombuffer(data, np.uint8), starts, stops) >> np.uint64(32)).astype(np.uint32))
        return found[: self.params.size]

    def of(self, text: str) -> np.ndarray:
        data = text.encode()
        self.parse.clear()
        return self._least(data, self.parse.more(data, 0))

    def of_both(self, text: str, after: str) -> tuple[np.ndarray, np.ndarray, str]:
        """Of text and of its edited form, which begins alike and is parsed once so far; and that form."""
        most = len(text) // 3
        keep = text[: len(text) - most]
        edited = keep + after[:most]
        data, head, other = text.encode(), keep.encode(), edited.encode()
        parse = self.parse
        parse.clear()
        first, node, mark, resets = parse.more(head, 0), parse.node, len(parse.known), parse.resets
        own = self._least(data, first + parse.more(data[len(head) :], len(head)))
        if parse.resets == resets:
            while len(parse.known) > mark:
                parse.known.popitem()
            parse.node = node
        else:
            parse.clear()
            first = parse.more(head, 0)
        return own, self._least(other, first + parse.more(other[len(head) :], len(head))), edited


def likeness(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Estimated Jaccard likeness of two phrase sets from their least hashes; two empty ones are alike."""
    both = np.union1d(a, b)[:size]
    if not len(both):
        return 1.0
    return float(np.count_nonzero(np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)) / len(both))


def shown(fingerprint: np.ndarray) -> str:
    """A fingerprint as hex digits, eight a hash."""
    return fingerprint.astype(">u4").tobytes().hex()


def shown_likeness(a: str, b: str, size: int = Params.size) -> float:
    """likeness of fingerprints that shown() wrote."""
    return likeness(np.frombuffer(bytes.fromhex(a), ">u4"), np.frombuffer(bytes.fromhex(b), ">u4"), size)


@dataclass(frozen=True)
class Ranges:
    """Numbers of the ranges in descending order of id. An id that fills several ranges is split by hash; nulls come last."""

    cuts: list[int]
    first: list[int]
    parts: list[int]
    nulls: int
    total: int

    @staticmethod
    def of(cuts: list[int], nulls: int) -> Ranges:
        """cuts: quantiles in descending order; one that repeats is an id with rows for as many ranges."""
        ids, parts = [], []
        for value, group in groupby(cuts):
            ids.append(value)
            parts.append(len(list(group)))
        first, at = [], 0
        for n in parts:
            first.append(at)
            # rows above the id, then the id itself (with those above, if it needs no range of its own)
            at += 1 if n == 1 else 1 + n
        return Ranges([-v for v in ids], first, parts, max(1, nulls), at + 1 + max(1, nulls))

    def __call__(self, doc_id: int | None, key: int) -> int:
        share = lambda n: (2**63 - 1 - key) * n >> 64
        if doc_id is None:
            return self.total - self.nulls + share(self.nulls)
        n = bisect_left(self.cuts, -doc_id)
        if n == len(self.cuts):
            return self.total - self.nulls - 1
        if self.parts[n] > 1 and self.cuts[n] == -doc_id:
            return self.first[n] + 1 + share(self.parts[n])
        return self.first[n]


def in_order(documents: DataFrame, params: Params) -> DataFrame:
    """id, text and guest: rows in partitions by descending id, each with the next partition's first row at its end as a guest."""
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    n_rows, n_null, size = rows.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(1, min(params.most_ranges, -(-size // params.range_bytes)))
    shares = [n / ranges for n in range(ranges - 1, 0, -1)]
    cuts = (rows.agg(F.percentile_approx("id", shares, 10 * max(1000, ranges))).first()[0] if shares else None) or []
    deal = Ranges.of(cuts, -(-ranges * n_null // max(1, n_rows)))

    @F.arrow_udf("int")
    def number(ids: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array(map(deal, ids.to_pylist(), keys.to_pylist()), pa.int32())

    dealt = rows.withColumn("range", number("id", "key"))
    # a row for each range: the first in it by id and hash, nulls after all ids
    heads = dealt.groupBy("range").agg(F.max(F.struct(F.col("id"), F.col("key"))).alias("head")).select("range", "head.*").orderBy("range").collect()
    before = [(heads[n]["range"], heads[n]["id"], heads[n]["key"], heads[n - 1]["range"]) for n in range(len(heads))]
    heads = documents.sparkSession.createDataFrame(before, "at int, head_id long, head_key long, to int")
    guests = dealt.join(F.broadcast(heads), (F.col("range") == F.col("at")) & F.col("id").eqNullSafe(F.col("head_id")) & (F.col("key") == F.col("head_key"))).dropDuplicates(["at"])
    every = dealt.select("id", "text", "key", "range", F.lit(False).alias("guest")).unionByName(guests.select("id", "text", "key", F.col("to").alias("range"), F.lit(True).alias("guest")))
    return every.repartitionById(deal.total, F.col("range")).sortWithinPartitions("guest", F.desc_nulls_last("id"), F.desc("key")).select("id", "text", "guest")


def fingerprints(documents: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The edited text has the last third of the code points replaced by the first as many (or all) of the
    next document's: that of the next smaller id, after the least id the largest. Rows of one id follow
    each other by the hash of their text, null ids come last. Null texts count as empty; a text without
    phrases has the empty fingerprint, which is like itself (1.0) and like no other (0.0). Repeated rows
    give a row each; texts count whole, however long; an empty table gives no rows; a single row is its
    own next. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, names = Fingerprints(params), [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out: list[tuple] = []
        last, open_ = None, None

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            for doc_id, text, guest in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), batch["guest"].to_pylist(), strict=True):
                own = None
                if last is not None:
                    own, other, edited = make.of_both(last[1], text)
                    if open_ is not None:
                        out.append((*open_, likeness(open_own, own, params.size)))
                    open_own = own
                    open_ = (last[0], len(last[1]), hashlib.sha256(edited.encode()).hexdigest(), shown(own), shown(other), likeness(own, other, params.size))
                if guest:
                    out.append((*open_, likeness(open_own, make.of(text), params.size)))
                    last = open_ = None
                    continue
                last = (doc_id, text)
                if len(out) >= 1000:
                    yield sent()
        if out:
            yield sent()

    return in_order(documents, params).mapInArrow(run, SCHEMA)
