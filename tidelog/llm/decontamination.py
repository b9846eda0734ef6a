"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a seed of `seed` words are compared by tiling: the longest
common run of words that are not marked yet, in either text, becomes a tile and is marked, then the
next longest, down to `least` words. Runs of a length are found by Karp-Rabin hashes and confirmed
word by word. The share of the item's words in tiles is its coverage; as tiles may lie in any order,
a passage whose sentences were reordered is covered as well.

Words are runs of letters and digits, lower case, so punctuation and symbols put between don't hide
a passage. Items of fewer than `seed` words are no evidence and match nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Windows, WordHasher, fresh, gram_hashes

WORD = re.compile(r"[^\W_]+")
MATCH = "struct<coverage:double,matched:long,item_words:long,tiles:array<struct<doc_word:long,item_word:long,length:long>>>"


@dataclass(frozen=True)
class Params:
    seed: int = 5
    least: int = 4
    coverage: float = 0.6
    #: Bytes of seeds and runs (40 each) and item texts up to which the benchmark is sent to all tasks; beyond, both meet in shuffled joins.
    most_sent: int = 32_000_000


def tokens(text: str | None) -> list[bytes]:
    return [w.encode() for w in WORD.findall(text.lower())] if text else []


def _open(free: np.ndarray, length: int) -> np.ndarray:
    """Whether each window of a length is free."""
    total = np.concatenate(([0], np.cumsum(free)))
    return total[length:] - total[:-length] == length


def _longest(free: np.ndarray) -> int:
    """Length of the longest run of free places."""
    ends = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
    return int((ends[1::2] - ends[::2]).max(initial=0))


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length) of two arrays of word hashes, longest first, then by place in doc.

    The Karp-Rabin hashes of all windows of a length come from one running sum, so that the longest
    length with a match in free places is found by bisection: the time is that of sorting, for each
    length that tiles have (at most the root of twice the words) and each step of the bisection.
    """
    if len(doc) < least or len(item) < least:
        return []
    # only places in runs whose least-length hashes are the item's can be in a tile; a closed place stands between runs
    windows = Windows()
    inside = np.zeros(len(doc) + 1, np.int64)
    starts = np.flatnonzero(np.isin(windows(doc, least), windows(item, least)))
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + least, -1)
    place = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    if not len(place):
        return []
    gaps = np.flatnonzero(np.diff(place) > 1) + 1
    place = np.insert(place, gaps, -1)
    free_doc, free_item = place >= 0, np.ones(len(item), bool)
    text = doc[place]

    def of_length(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and places of the free windows of both sides that have a match."""
        p, q = np.flatnonzero(_open(free_doc, length)), np.flatnonzero(_open(free_item, length))
        a, b = windows(text, length)[p], windows(item, length)[q]
        in_b, in_a = np.isin(a, b), np.isin(b, a)
        return a[in_b], p[in_b], b[in_a], q[in_a]

    out = []
    most = min(_longest(free_doc), _longest(free_item))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(of_length(middle)[0]) else (low, middle - 1)
        if low < least:
            break
        a, p, b, q = of_length(low)
        waiting: dict[int, list[int]] = defaultdict(list)
        for h, at in zip(b[::-1].tolist(), q[::-1].tolist(), strict=True):
            waiting[h].append(at)
        for h, at in zip(a.tolist(), p.tolist(), strict=True):
            if not free_doc[at] or not free_doc[at : at + low].all():
                continue
            found = waiting[h]
            while found and not free_item[found[-1] : found[-1] + low].all():
                found.pop()  # what is marked stays marked
            if found and (text[at : at + low] == item[found[-1] : found[-1] + low]).all():
                free_doc[at : at + low], free_item[found[-1] : found[-1] + low] = False, False
                out.append((int(place[at]), found.pop(), low))
        most = min(low - 1, _longest(free_doc), _longest(free_item))
    return out


def _match(text: Column, item: Column, params: Params) -> Column:
    @F.arrow_udf(MATCH)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        kind = pa.struct([("coverage", pa.float64()), ("matched", pa.int64()), ("item_words", pa.int64()), ("tiles", pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("length", pa.int64())])))])
        for texts, items in batches:
            out = []
            for text, item in zip(texts, items, strict=True):
                doc, test = (hasher(tokens(x.as_py())) for x in (text, item))
                tiles = tile(doc, test, params.least)
                matched = sum(n for _, _, n in tiles)
                out.append({"coverage": matched / max(1, len(test)), "matched": matched, "item_words": len(test), "tiles": [{"doc_word": a, "item_word": b, "length": n} for a, b, n in sorted(tiles)]})
            yield pa.array(out, kind)

    return run(text, item)


def _seeds(text: Column, params: Params) -> Column:
    """Distinct seed hashes of a text."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for batch in batches:
            yield pa.array([np.unique(gram_hashes(hasher(tokens(t.as_py())), params.seed)).view(np.int64) for t in batch], pa.list_(pa.int64()))

    return run(text)


def _runs(text: Column, params: Params) -> Column:
    """Hashes of the runs of `least` words of a text, by place."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for batch in batches:
            yield pa.array([gram_hashes(hasher(tokens(t.as_py())), params.least).view(np.int64) for t in batch], pa.list_(pa.int64()))

    return run(text)


@dataclass(frozen=True)
class Items:
    """What every task knows of a small benchmark: seeds (sorted) and runs (sorted) with the places of their items in
    numbers, places of runs, and each item's number and words."""

    seeds: np.ndarray
    seed_item: np.ndarray
    runs: np.ndarray
    run_item: np.ndarray
    run_place: np.ndarray
    numbers: np.ndarray
    words: np.ndarray


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places from each low to before its high."""
    size = high - low
    return np.repeat(high - np.cumsum(size), size) + np.arange(size.sum())


def _sharing(text: Column, items: Items, params: Params) -> Column:
    """Numbers of the items that share a seed with a text and that it may cover.

    Every tile lies in runs of `least` words that both have, so the item's words in such runs bound its coverage; a
    line that all texts have does not bring all items in.
    """

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for batch in batches:
            out = []
            for text in batch:
                hashes = hasher(tokens(text.as_py()))
                own = np.unique(gram_hashes(hashes, params.seed)).view(np.int64)
                found = np.unique(items.seed_item[_ranges(np.searchsorted(items.seeds, own, "left"), np.searchsorted(items.seeds, own, "right"))])
                if len(found):
                    own = np.unique(gram_hashes(hashes, params.least)).view(np.int64)
                    at = _ranges(np.searchsorted(items.runs, own, "left"), np.searchsorted(items.runs, own, "right"))
                    place = np.unique((items.run_item[at] << 32)[:, None] + items.run_place[at][:, None] + np.arange(params.least))
                    covered = np.bincount(place >> 32, minlength=len(items.words))
                    found = found[covered[found] >= params.coverage * items.words[found] - 1e-9]
                out.append(items.numbers[found])
            yield pa.array(out, pa.list_(pa.int64()))

    return run(text)


def _known(items: DataFrame, params: Params) -> Items:
    """items (item_text, number) of a benchmark of bounded size, as arrays."""
    got = items.select("number", _seeds(F.col("item_text"), params).alias("seeds"), _runs(F.col("item_text"), params).alias("runs")).where(F.size("seeds") > 0).orderBy("number").toArrow()
    seeds, runs = (got.column(c).combine_chunks() for c in ("seeds", "runs"))
    each = np.arange(got.num_rows, dtype=np.int64)
    sizes = runs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    seed, seed_item = seeds.flatten().to_numpy(), np.repeat(each, seeds.value_lengths().to_numpy(zero_copy_only=False))
    run, run_item = runs.flatten().to_numpy(), np.repeat(each, sizes)
    place = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    by_seed, by_run = np.argsort(seed, kind="stable"), np.argsort(run, kind="stable")
    return Items(seed[by_seed], seed_item[by_seed], run[by_run], run_item[by_run], place[by_run], got.column("number").to_numpy(), sizes + params.least - 1)


def matches(documents: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, item_id, coverage, matched, item_words and tiles of each document and item that it covers.

    A row for each pair of a row and an item with coverage >= params.coverage; null, empty and short
    texts match nothing, repeated rows match each, null ids are carried along, and an item row that is
    repeated counts once. Texts count whole, however long; an empty table on either side gives no rows.
    Only the ids and texts are read, so other columns may have any name, those of the result too.
    """
    items = benchmark.select("item_id", F.col("text").alias("item_text")).distinct()
    seeds = items.select("item_id", "item_text", F.explode(_seeds(F.col("item_text"), params)).alias("seed"))
    texts = documents.select("doc_id", "text")
    size = seeds.agg(F.count("*") * 40).first()[0] + (items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0)
    if size <= params.most_sent:
        # the benchmark is small: its seeds go to every task, and a document meets them where it is read
        named = items.withColumn("number", F.xxhash64("item_id", "item_text"))
        found = _sharing(F.col("text"), _known(named, params), params)
        # dealt anew, so that a part of the table with many hits, or copies of one, is no single task's tiling
        parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = texts.withColumn("number", F.explode(found)).repartition(parts).join(F.broadcast(named), "number")
    else:
        keyed = texts.withColumn("row_key", F.xxhash64("doc_id", "text"))
        own = keyed.select("row_key", F.explode(_seeds(F.col("text"), params)).alias("seed"))
        named = items.withColumn("number", F.xxhash64("item_id", "item_text"))
        found = own.join(seeds.select("seed", F.xxhash64("item_id", "item_text").alias("number")), "seed").select("row_key", "number").distinct()
        pairs = keyed.join(found, "row_key").join(named, "number")
    scored = pairs.select("doc_id", "item_id", _match(F.col("text"), F.col("item_text"), params).alias("m")).select("doc_id", "item_id", "m.*")
    return scored.where(F.col("coverage") >= params.coverage)


def without_matches(documents: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """The rows of documents whose text matches no item; all of their columns."""
    own, key = fresh(documents, "hash", "key")
    found = matches(documents.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark, params).select(F.col("doc_id").alias(key)).distinct()
    return documents.withColumn(own, F.xxhash64("text")).join(found, F.col(own) == F.col(key), "left_anti").drop(own)
