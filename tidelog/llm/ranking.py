"""Ranked lexical search by MaxScore with bounds of term pairs.

Score of a document for an item: over the item's terms, once each, weight * impact in 64-bit integers
(a form of BM25: the weight falls with the documents that hold the term, the impact grows with its
occurrences and shrinks with the document's length).

Index: documents are dealt into blocks of bounded size. A block stores its documents' postings of the
terms that the items ask, by term, with each term's largest score, and for the pairs of terms that an
item may combine an intersection list: a bitmap of the documents that hold both, their largest joint
score, and the joint score that `most` documents of the block reach. The pairs of an item are its
neighbours in the order of weight.

Query: terms are taken one by one or as pairs. A pair's bound is the largest of its joint score and its
terms' own, which is less than their sum wherever the terms do not peak together; the disjoint pairs of
an item that tighten its bounds most are found by dynamic programming over the chain. Units whose bounds
together stay below the score of the last document in the list so far cannot bring in a new document,
so only documents of the other (essential) units are scored; of these, all are given up whose score so
far and the bounds of what is left (for a pair: the joint one only if its bitmap holds the document)
stay below it. Thresholds start at the best joint score that enough documents of any block reach.
What is given up scores less than `most` others, so the lists are those of exhaustive scoring.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import checkpointed

#: Bytes of a text to those of its terms: A-Z as a-z, ASCII that is no letter or digit as blanks.
FOLD = bytes(n + 32 if 65 <= n <= 90 else n if n >= 128 or 48 <= n <= 57 or 97 <= n <= 122 else 32 for n in range(256))
SCHEMA = "item_id long, rank int, doc_id long, score long"
COUNTED = "sizes binary, ids binary, lengths binary, starts binary, terms binary, counts binary"
INDEX = "sizes binary, ids binary, terms binary, starts binary, docs binary, impacts binary, peaks binary, pairs binary, joints binary, reached binary, both binary"


@dataclass(frozen=True)
class Params:
    """most: documents a list. block: documents of a block, at most; block_postings: its postings, at most but for one document's.
    round_bytes: bytes of the terms of the items that are searched at a time (they are broadcast)."""

    most: int = 50
    block: int = 8192
    block_postings: int = 1 << 21
    round_bytes: int = 16 << 20


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text: runs of letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return text.translate(FOLD).split() if text else []


def packed(*arrays: np.ndarray) -> list[bytes]:
    return [pa.compress(a.tobytes(), codec="lz4_raw", asbytes=True) if a.nbytes else b"" for a in arrays]


def unpacked(data: bytes, kind: type, size: int) -> np.ndarray:
    """size numbers that packed() wrote."""
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="lz4_raw"), kind) if size else np.empty(0, kind)


def row_batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f[1] == "binary" else pa.int64()) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], [f[0] for f in fields])


@dataclass(frozen=True)
class Asked:
    """Items and their terms, as numbers; a bounded part of all items."""

    items: list[int | None]
    terms: dict[bytes, int]
    of: list[np.ndarray]


def asked(items: DataFrame) -> DataFrame:
    """item_id and term, once each."""

    @F.arrow_udf("array<binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sorted(set(terms(t))) for t in batch.to_pylist()], pa.list_(pa.binary()))

    found = items.select(F.col("item_id").cast("long").alias("item_id"), run(F.col("text").cast("binary")).alias("found"))
    return found.select("item_id", F.explode("found").alias("term")).distinct()


def counted(documents: DataFrame, known: dict[bytes, int], params: Params) -> DataFrame:
    """Blocks of documents with a term: ids (with a mask of nulls in them), lengths, and counts of the known terms."""
    sent = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        ids: list = []
        lengths, starts, found, counts = [], [0], [], []

        def block() -> pa.RecordBatch:
            plain = np.array([n is not None for n in ids])
            both = np.concatenate((np.array([n or 0 for n in ids], np.int64), plain.astype(np.int64)))
            made = [both, np.array(lengths, np.int64), np.array(starts, np.int64), np.array(found, np.int32), np.array(counts, np.int32)]
            sizes = np.array([len(ids), len(found)], np.int64)
            row = [sizes.tobytes(), *packed(*made)]
            for kept in (ids, lengths, found, counts):
                kept.clear()
            starts[:] = [0]
            return row_batch([tuple(row)], COUNTED)

        for batch in batches:
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = terms(text)
                if not own:
                    continue
                each = Counter(own)
                hit = [(n, each[t]) for t in each if (n := number(t)) is not None]
                hit.sort()
                ids.append(doc_id)
                lengths.append(len(own))
                found.extend(n for n, _ in hit)
                counts.extend(c for _, c in hit)
                starts.append(len(found))
                if len(ids) >= params.block or len(found) >= params.block_postings:
                    yield block()
        if ids:
            yield block()

    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, COUNTED)


def opened(row: dict) -> tuple[np.ndarray, ...]:
    """The arrays of a block of counted()."""
    n, m = np.frombuffer(row["sizes"], np.int64).tolist()
    both = unpacked(row["ids"], np.int64, 2 * n)
    return both[:n], both[n:].astype(bool), unpacked(row["lengths"], np.int64, n), unpacked(row["starts"], np.int64, n + 1), unpacked(row["terms"], np.int32, m), unpacked(row["counts"], np.int32, m)


def statistics(blocks: DataFrame, vocabulary: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each known term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                _, _, lengths, _, found, _ = opened(row)
                held += np.bincount(found, minlength=vocabulary)
                n += len(lengths)
                total += int(lengths.sum())
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], seen))), pa.array(np.concatenate(([n, total], held[seen])))], ["term", "n"])

    found = blocks.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    sums = dict(zip(found["term"].tolist(), found["n"].tolist(), strict=True))
    return sums.get(-2, 0), sums.get(-1, 0), np.array([sums.get(t, 0) for t in range(vocabulary)], np.int64)


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What an occurrence count says in a document of a length, below its term's weight."""
    m = 50 + (50 * lengths * documents) // total
    counts = counts.astype(np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * held + 1))).astype(np.int64)


def indexed(blocks: DataFrame, chains: list[np.ndarray], weight: np.ndarray, documents: int, total: int, most: int) -> DataFrame:
    """The index: postings by term with impacts, peaks (largest scores), and the intersection lists of the chains' pairs."""
    pairs = sorted({(a, b) for chain in chains for a, b in pairwise(chain.tolist())})
    sent = blocks.sparkSession.sparkContext.broadcast((pairs, weight))

    def block(row: dict) -> tuple:
        pairs, weight = sent.value
        ids, plain, lengths, starts, found, counts = opened(row)
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(starts))
        order = np.argsort(found, kind="stable")
        docs, found = docs[order], found[order]
        impact = impacts(counts[order], lengths[docs], documents, total)
        known, firsts = np.unique(found, return_index=True)
        bounds = np.append(firsts, len(found))
        peaks = np.maximum.reduceat(impact, firsts) * weight[known] if len(known) else np.empty(0, np.int64)
        place = {t: n for n, t in enumerate(known.tolist())}
        kept, joints, reached, both = [], [], [], []
        dense, now = np.zeros(len(ids), np.int64), -1
        for n, (a, b) in enumerate(pairs):
            i, j = place.get(a), place.get(b)
            if i is None or j is None:
                continue
            if now != i:
                dense[:] = 0
                dense[docs[bounds[i] : bounds[i + 1]]] = impact[bounds[i] : bounds[i + 1]] * weight[a] + 1
                now = i
            own = docs[bounds[j] : bounds[j + 1]]
            at = dense[own]
            hit = at > 0
            if not hit.any():
                continue
            joint = at[hit] - 1 + impact[bounds[j] : bounds[j + 1]][hit] * weight[b]
            bits = np.zeros(len(ids), bool)
            bits[own[hit]] = True
            kept.append(n)
            joints.append(joint.max())
            reached.append(np.partition(joint, len(joint) - most)[len(joint) - most] if len(joint) >= most else 0)
            both.append(np.packbits(bits))
        sizes = np.array([len(ids), len(found), len(known), len(kept)], np.int64)
        lists = np.concatenate(both) if both else np.empty(0, np.uint8)
        made = packed(np.concatenate((ids, plain.astype(np.int64))), known.astype(np.int64), bounds, docs, impact.astype(np.int32), peaks, np.array(kept, np.int64), np.array(joints, np.int64), np.array(reached, np.int64), lists)
        return (sizes.tobytes(), *made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row_batch([block(row)], INDEX)

    return blocks.mapInArrow(run, INDEX)


class Block:
    """A block of the index."""

    def __init__(self, row: dict):
        n, m, t, p = np.frombuffer(row["sizes"], np.int64).tolist()
        both = unpacked(row["ids"], np.int64, 2 * n)
        self.size, self.ids, self.plain = n, both[:n], both[n:].astype(bool)
        self.bounds, self.docs, self.impact = unpacked(row["starts"], np.int64, t + 1), unpacked(row["docs"], np.int32, m), unpacked(row["impacts"], np.int32, m)
        self.place = {term: k for k, term in enumerate(unpacked(row["terms"], np.int64, t).tolist())}
        self.peaks = unpacked(row["peaks"], np.int64, t).tolist()
        self.pairs = {pair: k for k, pair in enumerate(unpacked(row["pairs"], np.int64, p).tolist())}
        self.joints, self.reached = unpacked(row["joints"], np.int64, p).tolist(), unpacked(row["reached"], np.int64, p)
        self.both = unpacked(row["both"], np.uint8, p * ((n + 7) // 8)).reshape(p, -1) if p else np.empty((0, 0), np.uint8)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.place[term]
        low, high = self.bounds[k], self.bounds[k + 1]
        return self.docs[low:high], self.impact[low:high]


def combined(chain: list[int], block: Block, numbers: dict[tuple[int, int], int]) -> list[tuple[int, tuple[int, ...], int, int, int | None]]:
    """Units (bound, terms, bound where the documents lack a pair's one or other term, joint bound, the pair's list or None)
    of the terms that the block has: the disjoint pairs along the chain whose bounds together are least."""
    peaks = [block.peaks[block.place[t]] if t in block.place else 0 for t in chain]
    least, choice = [0], []
    for k, peak in enumerate(peaks):
        alone = least[-1] + peak
        if k and peak and peaks[k - 1]:
            pair = block.pairs.get(numbers[chain[k - 1], chain[k]])
            single = max(peak, peaks[k - 1])
            joint = single if pair is None else max(block.joints[pair], single)
            if least[-2] + joint < alone:
                least.append(least[-2] + joint)
                choice.append((joint, (chain[k - 1], chain[k]), single, joint, pair))
                continue
        least.append(alone)
        choice.append((peak, (chain[k],), peak, peak, None))
    units, k = [], len(chain)
    while k:
        unit = choice[k - 1]
        k -= len(unit[1])
        if unit[0]:
            units.append(unit)
    units.sort(key=lambda u: u[0])
    return units


def searched(block: Block, chain: list[int], numbers: dict[tuple[int, int], int], weight: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (by place in the block) that may reach floor, with their scores; none of those left out does."""
    units = combined(chain, block, numbers)
    ahead = np.cumsum([u[0] for u in units])
    # units that cannot bring in a document by themselves
    idle = int(np.searchsorted(ahead, floor)) if floor > 0 else 0
    score = np.zeros(block.size, np.int64)
    for _, each, *_ in units[idle:]:
        for term in each:
            docs, impact = block.list_of(term)
            score[docs] += impact * weight[term]
    at = np.flatnonzero(score)
    rest = units[:idle]
    if idle and len(at):
        # what each document can still gain, with the pairs' lists
        gains = []
        for _, _, single, joint, pair in rest:
            gain = np.full(len(at), single, np.int64)
            if pair is not None and joint > single:
                gain[np.unpackbits(block.both[pair], count=block.size)[at] > 0] = joint
            gains.append(gain)
        left = np.cumsum(gains, axis=0)
        for n in range(idle - 1, -1, -1):
            alive = score[at] + left[n] >= floor
            if not alive.all():
                at, left = at[alive], left[:, alive]
            if not len(at):
                break
            for term in rest[n][1]:
                docs, impact = block.list_of(term)
                k = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
                hit = docs[k] == at
                score[at[hit]] += impact[k[hit]] * weight[term]
    found = score[at]
    best = found >= max(floor, 1)
    return at[best], found[best]


def kept(rows: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """The first rows (scores, null marks, ids) by score, then id, null ids last."""
    score, null, ids = (np.concatenate(c) for c in zip(*rows, strict=True))
    first = np.lexsort((ids, null, -score))[:most]
    return score[first], null[first], ids[first]


def ranked(index: DataFrame, part: Asked, chains: list[np.ndarray], weight: np.ndarray, most: int) -> DataFrame:
    """item_id, doc_id and score of each task's best documents for each item."""
    pairs = sorted({(a, b) for chain in chains for a, b in pairwise(chain.tolist())})
    numbers = {pair: n for n, pair in enumerate(pairs)}
    context = index.sparkSession.sparkContext

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(pairs), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                p = int(np.frombuffer(row["sizes"], np.int64)[3])
                own = unpacked(row["pairs"], np.int64, p)
                best[own] = np.maximum(best[own], unpacked(row["reached"], np.int64, p))
        at = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[at])], ["pair", "reached"])

    # enough documents of one block score as much for a pair, so the item's list ends no lower
    reached = np.zeros(len(pairs), np.int64)
    for row in index.select("sizes", "pairs", "reached").mapInArrow(tops, "pair long, reached long").groupBy("pair").agg(F.max("reached").alias("reached")).collect():
        reached[row["pair"]] = row["reached"]
    floors = [max((int(reached[numbers[p]]) for p in pairwise(chain.tolist())), default=0) for chain in chains]
    sent = context.broadcast(([c.tolist() for c in chains], numbers, weight, floors, part.items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, numbers, weight, floors, items = sent.value
        floors, lists = list(floors), [None] * len(chains)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for k, chain in enumerate(chains):
                    at, score = searched(block, chain, numbers, weight, floors[k])
                    if len(at):
                        new = (score, ~block.plain[at], block.ids[at])
                        lists[k] = kept([new] if lists[k] is None else [lists[k], new], most)
                        if len(lists[k][0]) == most:
                            floors[k] = max(floors[k], int(lists[k][0][-1]))
        for k, found in enumerate(lists):
            if found is not None:
                ids = pa.array(found[2], mask=found[1])
                yield pa.RecordBatch.from_arrays([pa.array([items[k]] * len(ids), pa.int64()), ids, pa.array(found[0])], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def rounds(items: DataFrame, size: int) -> Iterator[Asked]:
    """The items with their terms, in parts of about size bytes of terms."""
    each = checkpointed(asked(items))
    total = each.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0))).first()[0]
    parts = max(1, -(-total // size))
    for n in range(parts if total else 0):
        rows: pd.DataFrame = each.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == n).toPandas()
        found = {t: k for k, t in enumerate(sorted({bytes(t) for t in rows["term"]}))}
        own: dict[int | None, list[int]] = {}
        for item, term in zip(rows["item_id"].tolist(), rows["term"], strict=True):
            own.setdefault(None if item is None or item != item else int(item), []).append(found[bytes(term)])
        if own:
            yield Asked(list(own), found, [np.array(sorted(t)) for t in own.values()])


def search(documents: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """item_id, rank (from 1), doc_id and score of each item's highest-scoring documents with a score above 0.

    Equal scores are ranked by doc_id, null ids last. Null and empty texts have no terms: such documents
    count for nothing and such items get no rows. Rows that repeat an item's id are one item with the
    terms of all; documents that repeat an id or a text are ranked each. Texts count whole, however
    long; empty tables give no rows. Only doc_id, text and item_id are read, so other columns may have
    any name. Items are searched in parts whose terms stay below a stated size, as these are broadcast.
    """
    out = None
    for part in rounds(items, params.round_bytes):
        blocks = checkpointed(counted(documents, part.terms, params))
        n, total, held = statistics(blocks, len(part.terms))
        if not n:
            break
        weight = weights(n, held)
        # terms that all or no documents hold score nothing
        chains = [own[np.lexsort((own, weight[own]))] for own in (o[(weight[o] > 0) & (held[o] > 0)] for o in part.of)]
        index = checkpointed(indexed(blocks, chains, weight, n, total, params.most))
        found = ranked(index, part, chains, weight, params.most)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.most).select("item_id", "rank", "doc_id", "score")
