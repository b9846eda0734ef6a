"""Packing of documents into training sequences by order-preserving dynamic programming.

The documents of a partition, in their order, are one stream of tokens. A window may end at
the end of a document (free), at the end of a sentence (a small penalty), or, where a sentence
is long, at a fixed step inside it (a larger one). With best[i] the least cost of all that is
before the boundary at position at[i],

    best[i] = penalty[i] + size - at[i] + min(best[j] + at[j])   over at[i] - size <= at[j] < at[i],

whose minimum a monotone queue gives in constant time a boundary; a window whose length is a
power of two needs no padding, which adds a few transitions best[j] + penalty[i]. Every task
packs its own rows, so nothing is shuffled, and a task that is run again gives the same rows.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tokens import RankMerger, pieces, ragged, steps, vocabulary_path

#: Pieces whose ids a worker holds; characters encoded, and tokens packed, at a time.
CACHED, TEXT_STEP, TOKEN_STEP = 450_000, 2_000_000, 1_000_000
SENTENCE_ENDS = frozenset(".!?…。！？")
END = "  "
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Costs:
    """Penalties in padding tokens, and the step of the boundaries inside long sentences."""

    sentence: float = 1.0
    inside: float = 8.0
    step: int = 64


class Encoder:
    """Ids of texts, the same as the tokenizers library's; each distinct piece of text is merged once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = RankMerger(path)
        self.forget()

    def forget(self) -> None:
        """Give up the pieces that are held."""
        self.known: dict[str, int] = {END: 0}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used, self.slots = 1, 1
        # where a slot's ids begin, how many there are, and after how many a sentence ends (0: nowhere)
        self.begin, self.size, self.stop = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.size[0] = 1

    def _add(self, ids: np.ndarray, sizes: np.ndarray, stops: np.ndarray) -> None:
        total, n = len(ids), len(sizes)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.slots + n > len(self.begin):
            self.begin, self.size, self.stop = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.stop))
        at = slice(self.slots, self.slots + n)
        self.ids[self.used : self.used + total] = ids
        self.begin[at], self.size[at], self.stop[at] = self.used + np.cumsum(sizes) - sizes, sizes, stops
        self.used, self.slots = self.used + total, self.slots + n

    def _add_pieces(self, texts: list[str], units: list[str], piece: np.ndarray) -> None:
        """New slots for pieces of text; piece: the number of the text that a unit is in."""
        distinct = dict.fromkeys(units)
        distinct = dict(zip(distinct, range(len(distinct)), strict=True))
        flat, lengths = self.merger.merge([u.encode("utf-8", "replace") for u in distinct])
        unit = np.fromiter(map(distinct.__getitem__, units), np.int64, len(units))
        size = lengths[unit]
        sizes = np.bincount(piece, size, len(texts)).astype(np.int64)
        stops = np.where(np.fromiter((t[-1:] in SENTENCE_ENDS for t in texts), bool, len(texts)), sizes, 0)
        # a line that ends inside a piece
        before = np.cumsum(size) - size - np.repeat(np.cumsum(sizes) - sizes, np.bincount(piece, minlength=len(texts)))
        breaks = np.flatnonzero(np.fromiter((u[0] == "\n" for u in units), bool, len(units)) & (before > 0))[::-1]
        stops[piece[breaks]] = before[breaks]
        self._add(ragged(flat, (np.cumsum(lengths) - lengths)[unit], size), sizes, stops)

    def _sentences(self, text: str) -> list[np.ndarray]:
        """The library's ids of a whole text, cut where sentences end."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ends = [n for n, (_, b) in enumerate(found.offsets, 1) if b and text[b - 1] in SENTENCE_ENDS and (b == len(text) or text[b].isspace())]
        return [part for part in np.split(np.array(found.ids, np.uint32), ends) if len(part)]

    def encode(self, texts: list[str | None], alone: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, with an id 0 after each text; the texts' ends; and the ends of sentences among them.

        alone: numbers of the texts that the library takes as a whole.
        """
        if self.slots > CACHED:
            self.forget()
        keys: list[str] = []
        whole: dict[str, np.ndarray] = {}
        for n, text in enumerate(texts):
            cut = pieces(text or "")
            if cut is None or n in alone or any(s in text for s in self.merger.special if text):
                own_keys = {f" {n} {k} ": ids for k, ids in enumerate(self._sentences(text))}
                whole |= own_keys
                keys += (*own_keys, END)
            else:
                cut[0] += " "
                keys += cut
                keys.append(END)
        slots = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        open_ = np.flatnonzero(slots < 0)
        new = list(dict.fromkeys([keys[i] for i in open_]))
        spaced = [k for k in new if k[-1:] != " "]
        if odd := {k for k in spaced if k and (k[0].isspace() or k[-1].isspace())}:  # may join with blanks beside it
            return self.encode(texts, alone.union(n for n, t in enumerate(texts) if not odd.isdisjoint((t or "").split(" "))))
        plain = [k[:-1] for k in new if k[-1:] == " " and k not in whole]
        own: dict[str, int] = {}
        for at in range(0, len(spaced), 100_000):
            part = spaced[at : at + 100_000]
            units = self.merger.units(" " + " ".join(part))
            own.update(zip(part, range(self.slots, self.slots + len(part)), strict=True))
            self._add_pieces(part, units, np.cumsum(np.fromiter((u[0] == " " for u in units), np.int64, len(units))) - 1)
        if plain:
            units = [self.merger.units(p) for p in plain]
            own.update(zip([p + " " for p in plain], range(self.slots, self.slots + len(plain)), strict=True))
            self._add_pieces(plain, list(chain.from_iterable(units)), np.repeat(np.arange(len(plain)), [len(u) for u in units]))
        self.known.update(own)
        if whole:
            sizes = np.array([len(ids) for ids in whole.values()], np.int64)
            own.update(zip(whole, range(self.slots, self.slots + len(whole)), strict=True))
            self._add(np.concatenate(list(whole.values())), sizes, sizes)
        slots[open_] = [own[keys[i]] for i in open_]
        size = self.size[slots]
        after = np.cumsum(size)
        stop = self.stop[slots]
        return ragged(self.ids, self.begin[slots], size), after[slots == 0], (after - size + stop)[stop > 0]


def optimal_cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Positions at which windows end, of least padding and penalties.

    at: rising positions of the boundaries, the last one the stream's end, at most `size` apart;
    penalty: of a cut there. The stream begins at 0.
    """
    spots = np.concatenate(([0], at))
    jumps: dict[int, list[int]] = {}
    length = 16
    while length < size:
        j = np.searchsorted(spots, spots - length)
        for i in np.flatnonzero(spots[np.minimum(j, len(spots) - 1)] == spots - length):
            jumps.setdefault(int(i), []).append(int(j[i]))
        length *= 2
    where, extra = spots.tolist(), np.concatenate(([0.0], penalty)).tolist()
    best, back, keys = [0.0] * len(where), [0] * len(where), [0.0] * len(where)
    queue = deque([0])
    for i in range(1, len(where)):
        here = where[i]
        while where[queue[0]] < here - size:
            queue.popleft()
        j = queue[0]
        cost = keys[j] + size - here
        if i in jumps:
            for k in jumps[i]:
                if best[k] < cost:
                    cost, j = best[k], k
        best[i] = cost = cost + extra[i]
        back[i] = j
        keys[i] = key = cost + here
        while queue and keys[queue[-1]] > key:
            queue.pop()
        queue.append(i)
    cuts, i = [], len(where) - 1
    while i > 0:
        cuts.append(where[i])
        i = back[i]
    return cuts[::-1]


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, size: int, costs: Costs, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end, and at what penalty."""
    cost = {costs.inside: np.empty(0, np.int64), costs.sentence: sentence_ends, 0.0: doc_ends}
    known = np.union1d(sentence_ends, np.append(doc_ends, total))
    gaps = np.diff(known, prepend=0)
    more = (gaps - 1) // costs.step
    long = np.flatnonzero(more > 0)
    n = more[long]
    inner = np.repeat(known[long] - gaps[long], n) + costs.step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
    if last:  # the end of the stream can be cut anywhere, into powers of two
        inner = np.append(inner, np.arange(max(1, total - size), total))
    at = np.union1d(known, inner)
    at = at[at > 0]
    penalty = np.full(len(at), costs.inside)
    for value, ends in list(cost.items())[1:]:
        penalty[np.isin(at, ends, assume_unique=False)] = value
    penalty[-1] = 0.0
    return at, penalty


class Packer:
    """Packs a stream of documents that comes in steps; the last window of a step waits for the next one."""

    def __init__(self, size: int, costs: Costs, first_sequence: int):
        self.size, self.costs, self.sequence = size, costs, first_sequence
        self.ids, self.sentences = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.docs, self.starts, self.ends = [], np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, doc_ids: list, ids: np.ndarray, ends: np.ndarray, sentences: np.ndarray) -> None:
        base = len(self.ids)
        self.docs = self.docs + doc_ids
        self.starts = np.concatenate([self.starts, base + np.concatenate(([0], ends[:-1]))[: len(ends)]])
        self.ends = np.concatenate([self.ends, base + ends])
        self.sentences = np.concatenate([self.sentences, base + sentences])
        self.ids = np.concatenate([self.ids, ids])

    def pack(self, last: bool) -> tuple[list, list[np.ndarray]]:
        """Document ids and the other columns of the pieces that are settled now."""
        total = len(self.ids)
        if not total:
            return [], [np.empty(0, np.int64)] * 6
        cuts = np.array(optimal_cuts(*boundaries(self.ends, self.sentences, total, self.size, self.costs, last), self.size), np.int64)
        if not last:
            cuts = cuts[:-1]
        done = int(cuts[-1]) if len(cuts) else 0
        a = np.concatenate(([0], np.union1d(cuts, self.ends[self.ends < done])))[:-1] if done else np.empty(0, np.int64)
        b = np.append(a[1:], done) if done else a
        doc = np.searchsorted(self.ends, a, side="right")
        window = np.searchsorted(cuts, a, side="right")
        crc = np.array([zlib.crc32(self.ids[x:y].tobytes()) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        out = [a - self.starts[doc], b - a, crc, (self.ends - self.starts)[doc], self.sequence + window, a - np.concatenate(([0], cuts))[window]]
        ids = [self.docs[n] for n in doc.tolist()]
        self.sequence += len(cuts)
        keep = int(np.searchsorted(self.ends, done, side="right"))
        self.docs, self.starts, self.ends = self.docs[keep:], self.starts[keep:] - done, self.ends[keep:] - done
        self.ids, self.sentences = self.ids[done:].copy(), self.sentences[self.sentences > done] - done
        return ids, out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(documents: DataFrame, size: int = 1024, vocabulary: str = "byte_bpe_50k.json", costs: Costs = Costs(), forget: bool = False) -> DataFrame:  # noqa: B008
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document is its ids and a 0; null and empty texts are the 0 alone. Repeated rows are packed
    once each, null ids stay null, an empty table gives no rows, and other columns are not read.
    Sequence ids are unique over the table: a partition's number times 2^32, plus a counter.
    Memory: the ids of TOKEN_STEP tokens, or of one text where that is longer. forget: whether a task gives
    up the pieces of text that it holds, which the next one in its worker would find there otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary_path(vocabulary))
        packer = Packer(size, costs, TaskContext.get().partitionId() << 32)

        def settled(last: bool) -> pa.RecordBatch:
            ids, columns = packer.pack(last)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in steps(batch.column("text").to_pylist(), TEXT_STEP):
                packer.add(ids[at : at + len(texts)], *own.encode(texts))
                at += len(texts)
                if len(packer.ids) >= TOKEN_STEP:
                    yield settled(False)
        if forget:
            own.forget()
        yield settled(True)

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def padding(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """sequences, tokens and padded: how much padding the packed sequences need."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.bit_count("n") == 1
    return filled.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(~whole, size - F.col("n")).otherwise(0)).alias("padded"))
