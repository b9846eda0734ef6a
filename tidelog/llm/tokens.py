"""Token counts by rank-synchronous merging of ragged numpy arrays.

A byte-level BPE applies, again and again, the merge of lowest rank that a pre-token
still offers. Here all pre-tokens of a batch advance together: one flat array holds the
symbols of all of them, one round finds each sequence's lowest-ranked adjacent pair and
merges every non-overlapping occurrence of it, left to right. A merge can only create
pairs of a higher rank, so this gives the same symbols as a priority queue. Sequences
without a mergeable pair leave the array; what is left of each is its token count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of the byte-level scheme (fixed by the public vocabulary file's format).
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a worker holds, and characters that it counts at a time.
CACHED, TEXT_STEP = 600_000, 2_000_000


#: Marks in the map of pieces: not seen yet, and blank at an end, so that its text is taken whole.
NEW, ODD = -1, -2


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str] | None:
    """The text cut before each single space, or None where the cuts could differ from the pre-tokens'.

    A pre-token never reaches over a non-blank followed by one space, so each piece can be
    tokenized alone. Runs of spaces and a blank end could join with neighbours.
    """
    if "  " in text or text.endswith(" "):
        return None
    return text.split(" ")


def ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[begin : begin + size] in a row."""
    after = np.cumsum(size)
    return flat[np.repeat(begin - (after - size), size) + np.arange(after[-1] if len(after) else 0)]


class RankMerger:
    """A byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.none, self.made_by_rank = len(pairs), made
        shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        chars = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.bytes = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.byte_ranks = self._rank(*np.meshgrid(self.bytes, self.bytes, indexing="ij"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pattern = regex.compile(PRE_TOKENS)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def counts(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte sequence after all merges."""
        out = np.ones(len(sequences), np.int64)
        for ids, lengths, _ in self._merged(sequences):
            out[ids] = lengths
        return out

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of all non-empty byte sequences in a row, and how many each has."""
        done = list(self._merged(sequences))
        if not done:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids, lengths, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(ids)
        return ragged(symbols, (np.cumsum(lengths) - lengths)[order], lengths[order]), lengths[order]

    def _merged(self, sequences: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers, lengths and symbols of the sequences, as rounds end them."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        raw = np.frombuffer(b"".join(sequences), np.uint8)
        symbols = self.bytes[raw]
        rank = np.full(len(symbols), self.none, np.int32)  # of each symbol with the next of its sequence
        rank[:-1] = self.byte_ranks[raw[:-1], raw[1:]]
        rank[np.cumsum(lengths) - 1] = self.none
        ids = np.arange(len(sequences))
        while len(ids):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, starts)
            going = lowest < self.none
            if not going.all():
                keep = np.repeat(going, lengths)
                yield ids[~going], lengths[~going], symbols[~keep]
                symbols, rank = symbols[keep], rank[keep]
                ids, lengths, lowest = ids[going], lengths[going], lowest[going]
                if not len(ids):
                    break
                starts = np.cumsum(lengths) - lengths
            where = np.flatnonzero(rank == np.repeat(lowest, lengths))
            # of hits in a row (one pair of equal symbols), every second is merged
            new_run = np.diff(where, prepend=-2) > 1
            if not new_run.all():
                run_start = where[np.flatnonzero(new_run)][np.cumsum(new_run) - 1]
                where = where[(where - run_start) % 2 == 0]
            symbols[where] = self.made_by_rank[rank[where]]
            ends = starts + lengths - 1
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            is_last = np.zeros(len(symbols), bool)
            is_last[ends] = True
            is_first = np.zeros(len(symbols), bool)
            is_first[starts] = True
            # ranks of the pairs that a merged symbol is now part of
            at_end = is_last[where + 1]
            first = is_first[where]
            lengths = np.add.reduceat(keep, starts, dtype=np.int64)
            moved = (np.cumsum(keep) - 1)[where]
            symbols, rank = symbols[keep], rank[keep]
            after, before = moved[~at_end], moved[~first]
            rank[moved[at_end]] = self.none
            rank[after] = self._rank(symbols[after], symbols[after + 1])
            rank[before - 1] = self._rank(symbols[before - 1], symbols[before])

    def units(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class Counter:
    """Token counts of texts, with the counts of pieces seen before kept in a bounded map."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.spaced: dict[str, int] = {}
        self.plain: dict[str, int] = {}

    def _learn(self, new: list[str], prefix: str) -> np.ndarray:
        if prefix:  # pieces with their spaces make a text again, and every piece begins at a unit with a space
            flat = self.merger.units(prefix + prefix.join(new))
            piece = np.cumsum(np.fromiter((u[0] == " " for u in flat), np.int64, len(flat))) - 1
        else:
            units = [self.merger.units(p) for p in new]
            flat = list(chain.from_iterable(units))
            piece = np.repeat(np.arange(len(new)), [len(u) for u in units])
        distinct = dict.fromkeys(flat)
        distinct = dict(zip(distinct, range(len(distinct)), strict=True))
        counts = self.merger.counts([u.encode("utf-8", "replace") for u in distinct])
        each = counts[np.fromiter(map(distinct.__getitem__, flat), np.int64, len(flat))]
        return np.bincount(piece, each, len(new)).astype(np.int64)

    def _known(self, known: dict[str, int], wanted: list[str], prefix: str) -> np.ndarray:
        found = np.fromiter(map(known.get, wanted, repeat(NEW)), np.int64, len(wanted))
        open_ = np.flatnonzero(found == NEW)
        own = {p: ODD if prefix and p and (p[0].isspace() or p[-1].isspace()) else len(prefix) for p in {wanted[i] for i in open_}}
        new = [p for p, n in own.items() if p and n != ODD]
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            own.update(zip(part, self._learn(part, prefix).tolist(), strict=True))
        found[open_] = [own[wanted[i]] for i in open_]
        if len(known) + len(own) > CACHED:
            known.clear()
        known.update(own)
        return found

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; special strings are one token each, null counts as empty."""
        parts: list[str] = []
        owner: list[int] = []
        out = np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts):
            cut = [text or ""]
            for special in self.merger.special:
                cut = list(chain.from_iterable(p.split(special) for p in cut)) if any(special in p for p in cut) else cut
            out[n] = len(cut) - 1
            parts += cut
            owner += [n] * len(cut)
        cuts = [pieces(p) for p in parts]
        spaced = list(chain.from_iterable(c[1:] for c in cuts if c))
        found = self._known(self.spaced, spaced, " ")
        each = np.array([len(c) - 1 if c else 0 for c in cuts], np.int64)
        ends = np.cumsum(each)
        odd = np.concatenate(([0], np.cumsum(found == ODD)))
        total = np.concatenate(([0], np.cumsum(found)))
        whole = (odd[ends] > odd[ends - each]) | np.array([c is None for c in cuts])
        sums = np.where(whole, 0, total[ends] - total[ends - each])
        plain = [self.merger.units(p) if w else c[:1] for p, c, w in zip(parts, cuts, whole, strict=True)]
        rest = np.concatenate(([0], np.cumsum(self._known(self.plain, list(chain.from_iterable(plain)), ""))))
        ends = np.cumsum([len(u) for u in plain])
        np.add.at(out, owner, sums + rest[ends] - rest[np.concatenate(([0], ends[:-1]))])
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def steps(texts: list[str | None], most: int = TEXT_STEP) -> Iterator[list[str | None]]:
    """Consecutive runs of texts of about `most` characters, so that long texts don't pile up."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_count(text: Column, vocabulary: str = "byte_bpe_50k.json") -> Column:
    """Tokens of a text column as a long column (null: 0)."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(vocabulary_path(vocabulary))
        for batch in batches:
            found = [own.count(run) for run in steps(batch.to_pylist())]
            yield pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())

    return count(text)


def count_tokens(documents: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    Null and empty texts have no bytes and no tokens. Every row gives one row, repeated rows
    and null ids included; other columns are not read. No shuffle: a scan and one Arrow step.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = documents.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
