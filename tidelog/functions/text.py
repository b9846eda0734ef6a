"""Text folding and pair ratios: the two things that Spark's built-ins lack, as Arrow functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of code points that letters are counted in.
LETTERS = 32
#: Products of lengths up to which difflib itself matches.
SMALL = 250_000
#: Characters of the matching blocks that are looked for first.
RUN = 7
#: Equal runs of them, for each character of two texts, up to which they are followed.
MEETINGS = 8


def _alnum(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


FOLDS = {
    "alnum": _alnum,
    "phrase": lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()),
    "trimmed": lambda t: " ".join(t.split()).casefold(),
    "fold": str.casefold,
}


#: Texts of these characters alone are folded by built-in functions: ASCII, and the letters of Latin-1 that NFKC leaves as they
#: are, of which only the sharp s is folded to another text than its lower case.
PLAIN = r"\A[\x00-\x7F\xC0-\xFF]*\z"
#: What Python takes for blanks, of these.
BLANKS = r"[\x09-\x0D\x1C-\x20]+"
#: Texts that an Arrow function has as Python's at a time.
AT_A_TIME = 64


def _plain_fold(text: Column, mode: str) -> Column:
    """The same of PLAIN texts, by built-in functions."""
    low = F.replace(F.lower(text), F.lit("\xdf"), F.lit("ss"))
    if mode == "alnum":
        return F.regexp_replace(low, r"[\x00-/:-`{-\x7F\xD7\xF7]+", "")
    return low if mode == "fold" else F.trim(F.regexp_replace(low, BLANKS, " "))


def each_text(batches: Iterator[pa.Array], of: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """of() of each text of batches (null for a null); few of a batch's texts and results are Python's at a time."""
    for batch in batches:
        parts = (batch.slice(n, AT_A_TIME).to_pylist() for n in range(0, len(batch), AT_A_TIME))
        yield pa.concat_arrays([pa.array([], kind), *(pa.array([None if t is None else of(t) for t in part], kind) for part in parts)])


def fold_text(text: Column, mode: str) -> Column:
    """Unicode folding (null stays null). Modes: alnum (NFKC, casefold, letters and digits only), phrase
    (NFKC, casefold, single blanks), trimmed (casefold, single blanks), fold (casefold).

    PLAIN texts don't leave the JVM."""
    fold = FOLDS[mode]

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from each_text(batches, fold, pa.string())

    plain = text.rlike(PLAIN)
    return F.coalesce(F.when(plain, _plain_fold(text, mode)), run(F.when(~plain, text)))


def with_folded(df: DataFrame, name: str, text: Column, mode: str) -> DataFrame:
    """df with a column of fold_text(), worked out once a row however often and under whatever filter it is used.

    Spark copies a column's expression into the filters and lambdas that use it, but not past an explode.
    """
    return df.withColumn(name, F.explode(F.array(fold_text(text, mode))))


def grams_of(text: str, classes: int = 64) -> np.ndarray:
    """How many pairs of neighbouring characters fall in each of `classes` hash classes."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    # the upper bits of a product mix both characters
    return np.bincount((points[:-1] * np.uint32(2_654_435_761) + points[1:] * np.uint32(2_246_822_519)) >> np.uint32(16) & np.uint32(classes - 1), minlength=classes)


def gram_counts(text: Column, classes: int = 64) -> Column:
    """grams_of() of a column."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from each_text(batches, lambda t: grams_of(t, classes), pa.list_(pa.int32()))

    return run(text)


def least_shared_grams(total: Column | np.ndarray, least: float) -> Column | np.ndarray:
    """Pairs of neighbouring characters that two texts of `total` characters share at least, if their ratio is `least` or more.

    Matching blocks of M characters in all leave u = total - 2M unmatched, and one of these at least stands between
    two blocks, so there are at most u + 1 blocks; each has one pair of neighbours less than characters.
    """
    return total * least / 2 - (total * (1 - least) + 1) - 1e-6


def letters_of(text: str) -> np.ndarray:
    """How many characters fall in each of LETTERS classes of code points."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % LETTERS, minlength=LETTERS)


def letter_counts(text: Column) -> Column:
    """letters_of() of a column."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from each_text(batches, letters_of, pa.list_(pa.int32()))

    return run(text)


def shared_counts(left: Column, right: Column) -> Column:
    """An upper bound of the characters (or grams) that two texts can have in common, from their counts by class."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)


def seq_ratio(left: Column, right: Column, least: float = 0.0) -> Column:
    """Ratio of matching blocks (argument order counts), rounded to 6; null below `least` or for a null.

    Equal texts are 1. Length, the long matching blocks and the longest common subsequence bound the ratio from
    above, so most pairs end early.
    """

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            parts = ((a.slice(n, AT_A_TIME).to_pylist(), b.slice(n, AT_A_TIME).to_pylist()) for n in range(0, len(a), AT_A_TIME))
            yield pa.array([_ratio(x, y, least) for part in parts for x, y in zip(*part, strict=True)], pa.float64())

    return run(left, right)


class Coded:
    """A text's runs of RUN characters: a code of each place, and the codes above the bits of their places, sorted."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = max(len(points) - RUN + 1, 0)
        codes = points[:size]
        for k in range(1, RUN):
            codes = codes * 1_000_003 + points[k : size + k]
        codes = codes & 0x3FFFFFFF
        self.codes = codes.astype(np.int32)
        self.places = np.sort(codes << 32 | np.arange(size))
        self.marks: np.ndarray | None = None

    def marked(self) -> np.ndarray:
        """Whether the text has a code with these lowest bits; 16 to 32 times as many entries as codes."""
        if self.marks is None:
            self.marks = np.zeros(16 << len(self.codes).bit_length(), bool)
            self.marks[self.codes & len(self.marks) - 1] = True
        return self.marks


class Codes:
    """Coded of a text; those of the texts that were asked for last are kept, of up to `chars` characters."""

    def __init__(self, chars: int):
        self.left = chars
        self.held: dict[str, Coded] = {}

    def __call__(self, text: str) -> Coded:
        found = self.held.pop(text, None)
        if found is None:
            found = Coded(text)
            self.left -= len(text)
            while self.left < 0 and self.held:
                gone = next(iter(self.held))
                del self.held[gone]
                self.left += len(gone)
        self.held[text] = found
        return found


_coded = lru_cache(maxsize=16)(Coded)


def _ratio(a: str | None, b: str | None, least: float) -> float | None:
    if a is None or b is None:
        return None
    return ratios_of(a, [b], np.array([True]), least)[0]


def ratios_of(one: str, others: list[str], first: np.ndarray, least: float, coded: Callable[[str], Coded] = _coded) -> list[float | None]:
    """seq_ratio() of one text with each of the others. first: where it is the first one of the two."""
    out: list[float | None] = [1.0 if other == one else None for other in others]
    both = np.array([len(one) + len(other) for other in others])
    shorter = np.minimum(both - len(one), len(one))
    near = [n for n in np.flatnonzero(2 * shorter >= least * both).tolist() if out[n] is None]
    reached = blocks_reach(one, [others[n] for n in near], first[near], least * both[near] / 2, coded) if near else []
    for n, reaches in zip(near, reached, strict=True):
        a, b = (one, others[n]) if first[n] else (others[n], one)
        if reaches and _subsequence_reaches(a, b, least * int(both[n]) / 2):
            ratio = 2.0 * _matched(a, b) / int(both[n])
            out[n] = round(ratio, 6) if ratio >= least else None
    return out


def blocks_reach(one: str, others: list[str], first: np.ndarray, wanted: np.ndarray, coded: Callable[[str], Coded] = _coded) -> list[bool]:
    """For each of the others, False only where matching blocks can't have `wanted` characters, told from those of RUN characters or more.

    These are found as SequenceMatcher finds them, the longest first and then those on both its sides; a side without
    one counts as much as its shorter text. Texts whose runs meet too often are left to the next bound.
    """
    mine, theirs = coded(one), [coded(other) for other in others]
    chars, ends = np.array([len(x) for x in others]), np.cumsum([len(x.codes) for x in theirs])
    begins = np.concatenate(([0], ends[:-1]))
    # places of the others whose runs may be in this one, and then those that are
    codes = np.concatenate([x.codes for x in theirs])
    marks = mine.marked()
    near = np.flatnonzero(marks.take(codes & len(marks) - 1))
    codes = codes[near].astype(np.int64) << 32
    low = np.searchsorted(mine.places, codes)
    met = np.searchsorted(mine.places, codes | 0xFFFFFFFF, "right") - low
    owner = np.searchsorted(ends, near, "right")
    meetings = np.bincount(owner, met, minlength=len(others))
    told = (meetings > 0) & (meetings <= MEETINGS * (len(one) + chars))
    some = np.flatnonzero((met > 0) & told[owner])
    reached = [True] * len(others)
    if not len(some):
        return reached
    near, low, met, owner = near[some], low[some], met[some], owner[some]
    total = int(met.sum())
    own = np.repeat(owner, met)
    there = np.repeat(near - begins[owner], met)
    at = mine.places[np.arange(total) + np.repeat(low - np.cumsum(met) + met, met)] & 0xFFFFFFFF
    # places of one text that follow each other on one diagonal are one run
    most = int(chars.max())
    line = np.sort((own * (len(one) + most) + at - there + most) * (len(one) + 1) + at)
    starts = np.concatenate(([0], np.flatnonzero(line[1:] - line[:-1] != 1) + 1))
    sizes = np.concatenate((starts[1:], [total])) - starts + RUN - 1
    diagonal, i0 = np.divmod(line[starts], len(one) + 1)
    own, diagonal = np.divmod(diagonal, len(one) + most)
    j0 = i0 - diagonal + most
    turned = ~first[own]
    i0, j0 = np.where(turned, j0, i0), np.where(turned, i0, j0)
    # the first block, which is enough for most
    order = np.lexsort((j0, i0, -sizes, own))
    here = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
    n, k, i, j = (x[order[here]] for x in (own, sizes, i0, j0))
    a, b = np.where(first[n], len(one), chars[n]), np.where(first[n], chars[n], len(one))
    enough = k + np.minimum(i, j) + np.minimum(a - i - k, b - j - k) >= wanted[n] - 1e-6
    for n, k, i, j, more, low, high in zip(n.tolist(), k.tolist(), i.tolist(), j.tolist(), enough.tolist(), here.tolist(), [*here[1:].tolist(), len(own)], strict=True):
        a, b = (one, others[n]) if first[n] else (others[n], one)
        # codes may be equal by chance
        reached[n] = a[i : i + k] != b[j : j + k] or more and _runs_reach(a, b, i0[low:high], j0[low:high], sizes[low:high], wanted[n])
    return reached


def _runs_reach(a: str, b: str, i0: np.ndarray, j0: np.ndarray, sizes: np.ndarray, wanted: float) -> bool:
    """blocks_reach() of two texts with these runs: places in both, and sizes."""
    most, left = min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while left and most >= wanted - 1e-6:
        a0, a1, b0, b1 = left.pop()
        skip = np.maximum(np.maximum(a0 - i0, b0 - j0), 0)
        size = np.minimum(np.minimum(a1 - i0, b1 - j0), sizes) - skip
        k = int(size.max())
        if k < RUN:
            continue
        n = min(np.flatnonzero(size == k).tolist(), key=lambda n: (i0[n] + skip[n], j0[n] + skip[n]))
        i, j = int(i0[n] + skip[n]), int(j0[n] + skip[n])
        if a[i : i + k] != b[j : j + k]:
            return True
        most += k + min(i - a0, j - b0) + min(a1 - i - k, b1 - j - k) - min(a1 - a0, b1 - b0)
        left += [(a0, i, b0, j), (i + k, a1, j + k, b1)]
    return most >= wanted - 1e-6


def _subsequence_reaches(a: str, b: str, wanted: float) -> bool:
    """Whether the longest common subsequence, which no matching blocks exceed, has `wanted` characters; bit-parallel."""
    places: dict[str, int] = {}
    digits: dict[str, bytearray] = {}
    for i, c in enumerate(a):
        if c not in digits:
            digits[c] = bytearray(len(a) // 8 + 1)
        digits[c][i >> 3] |= 1 << (i & 7)
    for c, d in digits.items():
        places[c] = int.from_bytes(d, "little")
    full = (1 << len(a)) - 1
    open_ = full  # zeros are the ends of common subsequences
    for n, c in enumerate(b, 1):
        here = open_ & places.get(c, 0)
        if here:
            open_ = ((open_ + here) | (open_ - here)) & full
        if n % 64 == 0 and len(a) - open_.bit_count() + len(b) - n < wanted:
            return False
    return len(a) - open_.bit_count() >= wanted


def _matched(a: str, b: str) -> int:
    """Characters in SequenceMatcher's matching blocks; long texts by automata, in nearly linear time a level."""
    total, left = 0, [(a, b)]
    while left:
        a, b = left.pop()
        if len(a) * len(b) <= SMALL:
            total += sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            continue
        i, j, size = _longest_match(a, b)
        if size:
            total += size
            left += [(a[:i], b[:j]), (a[i + size :], b[j + size :])]
    return total


def _longest_match(a: str, b: str) -> tuple[int, int, int]:
    """The longest common substring, the first in a and then the first in b, by a suffix automaton of b."""
    steps: list[dict[str, int]] = [{}]
    length, link, first = [0], [-1], [0]
    last = 0
    for n, c in enumerate(b, 1):
        now = len(length)
        steps.append({})
        length.append(n)
        first.append(n)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = now
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(length)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    best, state, size = (0, 0, 0), 0, 0
    for n, c in enumerate(a, 1):
        while state and c not in steps[state]:
            state = link[state]
            size = length[state]
        if c in steps[state]:
            state = steps[state][c]
            size += 1
        else:
            size = 0
        if size > best[2]:
            best = (n - size, first[state] - size, size)
    return best
