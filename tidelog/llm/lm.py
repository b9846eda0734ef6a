"""Scores of a log-bilinear language model trained with noise-contrastive estimation.

Tokens are words and an end. Outputs of the network (units) are the most frequent tokens, whose number
grows with the root of the training tokens, and groups of the others by their last two bytes; a word's
probability is its unit's, times its share (with add-half smoothing) in its group. The context vector is
the sum over the last `context` units of their vectors times weights of the position.

A unit's probability has two levels: that of its class, and its own in the class. Classes are runs of
units in the order of frequency, as many as the root of their number and about equally frequent, so that
a token costs twice that root of products. On both levels a score is the context vector's product with an
output vector, plus a bias, and scoring normalises over all classes and over all units of the class.

Training: a short start on the driver over a bounded sample, then the training documents are dealt by a
hash into parts, whose number follows from their tokens alone. A task goes once over all of its part
from there, in the order of the hash, and the parts' parameters are averaged, weighted by tokens. So the
model does not depend on how the table is laid out in files. Noise comes from the frequencies of classes,
and of units in their class; it is shared by a batch.

Counts are of all training tokens. The `sent` most frequent words' go to every task; the rest of a
document's words meet theirs in a shuffled join, and so do words longer than `longest` bytes, which have
no units of their own either: what comes to the driver is bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpointed, first_by_hash, raw_text

END = b""
#: Parameters in a row of a task's result.
BLOCK = 16_384
PART = "task long, part long, part_values binary, n long"


@dataclass(frozen=True)
class Params:
    #: Units that are words: head_rate times the root of the training tokens, within the two bounds.
    head_rate: float = 0.5
    least_head: int = 240
    most_head: int = 200_000
    endings: int = 48
    context: int = 4
    size: int = 16
    noise: int = 32
    inner_noise: int = 8
    batch: int = 16384
    score_batch: int = 32768
    start_batch: int = 512
    rate: float = 0.15
    start_documents: int = 1500
    start_bytes: int = 8_000_000
    start_rounds: int = 3
    #: Parts that train, each with parameters of its own: the root of the training tokens over this.
    part_root: int = 128
    sent: int = 200_000
    #: Bytes of a word that the driver and every task may hold.
    longest: int = 128


@dataclass
class Units:
    """Numbers of head words, of groups by ending and of the group of all other endings, by falling frequency; first unit of each class."""

    head: dict[bytes, int]
    endings: dict[bytes, int]
    other: int
    frequency: np.ndarray
    starts: np.ndarray

    @classmethod
    def of_counts(cls, head: dict[bytes, int], endings: dict[bytes, int], other: int) -> Units:
        counted = [*((c, 0, w) for w, c in head.items()), *((c, 1, e) for e, c in endings.items()), (other, 2, b"")]
        counted.sort(key=lambda x: (-x[0], x[1:]))
        frequency = np.array([c for c, _, _ in counted], float) + 1
        frequency /= frequency.sum()
        names: list[dict[bytes, int]] = [{}, {}, {}]
        for n, (_, kind, key) in enumerate(counted):
            names[kind][key] = n
        classes = int(np.ceil(np.sqrt(len(counted))))
        starts = np.unique(np.searchsorted(np.cumsum(frequency), np.arange(classes) / classes, side="right"))
        return cls(names[0], names[1], names[2][b""], frequency, starts)

    def of(self, found: pa.Array) -> np.ndarray:
        """The units of words (binary)."""
        at = pc.fill_null(pc.index_in(found, pa.array(self.head.keys(), pa.binary())), len(self.head)).to_numpy()
        unit = np.fromiter((*self.head.values(), -1), np.int32, len(self.head) + 1)[at]
        rest = np.flatnonzero(unit < 0)
        ending = pc.dictionary_encode(pc.binary_slice(found.take(pa.array(rest)), -2))
        named = ending.dictionary.to_pylist()
        unit[rest] = np.fromiter((self.endings.get(e, self.other) for e in named), np.int32, len(named))[ending.indices.to_numpy()]
        return unit

    @property
    def count(self) -> int:
        return len(self.frequency)


def tokens_of(raw: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-cased words of texts and the end, all texts' tokens as numbers of these, an end behind each text, and each text's number of tokens."""
    texts = pc.fill_null(raw, b"").view(pa.large_string() if pa.types.is_large_binary(raw.type) else pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    of_text = np.repeat(np.arange(len(raw)), pc.list_value_length(lists).to_numpy())
    encoded = pc.dictionary_encode(lists.flatten())
    code, distinct = encoded.indices.to_numpy(), encoded.dictionary.cast(pa.binary())
    # blanks around a text leave empty words, which are no tokens; the empty word is the end
    empty = np.flatnonzero(pc.binary_length(distinct).to_numpy() == 0)
    if len(empty):
        full = code != empty[0]
        code, of_text = code[full], of_text[full]
    else:
        distinct = pa.concat_arrays([distinct, pa.array([END], pa.binary())])
    out = np.full(len(code) + len(raw), empty[0] if len(empty) else len(distinct) - 1, np.int32)
    out[np.arange(len(code)) + of_text] = code
    return distinct, out, np.bincount(of_text, minlength=len(raw)) + 1


def spans(raw: pa.Array, size: int) -> list[tuple[int, int]]:
    """Where texts are cut into runs of about `size` bytes, of which no text is cut."""
    group = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(), dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(raw)]
    return [(i, j) for i, j in zip(cuts, cuts[1:]) if i < j]


def padded(unit: np.ndarray, lengths: np.ndarray, end: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of texts' tokens (in a row, as many as lengths say) with `context` ends before each text, and the tokens' places."""
    shift = np.repeat(np.arange(1, len(lengths) + 1) * context, lengths)
    tokens = np.arange(len(unit)) + shift
    out = np.full(len(unit) + len(lengths) * context, end, np.int32)
    out[tokens] = unit
    return out, tokens


def small(x: np.ndarray, count: int) -> np.ndarray:
    """Numbers below count, in the type that sorts fastest."""
    return x.astype(np.uint16) if count <= 1 << 16 else x


def log_sum(score: np.ndarray, far: bool) -> np.ndarray:
    """Logarithms of the rows' sums of exponentials; score is overwritten. far: scores may be too large for them."""
    most = score.max(axis=1, keepdims=True) if far else np.float32(0)
    if far:
        score -= most
    total = np.exp(score, out=score) @ np.ones(score.shape[1], np.float32)
    return np.log(total, dtype=np.float64) + (most[:, 0] if far else 0.0)


def nce(true: np.ndarray, false: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean loss by the scores of data (n) and of noise (n rows, overwritten), both less their log expected noise."""
    n = np.float32(len(true))
    hit = np.negative(np.clip(false, -40, 40, out=false), out=false)
    np.exp(hit, out=hit)
    hit += 1
    hit *= n
    return -1 / (1 + np.exp(np.clip(true, -40, 40))) / n, np.reciprocal(hit, out=hit)


class Network:
    """Vectors of units in contexts (r) and as outputs (q), of classes (p), position weights (c), biases of units (b) and classes (a)."""

    def __init__(self, frequency: np.ndarray, starts: np.ndarray, params: Params, values: np.ndarray | None = None):
        units, classes = len(frequency), len(starts)
        self.params, self.units, self.starts = params, units, starts
        self.ends = np.append(starts[1:], units)
        self.of_class = np.repeat(np.arange(classes), self.ends - starts)
        self.alone = self.ends - starts == 1
        self.total = np.cumsum(frequency)
        self.in_class = np.add.reduceat(frequency, starts)
        self.own_share = frequency / self.in_class[self.of_class]
        shapes = [(units, params.size), (units, params.size), (classes, params.size), (params.context, params.size), (units,), (classes,)]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        if values is None:
            rng = np.random.default_rng(11)
            values = np.concatenate([rng.normal(0, 0.1, cuts[2]), np.full(cuts[3] - cuts[2], 0.5), np.log(self.own_share), np.log(self.in_class)])
        self.values = np.array(values, np.float32)
        self.r, self.q, self.p, self.c, self.b, self.a = (x.reshape(s) for x, s in zip(np.split(self.values, cuts[:-1]), shapes, strict=True))
        self.seen = np.full_like(self.values, 1e-3)
        self.seen_of = [x.reshape(s) for x, s in zip(np.split(self.seen, cuts[:-1]), shapes, strict=True)]

    def hidden(self, sequence: np.ndarray, low: int, high: int) -> np.ndarray:
        """Context vectors of the places low to high: each unit's vector is looked up once, and shifted."""
        back = self.params.context
        vectors = self.r.take(sequence[low - back : high], axis=0)
        out = vectors[back - 1 : len(vectors) - 1] * self.c[0]
        for i in range(2, back + 1):
            out += vectors[back - i : len(vectors) - i] * self.c[i - 1]
        return out

    def scores(self, sequence: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of the units at these places (rising, behind the first context)."""
        out = np.empty(len(at), np.float64)
        # the bias as one more component
        classes, units = np.column_stack([self.p, self.a]), np.column_stack([self.q, self.b])
        longest = max(float(np.linalg.norm(x, axis=1).max()) for x in (classes, units))
        for k in range(0, len(at), self.params.score_batch):
            here = at[k : k + self.params.score_batch]
            low, high = int(here[0]), int(here[-1]) + 1
            unit = sequence[here]
            order = np.argsort(small(self.of_class[unit], len(self.starts)), kind="stable")
            unit = unit[order]
            of = self.of_class[unit]
            hidden = np.ones((len(here), self.params.size + 1), np.float32)
            hidden[:, :-1] = self.hidden(sequence, low, high).take(here[order] - low, axis=0)
            far = longest * float(np.linalg.norm(hidden, axis=1).max()) > 60
            each = np.einsum("ij,ij->i", hidden, classes.take(of, axis=0)).astype(np.float64)
            # so few rows at a time that their scores stay in the cache
            for i in range(0, len(hidden), 2048):
                each[i : i + 2048] -= log_sum(hidden[i : i + 2048] @ classes.T, far)
            each += np.where(self.alone[of], 0.0, np.einsum("ij,ij->i", hidden, units.take(unit, axis=0)))
            bounds = np.searchsorted(of, np.arange(len(self.starts) + 1)).tolist()
            for c in np.unique(of).tolist():
                if not self.alone[c]:
                    i, j = bounds[c], bounds[c + 1]
                    each[i:j] -= log_sum(hidden[i:j] @ units[self.starts[c] : self.ends[c]].T, far)
            out[k + order] = each
        return out

    def _step(self, table: np.ndarray, seen: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        """One adaptive step on a table, or on rows of it, which may repeat."""
        if rows is None:
            seen += gradient * gradient
            table -= self.params.rate * gradient / np.sqrt(seen)
            return
        order = np.argsort(small(rows, len(table)), kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        own, total = rows[first], np.add.reduceat(gradient.take(order, axis=0), first, axis=0)
        seen[own] += total * total
        table[own] -= self.params.rate * total / np.sqrt(seen[own])

    def learn(self, sequence: np.ndarray, at: np.ndarray, rng: np.random.Generator, batch: int) -> None:
        """Noise-contrastive steps over the tokens at these places (rising, behind the first context)."""
        p = self.params
        r_seen, q_seen, p_seen, c_seen, b_seen, a_seen = self.seen_of
        class_noise = np.log(p.noise * self.in_class).astype(np.float32)
        unit_noise = np.log(p.inner_noise * self.own_share).astype(np.float32)
        drawn = np.cumsum(self.in_class)
        for k in rng.permutation(np.arange(0, len(at), batch)):
            here = at[k : k + batch]
            low, high = int(here[0]), int(here[-1]) + 1
            # classes are runs of units, so this is also the order of classes
            here = here[np.argsort(small(sequence[here], self.units), kind="stable")]
            target = sequence[here]
            of = self.of_class[target]
            hidden = self.hidden(sequence, low, high).take(here - low, axis=0)
            present, first = np.unique(of, return_index=True)
            unit_first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))

            # the classes
            noise = np.minimum(np.searchsorted(drawn, rng.random(p.noise) * drawn[-1]), len(drawn) - 1)
            own = self.p.take(of, axis=0)
            true = np.einsum("ij,ij->i", hidden, own) + (self.a - class_noise)[of]
            miss, hit = nce(true, hidden @ self.p[noise].T + (self.a[noise] - class_noise[noise]))
            given = hit @ self.p[noise]
            own *= miss[:, None]
            given += own
            class_rows, class_bias = np.concatenate([present, noise]), np.concatenate([np.add.reduceat(miss, first), hit.sum(axis=0)])
            class_gradient = np.concatenate([np.add.reduceat(np.multiply(miss[:, None], hidden, out=own), first), hit.T @ hidden])

            # the units in them: for each class some of its own as noise
            begin = self.total[self.starts[present]] - self.in_class[present] * self.own_share[self.starts[present]]
            noise = np.searchsorted(self.total, begin[:, None] + rng.random((len(present), p.inner_noise)) * self.in_class[present][:, None], side="right")
            noise = np.clip(noise, self.starts[present][:, None], self.ends[present][:, None] - 1)
            vectors, last = self.q[noise], np.append(first[1:], len(of))
            runs = list(zip(range(len(present)), first.tolist(), last.tolist(), strict=True))
            false = np.empty((len(of), p.inner_noise), np.float32)
            for n, i, j in runs:
                np.matmul(hidden[i:j], vectors[n].T, out=false[i:j])
            false += np.repeat(self.b[noise] - unit_noise[noise], last - first, axis=0)
            own = self.q.take(target, axis=0)
            true = np.einsum("ij,ij->i", hidden, own) + (self.b - unit_noise)[target]
            miss, hit = nce(true, false)
            noise_gradient = np.empty((len(present), p.inner_noise, p.size), np.float32)
            for n, i, j in runs:
                given[i:j] += hit[i:j] @ vectors[n]
                noise_gradient[n] = hit[i:j].T @ hidden[i:j]
            own *= miss[:, None]
            given += own
            rows = np.concatenate([target[unit_first], noise.ravel()])
            gradient = np.concatenate([np.add.reduceat(np.multiply(miss[:, None], hidden, out=own), unit_first), noise_gradient.reshape(-1, p.size)])
            bias = np.concatenate([np.add.reduceat(miss, unit_first), np.add.reduceat(hit, first).ravel()])

            # each place's part in the contexts behind it, gathered before one pass over the units
            back = np.zeros((high - low + p.context, p.size), np.float32)
            back[here - low + p.context] = given
            window = sequence[low - p.context : high]
            vectors = self.r.take(window, axis=0)
            given = np.zeros_like(back)
            c_gradient = np.empty_like(self.c)
            for i in range(1, p.context + 1):
                later = back[i:]
                c_gradient[i - 1] = np.einsum("ij,ij->j", vectors[: len(later)], later)
                given[: len(later)] += later * self.c[i - 1]
            self._step(self.p, p_seen, class_gradient, class_rows)
            self._step(self.a, a_seen, class_bias, class_rows)
            self._step(self.q, q_seen, gradient, rows)
            self._step(self.b, b_seen, bias, rows)
            self._step(self.r, r_seen, given, window)
            self._step(self.c, c_seen, c_gradient)


def count_words(texts: DataFrame) -> DataFrame:
    """word (bytes; '' is the end) and c of all tokens of the texts (column raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw")
            for i, j in spans(raw, 8_000_000):
                distinct, code, _ = tokens_of(raw.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(code, minlength=len(distinct)))], names=["word", "c"])

    return texts.select("raw").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int, longest: int) -> DataFrame:
    """All words of at most `longest` bytes above a count, at most `most`; the count comes from how many words have each count."""
    counts = counts.where(F.octet_length("word") <= longest)
    sizes = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    least, total = None, 0
    for r in sizes.toLocalIterator():
        total += r.n
        if total > most:
            break
        least = r.c
    return counts.where(F.lit(False) if least is None else F.col("c") >= least)


def make_units(counts: DataFrame, total: int, params: Params) -> tuple[Units, dict[int, tuple[int, int]]]:
    """Units from the counts of `total` tokens, and (sum, number) of each group's words; a bounded number of rows comes to the driver."""
    most = int(min(max(params.head_rate * np.sqrt(total), params.least_head), params.most_head))
    short = F.octet_length("word") <= params.longest
    head = {bytes(r.word): r.c for r in counts.where(short).orderBy(F.desc(F.col("word") == F.lit(END)), F.desc("c"), "word").limit(most).collect()} or {END: 0}
    least = min((c for w, c in head.items() if w != END), default=0)
    # words as frequent as the last one are on either side; those are told by name
    tied = [F.lit(w) for w, c in head.items() if c == least or w == END]
    rest = counts.where(~short | ((F.col("c") <= least) & ~F.col("word").isin(tied)))
    by_ending = checkpointed(rest.groupBy(F.substring("word", -2, 2).alias("ending")).agg(F.sum("c").alias("c"), F.count("*").alias("v")))
    top = by_ending.orderBy(F.desc("c"), "ending").limit(params.endings).collect()
    all_c, all_v = by_ending.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    units = Units.of_counts(head, {bytes(r.ending): r.c for r in top}, all_c - sum(r.c for r in top))
    groups = {units.endings[bytes(r.ending)]: (r.c, r.v) for r in top} | {units.other: (all_c - sum(r.c for r in top), all_v - sum(r.v for r in top))}
    return units, groups


def averaged(parts: DataFrame, count: int, fan: int = 64) -> DataFrame:
    """One row for each block of parameters: their mean over `count` parts by tokens, `fan` parts at a time, in the order of parts."""

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        total = sum(np.frombuffer(v, np.float32) * float(n) for v, n in zip(rows["part_values"], rows["n"], strict=True))
        n = rows["n"].sum()
        return pd.DataFrame({"task": rows["task"].iloc[:1] // fan, "part": rows["part"].iloc[:1], "part_values": [(total / n).astype(np.float32).tobytes()], "n": [n]})

    parts = parts.groupBy("part", F.floor(F.col("task") / fan)).applyInPandas(mean, PART)
    return parts if count <= fan else averaged(parts, -(-count // fan), fan)


def train(texts: DataFrame, units: Units, params: Params, total: int, documents: int) -> Network:
    """The network, over all texts (columns row, raw; total tokens in so many documents): a start from a sample, then averaged passes over all parts."""
    start = Network(units.frequency, units.starts, params)
    rng = np.random.default_rng(5)
    # the sample is bounded in documents and in bytes: whole texts, in the order of a hash, while they fit
    listed = first_by_hash(texts.select("row", F.octet_length("raw").alias("size")), "row", params.start_documents, documents).collect()
    sizes = np.cumsum([r.size or 0 for r in listed])
    chosen = sorted({r.row for r, size in zip(listed, sizes, strict=True) if size <= params.start_bytes})
    few = texts.where(F.col("row").isin(chosen)).dropDuplicates(["row"]).orderBy("row").select("raw").toArrow().column("raw").combine_chunks() if chosen else []
    for _ in range(params.start_rounds):
        for at in range(0, len(few), 250):
            distinct, code, lengths = tokens_of(few[at : at + 250])
            sequence, tokens = padded(units.of(distinct)[code], lengths, units.head[END], params.context)
            start.learn(sequence, tokens, rng, params.start_batch)
    begun, seen = start.values, start.seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(units.frequency, units.starts, params, begun)
        own.seen[:] = seen
        rng, total = np.random.default_rng(3), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                distinct, code, lengths = tokens_of(batch.column("raw").slice(at, 256))
                sequence, tokens = padded(units.of(distinct)[code], lengths, units.head[END], params.context)
                own.learn(sequence, tokens, rng, params.batch)
                total += len(tokens)
        if total:
            parts = [own.values[k : k + BLOCK].tobytes() for k in range(0, len(own.values), BLOCK)]
            task = [TaskContext.get().partitionId() % count] * len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary()), pa.array([total] * len(parts), pa.int64())], names=["task", "part", "part_values", "n"])

    count = max(1, round(total**0.5 / params.part_root))
    dealt = texts.select("row", "raw").repartition(count, "row").sortWithinPartitions("row")
    parts = dealt.select("raw").mapInArrow(run, PART)
    got = averaged(parts, count).orderBy("part").toArrow().column("part_values").to_pylist()
    return Network(units.frequency, units.starts, params, np.frombuffer(b"".join(got), np.float32)) if got else start


@dataclass
class Model:
    """What training leaves: units and network, counts of all training words, their sum and number, and (sum, number) of each group's."""

    units: Units
    network: Network
    counts: DataFrame
    total: int
    distinct: int
    groups: dict[int, tuple[int, int]]

    def bottoms(self) -> np.ndarray:
        """For each unit what a count + 0.5 is divided by for the word's share in its group; 0 for words of their own."""
        out = np.zeros(self.units.count)
        for unit, (n, v) in self.groups.items():
            out[unit] = n + 0.5 * (v + 1)
        return out


def keyed(documents: DataFrame, fold: int, folds: int) -> DataFrame:
    """doc_id, held_out, row and raw of each row."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    return documents.select("doc_id", held_out.alias("held_out"), F.xxhash64("doc_id", "text").alias("row"), raw_text().alias("raw"))


def fit(documents: DataFrame, params: Params = Params(), fold: int = 1, folds: int = 5) -> Model:  # noqa: B008
    """The model of the documents that are not held out."""
    texts = keyed(documents, fold, folds).where(~F.col("held_out"))
    counts = checkpointed(count_words(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    units, groups = make_units(counts, total, params)
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return Model(units, train(texts, units, params, total, ends), counts, total, distinct, groups)


def score(documents: DataFrame, params: Params = Params(), fold: int = 1, folds: int = 5, model: Model | None = None) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    held_out: crc32 of the id as text leaves `fold` over `folds`; null ids are not held out. Null and
    empty texts are one end; texts count whole, however long. Scores are log10 probabilities of whole
    texts, the same (but for rounding) however the rows are dealt over files; very long words cost memory in
    their own task alone. Every row gives a row, repeated ones too; an empty table gives none; without training documents
    all counts are 0. Other columns are not read.
    """
    model = model or fit(documents, params, fold, folds)
    units, network, counts, total = model.units, model.network, model.counts, model.total
    rows = keyed(documents, fold, folds)
    bottom = model.bottoms()
    base_bottom = total + 0.5 * (model.distinct + 1)

    top = most_frequent(counts, params.sent, params.longest).toArrow()
    sent = documents.sparkSession.sparkContext.broadcast((top.column("word").to_pylist(), top.column("c").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = sent.value
        place = dict(zip(names, range(len(names)), strict=True))
        base_log = np.append(np.log10((c + 0.5) / base_bottom), 0.0)
        unit_of = np.append(units.of(pa.array(names, pa.binary())), -1).astype(np.int32)
        under = bottom[unit_of[:-1]]
        inner = np.append(np.where(under > 0, np.log10((c + 0.5) / np.where(under > 0, under, 1)), 0.0), 0.0)
        for batch in batches:
            for i, j in spans(batch.column("raw"), 2_000_000):
                part = batch.slice(i, j - i)
                # each distinct word is looked up once
                distinct, code, lengths = tokens_of(part.column("raw"))
                found = np.fromiter(map(place.get, distinct.to_numpy(zero_copy_only=False), repeat(-1)), np.int64, len(distinct))
                rare = np.flatnonzero(found < 0)
                unit = unit_of[found]
                unit[rare] = units.of(distinct.take(pa.array(rare)))
                sequence, tokens = padded(unit[code], lengths, units.head[END], params.context)
                each = network.scores(sequence, tokens) / np.log(10) + inner[found][code]
                starts = np.cumsum(lengths) - lengths
                sums, base = np.add.reduceat(each, starts), np.add.reduceat(base_log[found][code], starts)
                known = np.add.reduceat((found >= 0).astype(np.int64)[code], starts)
                rare_at = np.flatnonzero((found < 0)[code])
                owner = np.searchsorted(starts, rare_at, side="right") - 1
                tails, tf = np.unique(owner * len(distinct) + code[rare_at], return_counts=True)
                owner, which = np.divmod(tails, len(distinct))
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(lengths)))))
                held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([distinct.take(pa.array(which)), pa.array(tf, pa.int64()), pa.array(bottom[unit[which]], pa.float64())], ["word", "tf", "under"]))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(lengths), pa.array(known), pa.array(base), pa.array(sums), held]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "known", "base", "sum", "rare"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    partly = rows.select("doc_id", "held_out", "raw").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, sum double, rare array<struct<word:binary,tf:long,under:double>>")
    partly = checkpointed(partly.withColumn("row", F.monotonically_increasing_id()))
    rare = partly.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    in_group = F.when(F.col("under") > 0, F.log10((F.col("c") + 0.5) / F.col("under"))).otherwise(0.0)
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(float(base_bottom)))).alias("more_base"),
        F.sum(F.col("tf") * in_group).alias("more_sum"),
    )
    zero = F.lit(0.0)
    return partly.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("sum") + F.coalesce("more_sum", zero)).alias("score"),
    )
