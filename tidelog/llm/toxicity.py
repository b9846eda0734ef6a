"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Grade y is 0 for a clean document and 1 to GRADES-1 for a toxic one, by how many marker
features (those far more frequent under the toxic label) it holds. One weight vector w is
shared by all thresholds: P(y > k) = sigmoid(w . x - theta[k]) with rising theta, and the
expected severity is the sum of P(y > k) over k. Weights come from proximal gradient steps
with an L1 term in numpy, so few features keep a weight and long clean texts add up to nothing.

Features of a word: itself and its first 4 and 5 letters, which carry a stem over to endings
that were not seen. x counts a document's distinct words with the feature.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpointed, fresh

WORD = re.compile(r"[^\W\d_]+")
GRADES = 4
#: Numbers of first letters that are features.
STEMS = (4, 5)


def text_words(text: str | None) -> set[str]:
    """Distinct lower-case words of letters."""
    return set(WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


@dataclass(frozen=True)
class Ordinal:
    """Shared weights, and one rising threshold a step between grades."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def of_word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(y > k), a column for each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds), -60, 60)))


def train(toxic: np.ndarray, row: np.ndarray, col: np.ndarray, count: np.ndarray, names: list[str], lift: np.ndarray, l1: float = 2e-4, rounds: int = 300) -> Ordinal:
    """The model of 0/1 labels and of the number of words (count) that a document (row) has with a feature (col).

    lift: how much more frequent each feature is under the toxic label; above 8 it is a marker.
    """
    y, value = toxic, np.log1p(count.astype(float))
    n = np.bincount(y, minlength=2)
    amount = np.bincount(row, lift[col] > 8, len(y))
    steps = np.quantile(amount[y == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(y == 1, 1 + (amount[:, None] > steps).sum(1), 0)

    w, theta = np.zeros(len(names)), np.arange(GRADES - 1) + 2.0
    over = grade[:, None] > np.arange(GRADES - 1)
    weight = np.where(y == 1, n[0] / n[1], 1.0)[:, None] / (2 * n[0] / len(y))  # both labels count alike
    step = 4.0 / ((np.bincount(row, value**2, len(y)) * weight[:, 0]).mean() * (GRADES - 1) + 1)
    held_w, t = w.copy(), 1.0
    for _ in range(rounds):
        score = np.bincount(row, held_w[col] * value, len(y))
        miss = weight * (1 / (1 + np.exp(-np.clip(score[:, None] - theta, -60, 60))) - over)
        gradient = np.bincount(col, miss.sum(1)[row] * value, len(w)) / len(y)
        new = held_w - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        held_w, w = new + (before - 1) / t * (new - w), new
        theta = np.sort(theta + step * 4 * miss.mean(0))
    return Ordinal({names[i]: float(w[i]) for i in np.flatnonzero(w)}, tuple(theta.tolist()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, p and q: how many toxic and clean documents of a part have each feature. A feature may come again."""
    counts: tuple[Counter[str], Counter[str]] = Counter(), Counter()

    def out() -> pa.RecordBatch:
        names = list(counts[0] | counts[1])
        found = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][n] for n in names], pa.int64()) for k in (1, 0))], names=["name", "p", "q"])
        for c in counts:
            c.clear()
        return found

    for batch in batches:
        for toxic, words in zip(batch.column("toxic").to_pylist(), map(pa.ListScalar.as_py, batch.column("words")), strict=True):
            counts[toxic].update({f for w in words for f in features(w)})
            if len(counts[0]) + len(counts[1]) > 100_000:
                yield out()
    yield out()


def fit(documents: DataFrame, labels: DataFrame, sample: int = 8000, most_features: int = 4000, least: int = 3) -> Ordinal:
    """The model of at most `sample` labelled documents: those whose ids have the smallest hash.

    Labels other than 0 and 1 and null ids are left out; of several labels of an id the larger holds, and
    of several texts the least. Without both labels (an empty table has none) the model rejects nothing.

    Features that `least` documents have are counted and ranked in Spark; the driver gets the counts of
    the `most_features` strongest alone, however long the texts are.
    """
    kept = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    chosen = kept.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the bound on the sample is the bound on what is broadcast; of repeated ids one text stays
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    @F.arrow_udf("array<string>")
    def own_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            kind = pa.list_(pa.string())
            yield pa.concat_arrays([pa.array([sorted(text_words(t)) for t in batch[at : at + 64].to_pylist()], kind) for at in range(0, len(batch), 64)] or [pa.array([], kind)])

    rows = checkpointed(texts.withColumn("words", own_words("text")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words")))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Ordinal({}, tuple(10.0 + k for k in range(GRADES - 1)))
    has = rows.select("toxic", "words").mapInArrow(_counted, "name string, p long, q long").groupBy("name").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(F.col("p") + F.col("q") >= least)
    p, q = (F.col("p") + 0.5) / (n[1] + 1), (F.col("q") + 0.5) / (n[0] + 1)
    lift = F.log(p / q) * F.sqrt(F.greatest(p, q) * min(n.values()))
    strongest = has.select("name", lift.alias("lift")).where(F.abs("lift") > 4).orderBy(F.desc(F.abs("lift")), "name").limit(most_features).collect()
    place = {r.name: k for k, r in enumerate(strongest)}

    @F.arrow_udf("struct<col:array<int>,count:array<int>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for words in map(pa.ListScalar.as_py, batch):
                seen = Counter(place[f] for w in words for f in features(w) if f in place)
                found.append({"col": list(seen), "count": list(seen.values())})
            yield pa.array(found, pa.struct([("col", pa.list_(pa.int32())), ("count", pa.list_(pa.int32()))]))

    got = rows.select("doc_id", "toxic", counted("words").alias("c")).select("doc_id", "toxic", "c.col", "c.count").orderBy("doc_id").toArrow()
    col, count = (got.column(c).combine_chunks() for c in ("col", "count"))
    row = np.repeat(np.arange(len(col), dtype=np.int32), np.diff(col.offsets.to_numpy()))
    return train(got.column("toxic").to_numpy(), row, col.flatten().to_numpy(), count.flatten().to_numpy(), list(place), np.array([r.lift for r in strongest]))


def word_score(text: Column, model: Ordinal) -> Column:
    """w . x of a text column: a double, 0 for null and empty texts."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        by_feature = model.weights
        for batch in batches:
            out = []
            for text in batch:
                words = text_words(text.as_py())
                counts: Counter[str] = Counter()
                for w in words:
                    if w not in known:
                        known[w] = model.of_word(w)
                    if known[w]:
                        counts.update(f for f in features(w) if f in by_feature)
                out.append(sum(by_feature[f] * float(np.log1p(c)) for f, c in sorted(counts.items())))
                if len(known) > 150_000:
                    known.clear()
            yield pa.array(out, pa.float64())

    return score(text)


def grade(documents: DataFrame, model: Ordinal, threshold: float = 0.5) -> DataFrame:
    """documents with toxicity (expected severity), toxicity_grade and toxic.

    toxicity is in [0, GRADES-1]; toxicity_grade is the number of k with P(y > k) >= 0.5; toxic is
    P(y > 0) >= threshold. Null and empty texts have no features; texts count whole, however long. Columns
    of these names are replaced; every row stays, repeated ones too; an empty table gives no rows.
    """
    (name,) = fresh(documents, "score")
    score = F.col(name)
    above = [1 / (1 + F.exp(F.lit(k) - score)) for k in model.thresholds]
    return (
        documents.withColumn(name, word_score(F.col("text"), model))
        .withColumn("toxicity", sum(above[1:], above[0]))
        .withColumn("toxicity_grade", sum((F.when(p >= 0.5, 1).otherwise(0) for p in above[1:]), F.when(above[0] >= 0.5, 1).otherwise(0)))
        .withColumn("toxic", above[0] >= threshold)
        .drop(name)
    )


def without_toxic(documents: DataFrame, model: Ordinal, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that grade() would not mark as toxic, with all of their columns as they are."""
    (name,) = fresh(documents, "score")
    above = 1 / (1 + F.exp(F.lit(model.thresholds[0]) - F.col(name)))
    return documents.withColumn(name, word_score(F.col("text"), model)).where(above < threshold).drop(name)
