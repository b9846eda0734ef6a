"""Hard negatives by segment summaries: bounds of scores from means and deviations, refined segment by segment.

Rows are vectors of integers. A segment (a run of components) of a vector is summarised by its mean and
by its deviation, the length of what is left when the mean is taken off. In a segment of n components the
inner product of two vectors lies within n * mean * mean' plus or minus deviation * deviation', and over
the segments of a vector these add up. The finest segments' summaries are stored with each row; those of
the coarser levels (two halves make one) follow from them.

Scoring an anchor goes from the whole vector to halves, quarters and so on: a level's bounds are one matrix
product of means and deviations, and only rows whose bounds still admit them go to the next level, the last
of which is the exact product. Anchors first look for positives (the best rows of their label; a row is
admitted if its upper bound reaches the last one so far), then for negatives: a row is admitted if its
bounds meet the window of some positive above the last negative of that window so far.

Anchors and rows meet in cells: each block of rows goes to each block of anchors once. Blocks are as
large as a task's memory allows (40,000 vectors of 64 components), so that rows are copied once for as
many anchors. A share of the blocks of rows is searched first; the last ones that these put into a list
are where the others begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import checkpointed

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
PACKED = "d long, block long, n long, ids binary, labels binary, vectors binary, means binary, deviations binary, starts binary, lows binary, highs binary"


@dataclass(frozen=True)
class Params:
    """positives and negatives: rows an anchor, and an anchor and positive, get. low, high: the window of a negative's score,
    in hundredths of the positive's. segments: the finest ones, at most. block_bytes: of a block, at most; least_blocks: of
    rows, where they are few. One of first_share blocks is searched first, so that the others know what to beat."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    segments: int = 16
    block_bytes: int = 16 << 20
    least_blocks: int = 48
    first_share: int = 16


def usable(vectors: DataFrame, key: str, column: str, label: Column) -> DataFrame:
    """id, label, vector (floor of 256 times each component) and d (its length) of the rows that take part; of an id, the largest."""
    x = F.col(column).cast("array<double>")
    got = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    got = got.where("id is not null and label is not null and x is not null").where(fine)
    # floor() gives 64 bits, and doubles beyond 2^53 are whole numbers as they are
    whole = F.transform("x", lambda v: F.when(F.abs(v * 256) < 2.0**53, F.floor(v * 256).cast("double")).otherwise(v * 256))
    made = got.select("id", F.struct("label", whole.alias("vector")).alias("row"))
    return made.groupBy("id").agg(F.max("row").alias("row")).select("id", "row.*").withColumn("d", F.size("vector").cast("long"))


def cuts(d: int, segments: int) -> np.ndarray:
    """Where the finest segments of d components begin; their number is a power of two."""
    n = 1
    while 2 * n <= min(segments, max(d, 1)):
        n *= 2
    return np.arange(n) * d // n


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the finest segments, deviations rounded up."""
    d = x.shape[1]
    if not d:
        return np.zeros((len(x), 1)), np.zeros((len(x), 1))
    at = cuts(d, segments)
    size = np.diff(np.append(at, d))
    means = np.add.reduceat(x, at, axis=1) / size
    left = x - np.repeat(means, size, axis=1)
    return means, np.sqrt(np.add.reduceat(left * left, at, axis=1)) * (1 + 1e-9)


def levels(means: np.ndarray, deviations: np.ndarray, d: int, segments: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """From one segment to the finest: means times the root of the segment's size, and deviations."""
    size = np.diff(np.append(cuts(d, segments), d)).astype(float) if d else np.ones(1)
    out = []
    while True:
        out.append((means * np.sqrt(size), deviations))
        if len(size) == 1:
            return out[::-1]
        both = size[::2] + size[1::2]
        whole = (means[:, ::2] * size[::2] + means[:, 1::2] * size[1::2]) / both
        apart = (means[:, ::2] - means[:, 1::2]) ** 2 * (size[::2] * size[1::2] / both)
        deviations = np.sqrt(deviations[:, ::2] ** 2 + deviations[:, 1::2] ** 2 + apart) * (1 + 1e-9)
        means, size = whole, both


def stored(rows: DataFrame, block: Column, params: Params) -> DataFrame:
    """PACKED blocks of rows of one dimension, by label and id, with their summaries and the windows they ask for, if any."""

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, number = (k.as_py() for k in key)
        got = pa.Table.from_batches(batches).combine_chunks()
        ids, labels = (got[c].to_numpy() for c in ("id", "label"))
        order = np.lexsort((ids, labels))
        got, ids, labels = got.take(pa.array(order)), ids[order], labels[order]
        x = got["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), d)
        means, deviations = summaries(x, params.segments)
        with np.errstate(invalid="ignore"):
            small = x.astype(np.int16)
        starts, lows, highs = np.zeros(len(ids) + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if "windows" in got.column_names:
            windows = got["windows"].combine_chunks()
            starts[1:] = np.cumsum(windows.value_lengths().to_numpy())
            lows, highs = (windows.flatten().field(c).to_numpy() for c in ("low", "high"))
        arrays = [ids, labels, small if np.array_equal(small, x) else x, means, deviations, starts, lows, highs]
        row = [d, number, len(ids), *(v.tobytes() for v in arrays)]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in row], [f.split()[0] for f in PACKED.split(", ")])

    kept = ["d", "block", "id", "label", "vector", *(c for c in rows.columns if c == "windows")]
    return rows.withColumn("block", block.cast("long")).select(*kept).groupBy("d", "block").applyInArrow(pack, PACKED)


class Rows:
    """A packed block, or some consecutive rows of it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], largest: float):
        self.ids, self.labels, self.x, self.levels, self.largest = ids, labels, x, bounds, largest
        self.n, self.d = x.shape

    @staticmethod
    def of(row: dict, segments: int) -> Rows:
        n, d = row["n"], row["d"]
        x = np.frombuffer(row["vectors"], np.float64 if d and len(row["vectors"]) == 8 * n * d else np.int16).reshape(n, d)
        means, deviations = (np.frombuffer(row[c], np.float64).reshape(n, -1) for c in ("means", "deviations"))
        return Rows(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), x, levels(means, deviations, d, segments), float(np.abs(x.astype(float)).max()) if x.size else 0.0)

    def part(self, low: int, high: int) -> Rows:
        at = slice(low, high)
        return Rows(self.ids[at], self.labels[at], self.x[at], [(m[at], v[at]) for m, v in self.levels], self.largest)


def products(a: Rows, at: np.ndarray, b: Rows, of: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of a and of b: in doubles where these hold every sum, else in Python's integers."""
    x, y = a.x[at], b.x[of]
    if max(a.d, 1) * a.largest * b.largest < 2**53:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in x], object).reshape(x.shape) @ np.array([[int(v) for v in r] for r in y], object).reshape(y.shape).T
    return whole.astype(np.int64)


def admitted(a: Rows, b: Rows, low: np.ndarray, high: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors in a and rows in b, and whether a pair's score may lie from low to high of its anchor (and open_
    holds), by ever finer segments."""
    at, rows = np.arange(a.n), np.arange(b.n)
    for (am, av), (bm, bv) in zip(a.levels, b.levels, strict=True):
        if not open_.any():
            break
        middle, width = am[at] @ bm[rows].T, av[at] @ bv[rows].T
        # what rounding may have cost
        width += 1e-9 * (np.abs(middle) + width) + 1e-6
        open_ = open_ & (middle + width >= low[at, None]) & (middle - width <= high[at, None])
        keep, use = open_.any(axis=1), open_.any(axis=0)
        if not (keep.all() and use.all()):
            at, rows, open_ = at[keep], rows[use], open_[keep][:, use]
    return at, rows, open_


#: Anchors, and rows, of a block that are bounded and scored at a time; what is found narrows the next.
STEP = 1024


def best_in(a: Rows, b: Rows, windows: list[list[tuple[int, int]]], same: bool, most: int) -> Iterator[tuple[int, int, int]]:
    """anchor, row and score of the best rows of b of the same (or another) label, in each of an anchor's windows of score."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.empty(0, np.int64), np.empty(0, np.int64))] * len(w) for w in windows]
    floors = [[w[0] for w in each] for each in windows]
    low = np.array([min(f, default=np.inf) for f in floors], float)
    high = np.array([max((w[1] for w in each), default=-np.inf) for each in windows], float)
    for begin in range(0, b.n, STEP):
        part = b.part(begin, begin + STEP)
        open_ = a.labels[:, None] == part.labels[None, :]
        open_ = open_ & (a.ids[:, None] != part.ids[None, :]) if same else ~open_
        at, rows, open_ = admitted(a, part, low, high, open_)
        if not open_.any():
            continue
        score = products(a, at, part, rows)
        open_ = open_ & (score >= low[at, None]) & (score <= high[at, None])
        for k in np.flatnonzero(open_.any(axis=1)).tolist():
            n = at[k]
            hit = np.flatnonzero(open_[k])
            values, ids = score[k][hit], part.ids[rows[hit]]
            for j, (_, top) in enumerate(windows[n]):
                inside = (values >= floors[n][j]) & (values <= top)
                if inside.any():
                    every, whose = np.concatenate((found[n][j][0], values[inside])), np.concatenate((found[n][j][1], ids[inside]))
                    first = np.lexsort((whose, -every))[:most]
                    found[n][j] = every[first], whose[first]
                    if len(first) == most:
                        floors[n][j] = max(floors[n][j], int(every[first[-1]]))
            low[n] = min(floors[n])
    for n, each in enumerate(found):
        pairs = {pair for values, ids in each for pair in zip(ids.tolist(), values.tolist(), strict=True)}
        yield from ((int(a.ids[n]), i, v) for i, v in pairs)


class Cells:
    """Rows and anchors in blocks, and the search of each block of rows for each block of anchors."""

    def __init__(self, rows: DataFrame, anchors: Column, params: Params):
        self.params, spark = params, rows.sparkSession
        self.mine = rows.where(anchors)
        shapes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if(anchors).alias("asked")).where("asked > 0").collect()
        deal = []
        for d, n, asked in shapes:
            size = 2 * d + 16 * params.segments + 16
            deal.append((d, max(min(params.least_blocks, -(-n // STEP)), -(-n * size // params.block_bytes)), -(-asked * size // params.block_bytes)))
        self.tasks = min(20_000, sum(b * a for _, b, a in deal))
        self.deal = F.broadcast(spark.createDataFrame(deal, "d long, row_blocks long, anchor_blocks long"))
        self.blocks = checkpointed(stored(rows.join(self.deal, "d"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("row_blocks")), params))

    def _searched(self, asked: DataFrame, same: bool, most: int, first: bool) -> DataFrame:
        """anchor_id, id and score, by the anchors' blocks and the first blocks of rows or the others."""
        segments = self.params.segments

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            columns: tuple = ([], [], [])
            if left.num_rows and right.num_rows:
                own, at = left.to_pylist()[0], right.to_pylist()[0]
                anchors, rows = Rows.of(own, segments), Rows.of(at, segments)
                starts, lows, highs = (np.frombuffer(own[c], np.int64).tolist() for c in ("starts", "lows", "highs"))
                windows = [list(zip(lows[i:j], highs[i:j], strict=True)) for i, j in zip(starts[:-1], starts[1:], strict=True)]
                found = [pair for n in range(0, anchors.n, STEP) for pair in best_in(anchors.part(n, n + STEP), rows, windows[n : n + STEP], same, most)]
                columns = tuple(zip(*found, strict=True)) or columns
            return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "id", "score"])

        chosen = F.col("b") % self.params.first_share == 0
        rows = self.blocks.withColumnRenamed("block", "b").where(chosen if first else ~chosen).join(self.deal, "d").withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("anchor_blocks") - 1)))
        dealt = asked.withColumnRenamed("block", "a").join(self.deal, "d").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_blocks") - 1))).where(chosen if first else ~chosen)
        # a cell is work, however few its bytes are: one task each
        left, right = (df.drop("row_blocks", "anchor_blocks").repartition(self.tasks, "d", "a", "b").groupBy("d", "a", "b") for df in (dealt, rows))
        return left.cogroup(right).applyInArrow(run, "anchor_id long, id long, score long")

    def best(self, windows: DataFrame, same: bool, most: int) -> DataFrame:
        """anchor_id, id and score, the best rows of each of an anchor's windows among them. windows: anchor_id, windows."""

        def packed(asked: DataFrame) -> DataFrame:
            rows = self.mine.join(asked.withColumnRenamed("anchor_id", "id"), "id").join(self.deal, "d")
            return checkpointed(stored(rows, F.pmod(F.xxhash64("id", F.lit(2)), F.col("anchor_blocks")), self.params))

        first = checkpointed(self._searched(packed(windows), same, most, True))
        each = windows.select("anchor_id", F.explode("windows").alias("w")).select("anchor_id", "w.*")
        place = F.row_number().over(Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("score")))
        floors = each.join(first, "anchor_id").where("score between low and high").withColumn("place", place).where(F.col("place") == most).select("anchor_id", "low", "high", "score")
        raised = each.join(floors, ["anchor_id", "low", "high"], "left").groupBy("anchor_id").agg(F.collect_list(F.struct(F.coalesce("score", "low").alias("low"), "high")).alias("windows"))
        return first.unionByName(self._searched(packed(raised), same, most, False))


def mined(vectors: DataFrame, anchors: Column, key: str = "vec_id", column: str = "embedding", label: Column | None = None, params: Params = Params()) -> DataFrame:  # noqa: B008
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    anchors: which rows are anchors (a condition on id). Components become floor(256 * x), and scores are
    integer inner products. An anchor's positives are its best rows of the same label, itself left out; a
    positive's negatives are the best rows of other labels whose score lies from low to high hundredths of
    the positive's. Ties go to the smaller id; where there are fewer, fewer come. Rows with a null id,
    label, vector or component, or a non-finite one, take no part; vectors meet those of their own length
    alone. Of rows that repeat an id, the one of largest label and vector takes part. A hundred times a
    score must fit 64 bits. Empty tables give no rows; other columns are not read.
    """
    rows = checkpointed(usable(vectors, key, column, label if label is not None else F.col("label")))
    cells = Cells(rows, anchors, params)
    if not cells.tasks:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    most = F.lit(2**62)
    every = cells.mine.select(F.col("id").alias("anchor_id"), F.array(F.struct((-most).alias("low"), most.alias("high"))).alias("windows"))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = cells.best(every, True, params.positives).withColumn("place", F.row_number().over(order)).where(F.col("place") <= params.positives)
    bounds = F.struct(F.expr(f"({params.low} * score + pmod(-{params.low} * score, 100)) div 100").alias("low"), F.expr(f"({params.high} * score - pmod({params.high} * score, 100)) div 100").alias("high"))
    near = checkpointed(near.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), bounds.alias("w")).where("w.low <= w.high"))
    windows = checkpointed(near.groupBy("anchor_id").agg(F.collect_set("w").alias("windows")))
    found = cells.best(windows, False, params.negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    pairs = found.join(near, "anchor_id").where("negative_score between w.low and w.high")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return pairs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= params.negatives).select(*(f.split()[0] for f in SCHEMA.split(", ")))
