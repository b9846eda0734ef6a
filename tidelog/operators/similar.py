"""Pairs of similar texts that are near in time: dealt into cells of bounded size, each compared by the task that holds it.

A cell is a band of time. A row goes to its own band, and to the next one too where rows of that can be near enough; so each
text is shuffled once or twice, however many others it is compared with, and no pair is ever written with its texts. A pair
belongs to the band of its later row. A band of too many rows or characters is cut up by classes of length, as lengths of
a pair differ by at most the factor (2 - least) / least: a row goes to its own class and the next longer one, and a pair
belongs to the class of its longer row. What is still too much is dealt into parts by a hash, of which each two meet.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import text as t

#: Rows and characters of a part, about; a cell holds one part or two.
ROWS, CHARS = 20_000, 16 << 20
#: Windows of time in a band.
WINDOWS = 4
#: Characters of all texts in a partition, about, and of those whose codes a task keeps.
PARTITION, CODED = 8 << 20, 4 << 20
#: Comparisons that a task remembers of texts that come more than once, and pairs that it puts out at a time.
REMEMBERED, PAIRS = 1_000_000, 10_000

CELL = ["band", "class", "low", "high"]


def similar_pairs(entities: DataFrame, seconds: int, least: float, min_chars: int) -> DataFrame:
    """left_ and right_ rpid and bvid, similarity, seconds_apart and whether the texts are `equal`, of event.templates(); least < 1.

    entities: rpid, bvid, first_seen_at, first_content.
    """
    spark = entities.sparkSession
    known = entities.select("rpid", "bvid", "first_seen_at", "first_content").where("bvid is not null and first_seen_at is not null and first_content is not null")
    window = F.floor(F.unix_seconds("first_seen_at") / (seconds + 1))
    band, last = F.floor(window / WINDOWS), F.pmod(window, F.lit(WINDOWS)) == WINDOWS - 1
    bands = F.explode(F.when(last, F.array(band, band + 1)).otherwise(F.array(band)))
    sums = known.withColumn("band", bands).groupBy("band").agg(F.count("*").alias("rows"), F.sum(F.length("first_content")).alias("chars"))
    busy = (F.col("rows") > ROWS) | (F.col("chars") > CHARS)
    chars, crowded = sums.agg(F.sum("chars"), F.max(busy)).first()

    folded = t.with_folded(known, "folded", F.col("first_content"), "alnum").drop("first_content").withColumn("at", F.unix_micros("first_seen_at"))
    placed = folded.where(F.length("folded") >= min_chars).withColumn("band", bands).drop("first_seen_at")
    whole = F.array(F.struct(F.lit(-1).alias("class"), *(F.lit(0).alias(c) for c in ("low", "high", "part"))))
    if crowded:
        factor = math.log((2 - least) / least) * 1.0001
        placed = placed.withColumn("length", F.floor(F.log(F.length("folded")) / factor).cast("int"))
        classes = F.array("length", F.col("length") + 1)
        # few rows: a busy band has ROWS rows or CHARS characters, and lengths have few classes
        sizes = placed.join(F.broadcast(sums.where(busy).select("band")), "band", "left_semi").withColumn("class", F.explode(classes)).groupBy("band", "class").agg(F.ceil(F.greatest(F.count("*") / ROWS, F.sum(F.length("folded")) / CHARS)).cast("int").alias("parts"))
        parts = sizes.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("class", "parts"))).alias("parts"))
        placed = placed.join(F.broadcast(parts), "band", "left").withColumn("hash", F.xxhash64("rpid", "bvid", "at", "folded"))

        def dealt(c):
            n = F.col("parts")[c]
            part = F.pmod("hash", n).cast("int")
            return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(c.alias("class"), F.least(part, j).alias("low"), F.greatest(part, j).alias("high"), part.alias("part")))

        cells = F.when(F.col("parts").isNull(), whole).otherwise(F.flatten(F.transform(classes, dealt)))
    else:
        placed, cells = placed.withColumn("length", F.lit(-1)), whole
    dealt_out = placed.withColumn("cell", F.explode(cells)).select("rpid", "bvid", "at", "folded", "length", "band", "cell.*")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, -(-(chars or 0) // PARTITION))
    kinds = dict(known.dtypes)
    out = "".join(f"{s}_{c} {kinds[c]}, " for c in ("rpid", "bvid") for s in ("left", "right")) + "similarity double, seconds_apart long, equal boolean"
    band_us = (seconds + 1) * WINDOWS * 1_000_000

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        at = rows["at"].to_numpy()
        own = at // band_us == rows["band"][0].as_py()
        yield from pairs_of(rows, own, seconds, least)

    return dealt_out.repartition(n, *CELL).groupBy(*CELL).applyInArrow(compare, out)


def pairs_of(rows: pa.Table, own: np.ndarray, seconds: int, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs that belong to a cell. own: whether a row's own band is the cell's."""
    # by their lengths, so that those that can be similar are together
    texts = rows["folded"].to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(sizes, kind="stable")
    rows, own, sizes, texts = rows.take(order), own[order], sizes[order], [texts[k] for k in order.tolist()]
    at, ids = rows["at"].to_numpy(), rows["rpid"].to_pylist()
    videos = rows["bvid"].combine_chunks().dictionary_encode().indices.to_numpy()
    class_, low, high = (rows[c][0].as_py() for c in CELL[1:])
    mine = np.ones(len(texts), bool) if class_ < 0 else rows["length"].to_numpy() == class_
    part = rows["part"].to_numpy()
    # rows in the order of time and id, of which nulls are first; equal ones are no pair
    key = lambda k: (at[k], ids[k] is not None, ids[k])
    place, places = -1, np.empty(len(texts), np.int64)
    before = None
    for k in sorted(range(len(texts)), key=lambda k: (at[k], ids[k] is not None, 0 if ids[k] is None else ids[k])):
        place += before is None or key(k) != key(before)
        places[k], before = place, k
    # equal texts are one
    first: dict[str, int] = {}
    number = np.fromiter((first.setdefault(x, len(first)) for x in texts), np.int64, len(texts))
    again = Counter(number.tolist())
    letters, grams = (np.array([f(x) for x in first], np.int32) for f in (t.letters_of, t.grams_of))
    coded, remembered = t.Codes(CODED), {}
    found: list[tuple[int, int, float, bool]] = []
    reach = np.searchsorted(sizes, sizes * (2 - least) / least + 1, "right")

    def put_out() -> pa.RecordBatch:
        left, right, similarity, equal = (np.array(c) for c in zip(*found, strict=True))
        take = lambda c, k: rows[c].take(k).combine_chunks()
        columns = [take(c, k) for c in ("rpid", "bvid") for k in (left, right)]
        columns += [pa.array(similarity, pa.float64()), pa.array((at[right] - at[left]) // 1_000_000), pa.array(equal, pa.bool_())]
        found.clear()
        return pa.RecordBatch.from_arrays(columns, [*(f"{s}_{c}" for c in ("rpid", "bvid") for s in ("left", "right")), "similarity", "seconds_apart", "equal"])

    for i in np.flatnonzero(reach > np.arange(1, len(texts) + 1)).tolist():
        js = np.arange(i + 1, reach[i])
        later = np.where(places[js] > places[i], js, i)
        wanted = (np.abs(at[js] - at[i]) < (seconds + 1) * 1_000_000) & (videos[js] != videos[i]) & (places[js] != places[i]) & mine[js] & own[later]
        if low < high:
            wanted &= part[js] != part[i]
        js = js[wanted]
        total = sizes[js] + sizes[i]
        near = 2 * np.minimum(letters[number[js]], letters[number[i]]).sum(1) >= least * total
        js, total = js[near], total[near]
        js = js[np.minimum(grams[number[js]], grams[number[i]]).sum(1) >= t.least_shared_grams(total, least)]
        asked: list[tuple[int, int, int, tuple[int, int] | None]] = []
        for j in js.tolist():
            left, right = (i, j) if places[i] < places[j] else (j, i)
            both = (int(number[left]), int(number[right]))
            if both[0] == both[1]:
                found.append((left, right, 1.0, True))
            elif both not in remembered:
                asked.append((j, left, right, both if again[both[0]] > 1 or again[both[1]] > 1 else None))
            elif remembered[both] is not None:
                found.append((left, right, remembered[both], False))
        for some in parted(asked, sizes):
            ratios = t.ratios_of(texts[i], [texts[j] for j, *_ in some], np.array([left == i for _, left, *_ in some]), least, coded)
            for (_, left, right, both), similarity in zip(some, ratios, strict=True):
                if both:
                    if len(remembered) >= REMEMBERED:
                        remembered.clear()
                    remembered[both] = similarity
                if similarity is not None:
                    found.append((left, right, similarity, False))
            if len(found) >= PAIRS:
                yield put_out()
        if asked:
            coded(texts[i]).marks = None
        if len(found) >= PAIRS:
            yield put_out()
    if found:
        yield put_out()


def parted(asked: list[tuple], sizes: np.ndarray) -> Iterator[list[tuple]]:
    """asked in parts of at most about CODED characters of the texts that come first in them."""
    some, chars = [], 0
    for one in asked:
        some.append(one)
        chars += int(sizes[one[0]])
        if chars >= CODED:
            yield some
            some, chars = [], 0
    if some:
        yield some
