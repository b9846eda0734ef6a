"""Removal of long repeated passages by compaction of a De Bruijn graph of word windows.

Every window of `length` words is an edge of the graph, from the node of its first length-1 words to
that of its last. Windows in a row whose least `core`-word hash lies at the same place form one path
(equal windows have it at the same offset, so equal stretches fall into the same paths), and a path is
one row with its source coordinates instead of a row for each edge. A path and a window are known by a
digest of their own words, read at their coordinates, so equal ones are equal word by word (but for
64 bits of chance, and as many of the core's). Joined and counted in Spark:

- a path that occurs again is nonbranching inside: all its windows are repeated;
- a path that occurs once, and whose core no other path has, repeats nowhere;
- where several paths have a core, the graph branches inside them. Only there are single windows
  looked at: one occurrence of each such path is taken up again in its source text by its
  coordinates, and the windows that it shares with another path are repeated;
- of the repeated edges that are left, each node's ways in and out are counted. Joined back to the
  occurrences, they tell which end at a node with one way in and one out: there the path goes on, and
  two stretches of a row become one. What stays are the maximal spans between branches.

Paths and texts go into a shuffle only where a bitmap of fixed size says that they may meet others.
Nothing is sampled: a window is found exactly where its word sequence starts elsewhere too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Windows, WordHasher, checkpointed, digests_of, gram_hashes, mixed, raw_text, words

SEGMENT = 1 << 22


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the place of its least one (by its upper 40 bits; the first of equals)."""
    keys = (values & ~np.uint64(0xFFFFFF)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[: len(keys) - span], keys[span:])
        span *= 2
    rest = width - span
    keys = np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys
    return (keys & np.uint64(0xFFFFFF)).astype(np.int64)


def digests(found: list[bytes], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Digests of the words first to last (exclusive), for each pair."""
    whole = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    low, high = np.concatenate(([0], ends))[first].tolist(), (ends[last - 1] - 1).tolist()
    return digests_of(map(whole.__getitem__, map(slice, low, high)))


def paths(found: list[bytes], hashes: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """Core hash, first window and number of windows of a document's paths. hashes: of its words."""
    if len(hashes) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    cores = gram_hashes(hashes, core)
    width, total = length - core + 1, len(hashes) - length + 1
    parts = []
    for at in range(0, total, SEGMENT):
        n = min(SEGMENT, total - at)
        place = least_places(cores[at : at + n + width - 1], width)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        parts.append((cores[at + place[first]], at + first, np.diff(first, append=n)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


BITS = 1 << 27


def bitmap_of(values: DataFrame, column: str):
    """A broadcast bitmap of fixed size (16 MB) with the bit of each value (a well-mixed long) set.

    It only spares rows that a join would drop: where it is crowded, more rows reach the join.
    """
    place = F.pmod(F.col(column), F.lit(BITS))
    parts = values.select(F.floor(place / 32768).alias("part"), (place % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return values.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.astype(np.int64) & (BITS - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _maybe(bitmap, key: str) -> Column:
    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(in_bitmap(bitmap.value, batch.to_numpy(zero_copy_only=False)), pa.bool_())

    return run(F.col(key))


PATH = "core long, path long, row_key long, span long, left long, right long"


def _path_rows(rows: DataFrame, length: int, core: int, wanted=None) -> DataFrame:
    """core and path (digest) of every path; or those with wanted cores, with row_key, span (first window * 64 + windows - 1) and end nodes."""
    columns = PATH if wanted else "core long, path long"
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, windows = WordHasher(), Windows()

        def of(raw: bytes | None, key: int) -> tuple[np.ndarray, ...]:
            found = words(raw)
            hashes = hasher(found)
            cores, first, count = paths(found, hashes, length, core)
            if wanted is None:
                return cores.view(np.int64), digests(found, first, first + count + length - 1).view(np.int64)
            kept = in_bitmap(wanted.value, cores.view(np.int64))
            cores, first, count = cores[kept], first[kept], count[kept]
            nodes = windows(hashes, length - 1).view(np.int64) if len(cores) else np.empty(0, np.int64)
            return cores.view(np.int64), digests(found, first, first + count + length - 1).view(np.int64), np.full(len(cores), key), first * 64 + count - 1, nodes[first], nodes[first + count]

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [of(*r) for r in zip(part.column("raw").to_pylist(), part.column("row_key").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

    return rows.select("row_key", "raw").mapInArrow(run, columns)


def _window_rows(texts: DataFrame, length: int, core: int) -> DataFrame:
    """core, window (digest), row_key, first, times (of the path) and end nodes of each window of the listed paths.

    texts: raw, row_key and taken, an array of (span, times).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, windows = WordHasher(), Windows()
        for batch in batches:
            for raw, key, taken in zip(*(batch.column(c) for c in ("raw", "row_key", "taken")), strict=True):
                found = words(raw.as_py())
                hashes = hasher(found)
                nodes, cores = windows(hashes, length - 1).view(np.int64), gram_hashes(hashes, core)
                span = taken.values.field("span").to_numpy()
                times = taken.values.field("times").to_numpy()
                n = span % 64 + 1
                first = np.repeat(span // 64 - (np.cumsum(n) - n), n) + np.arange(n.sum())
                width = length - core + 1
                where = span // 64
                place = [least_places(cores[f : f + width], width)[0] + f for f in where.tolist()]
                out = (np.repeat(cores[place].view(np.int64), n), digests(found, first, first + length).view(np.int64), np.full(len(first), key.as_py()), first, np.repeat(times, n), nodes[first], nodes[first + 1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["core", "window", "row_key", "first", "times", "left", "right"])

    return texts.select("raw", "row_key", "taken").mapInArrow(run, "core long, window long, row_key long, first long, times long, left long, right long")


def compacted(first: np.ndarray, count: np.ndarray, through: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of a row's stretches, those made one between which the path goes on."""
    order = np.argsort(first, kind="stable")
    first, count, through = first[order], count[order], through[order]
    begins = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1] + count[:-1]) | ~through[:-1])))
    return first[begins], np.add.reduceat(count, begins)


def _digest(raw: Column, spans: Column, length: int) -> Column:
    """n_words, n_removed, kept_sha256, kept text and spans (first word, words) of a text, less the words of the spans."""

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept_sha256:string,kept:binary,spans:array<struct<start:long,length:long>>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        for texts, marks in batches:
            out = []
            for text, mark in zip(texts, marks, strict=True):
                kept = found = words(text.as_py())
                removed = []
                if mark.is_valid and len(mark):
                    span, through = (mark.values.field(n).to_numpy(zero_copy_only=False) for n in ("span", "through"))
                    first, count = compacted(span // 64, span % 64 + 1, through)
                    change = np.zeros(len(found) + 1, np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + count + length - 1, -1)
                    keep = (np.cumsum(change[:-1]) == 0).tolist()
                    kept = [w for w, k in zip(found, keep, strict=True) if k]
                    removed = [{"start": a, "length": n + length - 1} for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                joined = b" ".join(kept)
                out.append((len(found), len(found) - len(kept), hashlib.sha256(joined).hexdigest(), joined, removed))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return run(raw, spans)


def remove_repeats(documents: DataFrame, length: int = 35, core: int = 12) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (text of the words that stay) and spans of each row.

    spans: first word and number of words of the maximal repeated stretches between branches of the
    graph; they may overlap. Null, empty and short texts have no windows and lose nothing; texts count
    whole, however long; an empty table gives no rows. Rows that repeat an id and a text count as
    occurrences of their windows, so all of a long one's words go; null ids are ids like others. Other
    columns are not read. length may be at most core + 63.
    """
    rows = documents.select("doc_id", raw_text().alias("raw"), F.xxhash64("doc_id", "text").alias("row_key"))
    cores = _path_rows(rows, length, core).groupBy("core").agg(F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high")).where("n > 1")
    again = checkpointed(cores.select("core", (F.col("low") != F.col("high")).alias("branches")))
    drawn = checkpointed(_path_rows(rows, length, core, bitmap_of(again, "core")).join(again, "core"))

    # where the graph branches: paths that occur once, among others with their core
    branching = drawn.where("branches").groupBy("core", "path").agg(F.count("*").alias("times"), F.min("row_key").alias("row_key"), F.min_by("span", "row_key").alias("span"))
    counted = checkpointed(branching)
    some = counted.where("times = 1").select("core").distinct()
    taken = checkpointed(counted.join(some, "core").groupBy("row_key").agg(F.collect_list(F.struct("span", "times")).alias("taken")))
    # a row that is repeated gives its windows twice, but then all of its paths occur twice anyway
    texts = rows.where(_maybe(bitmap_of(taken, "row_key"), "row_key")).join(taken, "row_key")
    windows = checkpointed(_window_rows(texts, length, core))
    repeated = windows.groupBy("core", "window").agg(F.sum("times").alias("total"), F.min("times").alias("low"), F.min("left").alias("left"), F.min("right").alias("right")).where("total > 1")
    single = windows.where("times = 1").join(repeated.where("low = 1").select("core", "window"), ["core", "window"]).select("row_key", (F.col("first") * 64).alias("span"), "right")

    twice = drawn.where("branches").join(counted.where("times > 1").select("core", "path"), ["core", "path"]).select("row_key", "span", "right")
    found = drawn.where("not branches").select("row_key", "span", "right").unionByName(twice).unionByName(single)
    edges = drawn.where("not branches").select("path", "left", "right").distinct().select("left", "right").unionByName(repeated.select("left", "right"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("right").alias("node"), F.lit(1).alias("ways_in")), F.struct(F.col("left").alias("node"), F.lit(0).alias("ways_in")))).alias("e")).select("e.*")
    on = ends.groupBy(F.col("node").alias("right")).agg(F.sum("ways_in").alias("ways_in"), F.count("*").alias("ways")).where("ways_in = 1 and ways = 2")
    # computed anew, the node is dealt anew, so that the join can split one that very many paths end at
    on = on.select(F.col("right").bitwiseXOR(F.lit(0)).alias("right"), F.lit(True).alias("through"))
    spans = found.join(on, "right", "left").select("row_key", F.struct("span", F.coalesce("through", F.lit(False)).alias("through")).alias("s"))
    # rows that are repeated have the same spans, of which one each stays
    marks = checkpointed(spans.groupBy("row_key").agg(F.collect_set("s").alias("spans")))
    marked = rows.withColumn("marked", _maybe(bitmap_of(marks, "row_key"), "row_key"))
    none = F.lit(None).cast("array<struct<span:bigint,through:boolean>>")
    clean = marked.where("not marked").select("doc_id", _digest(F.col("raw"), none, length).alias("d"))
    joined = marked.where("marked").join(marks, "row_key", "left").select("doc_id", _digest(F.col("raw"), F.col("spans"), length).alias("d")).unionByName(clean)
    return joined.select("doc_id", "d.n_words", "d.n_removed", "d.kept_sha256", F.col("d.kept").cast("string").alias("kept"), "d.spans")
