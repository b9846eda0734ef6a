"""Folds in event-time order over streams, with typed state, event-time timers and bounded state.

Rows wait in their key's state until the watermark has passed their time; a timer then folds all that
have become due, in order of (at, id). So the result is that of one fold over all rows in order, however
the rows are spread over triggers, as long as a row is at most the watermark's delay behind. A row that
comes later than that, after a later one of its key was folded, is counted in the key's state and put
out as late instead of being folded. A key that has been silent for `keep` is forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a fold that come too late are put out with this kind.
LATE = "late"
#: A time after all others; a row of it lets the watermark pass everything before.
END = datetime(2200, 1, 1, tzinfo=UTC)


#: Rows of a key that a fold holds in memory at a time, at most twice as many while they are chosen.
AT_A_TIME = 400_000
#: Rows of a key that come together from which on they wait as one packed table, as the state takes each row for itself dearly.
PACKED = 128
#: Bytes of columns that are chosen at a time of packed rows, where this is more rows than AT_A_TIME; twice as many meanwhile.
CHOSEN = 32 << 20
#: Bytes of columns that are packed together; the state store reads a key's whole list when one is appended.
APPENDED = 8 << 20
TYPES = {"bigint": pa.int64(), "long": pa.int64(), "string": pa.string()}


def plain(column: pd.Series) -> list:
    """A column's values as the state stores take them; pandas makes whole numbers beside nulls floats."""
    whole = int if column.dtype.kind == "f" else lambda v: v
    return [None if v is None or v != v else whole(v) for v in column.tolist()]


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names_of(schema), dtype=object)


def names_of(schema: str) -> list[str]:
    return [f.strip().split()[0] for f in schema.split(",")]


def least(rows: Iterable[tuple], order: Callable, limit: int) -> list[tuple]:
    """The `limit` first rows in an order, without holding more than twice as many."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == 2 * limit:
            held.sort(key=order)
            del held[limit:]
    held.sort(key=order)
    return held[:limit]


def table(part: pd.DataFrame, schema: str) -> pa.Table:
    kinds = dict(f.split() for f in schema.split(","))
    return pa.table({name: pa.Array.from_pandas(part[name], type=TYPES[kind]) for name, kind in kinds.items()})


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    rows = rows.combine_chunks()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy()


def least_of(tables: Iterable[pa.Table], after: tuple | None, mark: int) -> tuple[pa.Table | None, tuple | None]:
    """The first rows by at, id and place behind `after`, of those that are due, and at, id and place of the last one.

    Places are those in all tables. Without holding more than twice as many rows as CHOSEN bytes, or AT_A_TIME, are.
    """
    held: list[pa.Table] = []
    place, many, limit = 0, 0, AT_A_TIME

    def first() -> pa.Table:
        rows = pa.concat_tables(held).combine_chunks()
        return rows.take(np.lexsort((numbers(rows["_place"]), numbers(rows["id"]), numbers(rows["at"])))[:limit])

    for t in tables:
        at, id_, places = numbers(t["at"]), numbers(t["id"]), np.arange(place, place + len(t))
        wanted = at // 1000 + 1 <= mark
        if after is not None:
            wanted &= (at > after[0]) | (at == after[0]) & ((id_ > after[1]) | (id_ == after[1]) & (places > after[2]))
        place += len(t)
        limit = max(limit, CHOSEN * len(t) // max(t.nbytes, 1)) if not many else limit
        held.append(t.append_column("_place", pa.array(places)).filter(pa.array(wanted)))
        many += len(held[-1])
        if many >= 2 * limit:
            held = [first()]
            many = len(held[0])
    if not many:
        return None, None
    rows = first()
    return rows.drop_columns("_place"), tuple(int(numbers(rows[c])[-1]) for c in ("at", "id", "_place"))


class OrderedFold(StatefulProcessor):
    """fold(held, rows) -> (held, out): held is the tuple of what is kept (None at first), rows are tuples in order.

    late(rows, n) -> out: for rows that came too late, n of them so far. out: tuples. Times are in microseconds.
    """

    def __init__(self, rows: str, held: str, out: str, fold: Callable, late: Callable, keep: int):
        self.rows, self.kept, self.out, self.fold, self.too_late, self.keep = rows, held, out, fold, late, keep
        self.names = names_of(rows)
        self.at, self.id = self.names.index("at"), self.names.index("id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.kept)
        self.pending = handle.getListState("pending", self.rows)
        self.packed = handle.getListState("packed", "body binary")
        self.told = handle.getValueState("told", "folded_at bigint, late bigint")

    def order(self, r: tuple) -> tuple:
        return r[self.at], r[self.id]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        folded_at, n = self.told.get() if self.told.exists() else (None, 0)
        first, late, waiting = None, [], []
        for part in rows:
            if folded_at is not None:
                early = part["at"] < folded_at
                late += self.tuples(part[early])
                part = part[~early]
            if len(part):
                if len(part) < PACKED and not waiting:
                    self.pending.appendList(self.tuples(part))
                else:
                    waiting.append(table(part, self.rows))
                    if sum(t.nbytes for t in waiting) >= APPENDED:
                        self.pack(waiting)
                first = int(part["at"].min()) if first is None else min(first, int(part["at"].min()))
        if waiting:
            self.pack(waiting)
        if late:
            n += len(late)
            self.told.update((folded_at, n))
            yield frame(self.too_late(sorted(late, key=self.order), n), self.out)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)

    def pack(self, waiting: list[pa.Table]) -> None:
        self.packed.appendList([(packed(pa.concat_tables(waiting)),)])
        waiting.clear()

    def tuples(self, part: pd.DataFrame) -> list[tuple]:
        return list(zip(*(plain(part[c]) for c in self.names), strict=True))

    def due(self, mark: int) -> Iterator[list[tuple]]:
        """The rows that the watermark has passed, in order, at most AT_A_TIME of them at once."""
        last = None
        if not self.packed.exists():
            # rows with their places in the list, which tell equal ones apart
            order = lambda x: (*self.order(x[1]), x[0])
            while self.pending.exists():
                rows = least((x for x in enumerate(self.pending.get()) if self.is_due(x[1], mark) and (last is None or order(x) > last)), order, AT_A_TIME)
                if not rows:
                    return
                last = order(rows[-1])
                yield [r for _, r in rows]
                if len(rows) < AT_A_TIME:
                    return
            return
        while True:
            rows, last = least_of(self.tables(), last, mark)
            if rows is None:
                return
            for n in range(0, len(rows), AT_A_TIME):
                yield list(zip(*(c.to_pylist() for c in rows.slice(n, AT_A_TIME).select(self.names).columns), strict=True))

    def is_due(self, row: tuple, mark: int) -> bool:
        return row[self.at] // 1000 + 1 <= mark

    def tables(self) -> Iterator[pa.Table]:
        """All that waits."""
        rows = iter(self.pending.get() if self.pending.exists() else ())
        while part := list(islice(rows, 10_000)):
            yield table(frame(part, self.rows), self.rows)
        for (body,) in self.packed.get():
            yield unpacked(body)

    def keep_waiting(self, mark: int, changed: bool) -> int | None:
        """Forget the rows that were folded; the time of the first one that is left."""
        first = []
        if self.pending.exists():
            rest = [r for r in self.pending.get() if not self.is_due(r, mark)]
            first += [min(r[self.at] for r in rest)] if rest else []
            if changed:
                self.pending.put(rest) if rest else self.pending.clear()
        if self.packed.exists():
            bodies = []
            for (body,) in self.packed.get():
                rows = unpacked(body)
                at = numbers(rows["at"])
                waits = at // 1000 + 1 > mark
                if waits.any():
                    bodies.append((body if waits.all() else packed(rows.filter(pa.array(waits))),))
                    first.append(int(at[waits].min()))
            if changed:
                self.packed.put(bodies) if bodies else self.packed.clear()
        return min(first, default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        folded_at, n = self.told.get() if self.told.exists() else (None, 0)
        before, held, last = folded_at, self.held.get() if self.held.exists() else None, None
        for rows in self.due(mark):
            held, out = self.fold(held, rows)
            last = rows[-1][self.at]
            yield frame(out, self.out)
        if last is not None:
            folded_at = last
            self.held.update(held)
            self.told.update((folded_at, n))
        first = self.keep_waiting(mark, last is not None)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        elif folded_at is not None and folded_at // 1000 + self.keep <= mark:
            self.held.clear()
            self.told.clear()
        elif folded_at is not None and folded_at != before:
            self.handle.registerTimer(folded_at // 1000 + self.keep)

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, time: str, rows: str, held: str, out: str, fold: Callable, late: Callable, delay: str, keep_days: int) -> DataFrame:
    """stream folded by key in order of `time` (a timestamp) and id.

    rows: the schema of what the fold sees, with key, at (microseconds) and id; the stream has the other columns.
    """
    names = names_of(rows)
    # only the time in microseconds goes on, so Spark hands rows behind the watermark over, too
    seen = stream.withWatermark(time, delay).withColumn("at", F.unix_micros(time)).select(*names)
    return seen.groupBy(key).transformWithStateInPandas(OrderedFold(rows, held, out, fold, late, keep_days * 86_400_000), out, "Append", "EventTime")


CHANGE = "rpid long, bvid string, previous_id long, current_id long, event_type string, old_value string, new_value string, created_us long"
CHANGE_HELD = "id bigint, hash string, likes string, replies string, sort_mode string, position string"
CHANGED = names_of(CHANGE_HELD)
#: Kind, and the column that changes.
CHANGES = (("content_hash_changed", "hash"), ("like_bucket_changed", "likes"), ("reply_count_changed", "replies"), ("hot_position_changed", "position"))


def change_fold(held: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    """Changes of each observation against the one before."""
    out = []
    for rpid, bvid, at, *now in rows:
        was = None if held is None else dict(zip(CHANGED, held, strict=True))
        one = dict(zip(CHANGED, now, strict=True))
        if was is None:
            out.append((rpid, bvid, None, one["id"], "first_seen", None, None, at))
        else:
            both_hot = was["sort_mode"] == one["sort_mode"] == "hot"
            out += [(rpid, bvid, was["id"], one["id"], kind, was[c], one[c], at) for kind, c in CHANGES if was[c] != one[c] and (both_hot or c != "position")]
        held = tuple(now)
    return held, out


def late_changes(rows: list[tuple], n: int) -> list[tuple]:
    return [(rpid, bvid, None, id_, LATE, None, str(k), at) for k, (rpid, bvid, at, id_, *_) in enumerate(rows, n - len(rows) + 1)]


def state_changes(stream: DataFrame, values: dict, delay: str = "1 hour", keep_days: int = 90) -> DataFrame:
    """derive.state_changes() of a stream of observations; late ones come as late, numbered in new_value.

    values: columns of CHANGE_HELD but id, as expressions of the stream.
    """
    rows = "rpid bigint, bvid string, at bigint, " + CHANGE_HELD
    shown = stream.withColumns({name: value.cast("string") for name, value in values.items()})
    out = folded(shown, "rpid", "captured_at", rows, CHANGE_HELD, CHANGE, change_fold, late_changes, delay, keep_days)
    return out.withColumn("created_at", F.timestamp_micros("created_us")).drop("created_us")


TIER = "bvid string, at_us long, id long, effective string, kind string"


def tiers(stream: DataFrame, order: tuple[str, ...], confirmations: int, delay: str = "1 hour", keep_days: int = 365) -> DataFrame:
    """Effective tiers after each assessment (bvid, at, id, desired), with hysteresis as state; late ones leave it as it is.

    order: tiers from the highest to the lowest, from which a key starts.
    """
    rank = {t: n for n, t in enumerate(order)}

    def fold(held: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        effective, candidate, n = held or (order[-1], None, 0)
        out = []
        for bvid, at, id_, desired in rows:
            if rank[desired] <= rank[effective]:
                effective, candidate, n = desired, None, 0
            else:
                n = n + 1 if candidate == desired else 1
                effective, candidate, n = (desired, None, 0) if n >= confirmations else (effective, desired, n)
            out.append((bvid, at, id_, effective, "folded"))
        return (effective, candidate, n), out

    def late(rows: list[tuple], n: int) -> list[tuple]:
        return [(bvid, at, id_, None, LATE) for bvid, at, id_, _ in rows]

    timed = stream.withColumnRenamed("at", "assessed_at")
    out = folded(timed, "bvid", "assessed_at", "bvid string, at bigint, id bigint, desired string", "effective string, candidate string, n bigint", TIER, fold, late, delay, keep_days)
    return out.withColumn("at", F.timestamp_micros("at_us")).drop("at_us")


SPIKE = "keyword string, bucket long, was long, n long, kind string"


def spikes(counts: DataFrame, seconds: int, multiplier: float, least: int, delay: str = "0 seconds", keep_days: int = 30) -> DataFrame:
    """Jumps of closed windows (keyword, bucket, n) against the window before, a missing one counting 0.

    counts: a stream of the table that jobs.closed_counts() writes. A window that comes after a later one of its
    keyword was folded is put out as late.
    """

    def fold(held: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        out = []
        for keyword, _, bucket, n in rows:
            if held is not None:
                was = held[1] if held[0] == bucket - seconds else 0
                if n >= max(was * multiplier, least):
                    out.append((keyword, bucket, was, n, "folded"))
            held = (bucket, n)
        return held, out

    def late(rows: list[tuple], n: int) -> list[tuple]:
        return [(keyword, bucket, 0, count, LATE) for keyword, _, bucket, count in rows]

    timed = counts.withColumn("starts", F.timestamp_seconds("bucket")).withColumn("id", F.col("bucket"))
    return folded(timed, "keyword", "starts", "keyword string, at bigint, id bigint, n bigint", "bucket bigint, n bigint", SPIKE, fold, late, delay, keep_days)


def in_triggers(rows: DataFrame, folder: str, time: str, parts: int = 3, end: dict | None = None) -> DataFrame:
    """rows as a stream of `parts` triggers, each of as many files as tasks run at once, that are followed by a row at END (with the values of end, else nulls)."""
    spark, last = rows.sparkSession, {time: END} | (end or {})
    files = spark.sparkContext.defaultParallelism
    rows.repartition(parts * files).write.mode("append").parquet(folder)
    spark.range(1, numPartitions=1).select(*(F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema)).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
