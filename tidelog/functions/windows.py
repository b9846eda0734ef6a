"""Half-open time windows, epoch-aligned buckets, dense grids, and joins in time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import checkpointed

#: The most buckets of a grid; a fixed value of the archive's queries.
MOST_BUCKETS = 10_000


def check_window(since: datetime, until: datetime) -> None:
    if since.tzinfo is None or until.tzinfo is None:
        raise ValueError("since and until need a time zone")
    if until <= since:
        raise ValueError("a window ends after it begins")


def check_range(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


def within(df: DataFrame, time: str, since: datetime | None, until: datetime | None) -> DataFrame:
    if since is not None:
        df = df.where(F.col(time) >= F.lit(since))
    if until is not None:
        df = df.where(F.col(time) < F.lit(until))
    return df


def epoch(time: datetime) -> int:
    return int(time.timestamp())


def bucket(time: Column, seconds: int) -> Column:
    """The start of a time's epoch-aligned bucket, in epoch seconds."""
    return F.floor(F.unix_seconds(time) / seconds) * seconds


def grid(df_or_session, since: datetime, until: datetime, seconds: int) -> DataFrame:
    """bucket: starts from the one that holds since to before until."""
    spark = getattr(df_or_session, "sparkSession", df_or_session)
    first = epoch(since) - epoch(since) % seconds
    last = -(-int(until.timestamp() * 1_000_000) // 1_000_000)
    if -(-(last - first) // seconds) > MOST_BUCKETS:
        raise ValueError(f"the window has more than {MOST_BUCKETS} buckets")
    return spark.range(first, last, seconds).select(F.col("id").alias("bucket"))


#: Left rows of one key of a band join that one task takes.
PER_KEY = 20_000


def band_join(left: DataFrame, right: DataFrame, time: str, seconds: int, condition: Column, *equal: str, forward: bool = False, per_key: int = PER_KEY) -> DataFrame:
    """Pairs whose times are at most `seconds` apart (whole seconds, truncated), as an equi-join on buckets.

    equal: columns that pairs agree in, left_<name> and right_<name>; they are keys of the join too.
    Columns must be distinct but for `time`, which becomes left_<time> and right_<time>. The left side goes
    to its bucket and both neighbours, the right side to its own, so a pair meets once. forward: only pairs
    of which the right time is not before the left one, for which two buckets do. A key (a busy bucket, a
    text that is everywhere) with more than per_key left rows is split: its left rows are dealt into as
    many parts as it takes, and its right rows go to each.
    """
    width = seconds + 1
    a, b = F.col(f"left_{time}"), F.col(f"right_{time}")
    own = lambda t: F.floor(F.unix_seconds(t) / width)
    left = left.withColumnRenamed(time, f"left_{time}").withColumn("left_band", F.explode(F.array(*(own(a) + k for k in ((0, 1) if forward else (-1, 0, 1))))))
    right = right.withColumnRenamed(time, f"right_{time}").withColumn("right_band", own(b))
    apart = F.floor(F.abs(F.unix_micros(b) - F.unix_micros(a)) / 1_000_000)
    if forward:
        condition = (a <= b) & condition
    names = ["band", *equal]
    busy = left.groupBy(*(F.col(f"left_{c}").alias(f"busy_{c}") for c in names)).agg(F.count("*").alias("_n")).where(F.col("_n") > per_key).withColumn("_parts", F.ceil(F.col("_n") / per_key).cast("int")).drop("_n")

    def dealt(df: DataFrame, side: str) -> DataFrame:
        same = [F.col(f"{side}_{c}") == F.col(f"busy_{c}") for c in names]
        return df.join(busy, same, "left").drop(*(f"busy_{c}" for c in names))

    parts = F.coalesce("_parts", F.lit(1))
    left_dealt = dealt(left, "left").withColumn("_left_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    right_dealt = dealt(right, "right").withColumn("_right_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    keys = [F.col(f"left_{c}") == F.col(f"right_{c}") for c in names]
    pairs = left_dealt.join(right_dealt, [*keys, F.col("_left_part") == F.col("_right_part")])
    return pairs.where((apart <= seconds) & condition).drop("left_band", "right_band", "_left_part", "_right_part")


def as_of(df: DataFrame, key: str, time: str, until: datetime, *ties: str, strict: bool = True) -> DataFrame:
    """The last row of each key before (or at) a time; of equal times that of the greatest `ties`."""
    limit = F.col(time) < F.lit(until) if strict else F.col(time) <= F.lit(until)
    last = df.where(limit).groupBy(key).agg(F.max_by(F.struct("*"), F.struct(time, *ties)).alias("r"))
    return last.select("r.*")


def newest(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The n newest rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with the place (from 1) of each row in an order, without a window over all rows.

    Rows are sorted in ranges; the sizes of the ranges, a number a task, tell where each begins.
    """
    place = F.monotonically_increasing_id()
    # stored, so that a lost task does not cut other ranges
    cut = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.shiftrightunsigned(place, 33)).withColumn("_at", place.bitwiseAND(F.lit((1 << 33) - 1))))
    begins, total = [], 0
    for r in cut.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        begins.append((r["_range"], total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(begins, "_range long, _first long")
    return cut.join(F.broadcast(first), "_range").withColumn(name, F.col("_first") + F.col("_at") + 1).drop("_range", "_at", "_first")
