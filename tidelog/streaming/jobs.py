"""Structured Streaming forms of the folds: pages land, keyed state advances.

Folds in event-time order are in ordered.py. For visibility, "previous" is event-time order within a trigger
and arrival order across triggers; a row that comes after a later one of its key is emitted against that one.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.functions.values import like_bucket
from tidelog.operators import assess, derive, flatten, quality
from tidelog.operators.event import matched
from tidelog.session import DEFAULTS
from tidelog.streaming import ordered

#: One stream at a time starts with settings of its own, as threads share the session.
STARTING = threading.RLock()
#: The state store that holds typed state and timers (ordered.py), which Spark's default can't.
PROVIDER, ROCKS_DB = "spark.sql.streaming.stateStore.providerClass", DEFAULTS["spark.sql.streaming.stateStore.providerClass"]


def intake(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each observation id once within the watermark; later repeats are dropped by the sink's key."""
    return stream.withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(["id"])


def flat_pages(stream: DataFrame, kind: str = "reply") -> DataFrame:
    """The batch flattening over a stream of payloads."""
    return flatten.comment_rows(flatten.parsed_pages(stream, kind))


def state_changes(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Change events with the last observation of each comment as state, in event-time order (ordered.state_changes())."""
    values = {"hash": F.sha2(F.trim("content"), 256), "likes": like_bucket(F.col("like_count")), "replies": F.col("reply_count"), "sort_mode": F.col("sort_mode"), "position": F.col("position")}
    return ordered.state_changes(stream, values, delay)


def visibility_events(stream: DataFrame) -> DataFrame:
    """folded, unfolded, disappeared and reappeared, with the last sighting of each comment as state. seen: false for marks of missing comments."""
    rows = stream.select("rpid", "bvid", "id", F.unix_micros("captured_at").alias("at"), "visibility", "seen")
    names, out = rows.columns, "rpid long, bvid string, previous_id long, current_id long, event_type string, old_visibility string, new_visibility string, at long"

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = [r for part in parts for r in zip(*(ordered.plain(part[c]) for c in names), strict=True)]
        held, events = visibility_fold(state.get if state.exists else (None, None, None), sorted(got, key=lambda r: (r[3], r[2])))
        state.update(held)
        yield ordered.frame(events, out)

    found = rows.groupBy("rpid").applyInPandasWithState(fold, out, "seen boolean, id long, visibility string", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("created_at", F.timestamp_micros("at")).drop("at")


def visibility_fold(held: tuple, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    """Events of rows (rpid, bvid, id, at, visibility, seen) in order; held: whether the last row was a sighting, and the last sighting's id and visibility."""
    was_seen, last_id, last = held
    out = []
    for rpid, bvid, id_, at, now, seen in rows:
        kinds = []
        if not seen and was_seen is not False:
            kinds.append(("disappeared", last if last is not None else "visible", "missing"))
        if seen and was_seen is False:
            kinds.append(("reappeared", "missing", now))
        if seen and last == "visible" and now == "folded":
            kinds.append(("folded", last, now))
        if seen and last == "folded" and now == "visible":
            kinds.append(("unfolded", last, now))
        out += [(rpid, bvid, last_id, id_ if seen else None, kind, old, new, at) for kind, old, new in kinds]
        was_seen = bool(seen)
        if seen:
            last_id, last = id_, now if now is not None else last
    return (was_seen, last_id, last), out


def keyword_counts(stream: DataFrame, keywords: list[str], seconds: int, delay: str = "1 hour") -> DataFrame:
    """Distinct comments and observations of keywords in the tumbling buckets that the watermark has closed (append mode).

    Observations are summed by comment first, so no state holds a list, and a closed bucket's state goes.
    """
    hits = matched(stream.withWatermark("captured_at", delay), keywords).select("rpid", F.window("captured_at", f"{seconds} seconds").alias("w"), F.explode("hits").alias("keyword"))
    each = hits.groupBy("keyword", "w", "rpid").agg(F.count("*").alias("n"))
    return each.groupBy("keyword", "w").agg(F.count("*").alias("distinct_comments"), F.sum("n").alias("observations")).select("keyword", F.unix_seconds("w.start").alias("bucket"), "distinct_comments", "observations")


def closed_counts(stream: DataFrame, keywords: list[str], seconds: int, delay: str = "1 hour") -> DataFrame:
    """Exact counts of windows that the watermark has closed, each comment once a keyword and window (append mode).

    Rows that come later than the delay are left out. Time advances by the rows with a keyword; a closed window's state goes.
    """
    hits = matched(stream.withWatermark("captured_at", delay), keywords).select("rpid", F.window("captured_at", f"{seconds} seconds").alias("w"), F.explode("hits").alias("keyword"))
    once = hits.dropDuplicates(["keyword", "w", "rpid"])
    return once.groupBy("keyword", "w").agg(F.count("*").alias("n")).select("keyword", F.unix_seconds("w.start").alias("bucket"), "n")


def tiers(stream: DataFrame, policy: assess.Policy, delay: str = "1 hour") -> DataFrame:
    """Effective tiers after each assessment (bvid, at, id, desired), in event-time order (ordered.tiers())."""
    return ordered.tiers(stream, assess.TIERS, policy.confirmations, delay)


def watchlist_upkeep(path: str, parts: int = 16):
    """A foreachBatch function that folds candidates into the table at path; a batch that runs again changes nothing.

    Of each comment only the candidates that its row rests on are kept (the best, the last, the last hot and
    the first one), in parts by comment. A batch rewrites the parts that it touches, as a new version.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("part", F.pmod(F.xxhash64("bvid", "rpid"), F.lit(parts)).cast("int"))
        touched = [r.part for r in new.select("part").distinct().collect()]  # at most `parts`
        before = [f"{path}/part={k}/batch={n}" for k, n in versions(spark, path, number).items() if k in touched]
        held = spark.read.option("basePath", path).parquet(*before).drop("batch") if before else new.limit(0)
        at = F.struct("captured_at", "id")
        key = ["part", "bvid", "rpid"]
        row = F.struct(*(c for c in batch.columns if c not in key))
        best = F.max_by(row, F.struct("priority", "captured_at", "id"))
        hot = F.max_by(row, F.when(F.col("hot_position").isNotNull(), at))
        kept = new.unionByName(held).groupBy(*key).agg(F.array_distinct(F.array(best, F.max_by(row, at), F.min_by(row, at), hot)).alias("kept"))
        rows = kept.select(*key, F.explode("kept").alias("k")).where("k is not null").select(*key, "k.*")
        rows.repartition(parts, "part").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)

    return fold


def versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The last batch (before one, if given) that wrote each part of a table of watchlist_upkeep()."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, int] = {}
    for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part=*/batch=*")) or []:
        part, batch = (int(x.split("=")[1]) for x in status.getPath().toString().rstrip("/").split("/")[-2:])
        if before is None or batch < before:
            found[part] = max(batch, found.get(part, -1))
    return found


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """The watch list that a table of watchlist_upkeep() amounts to."""
    last = [f"{path}/part={k}/batch={n}" for k, n in versions(spark, path).items()]
    return derive.watchlist(spark.read.option("basePath", path).parquet(*last).drop("part", "batch"))


def alert_upkeep(path: str, schema: str, now):
    """A foreachBatch function that moves the alert state at path on; states are kept by batch number."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{path}/batch={number - 1}") if number else spark.createDataFrame([], schema)
        quality.alert_transitions(state.select("alert_key", "active", "occurrences", "notified_at"), batch, now).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return fold


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last batch that alert_upkeep() wrote at path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*"))
    return max(int(s.getPath().getName().split("=")[1]) for s in found)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run over all that is there, then stop. complete results overwrite the folder."""
    spark, parts = stream.sparkSession, "spark.sql.shuffle.partitions"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    else:
        writer = writer.format("parquet").option("path", out)
    # a query takes the settings of the session that it starts from
    with settings(spark, {PROVIDER: ROCKS_DB, parts: str(min(int(spark.conf.get(parts)), 2 * spark.sparkContext.defaultParallelism))}):
        started = writer.start()
    started.awaitTermination()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which no other thread changes here meanwhile, and afterwards with its own again."""
    with STARTING:
        before = {k: spark.conf.get(k, None) for k in values}
        try:
            for k, v in values.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives over all that is there, as a table in a folder."""
    drain(stream, f"{folder}/out", f"{folder}/state", mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
