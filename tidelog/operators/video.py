"""Analytics of single videos; every function works on all videos at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.windows import within


def hot_turnover(pages: DataFrame, on_page: DataFrame, top_n: int) -> DataFrame:
    """Adjacent page-1 snapshots of each video: retained, entered, exited and the rate of change.

    pages: page_id, bvid, captured_at (empty ones count); on_page: page_id, position, rpid.
    """
    top = on_page.where(F.col("position") <= top_n).groupBy("page_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "rpid"))), lambda x: x["rpid"])).alias("now"))
    none = F.array().cast("array<bigint>")
    listed = pages.join(top, "page_id", "left").withColumn("now", F.coalesce("now", none))
    w = Window.partitionBy("bvid").orderBy("captured_at", "page_id")
    p = listed.withColumn("was", F.lag("now").over(w)).withColumn("previous_page_id", F.lag("page_id").over(w)).where("was is not null")
    retained = F.size(F.array_intersect("was", "now"))
    return p.select(
        "bvid", "previous_page_id", F.col("page_id").alias("current_page_id"), "captured_at", retained.alias("retained"), F.array_sort(F.array_except("now", "was")).alias("entered"), F.array_sort(F.array_except("was", "now")).alias("exited"),
        (1 - retained / F.greatest(F.size("was"), F.size("now"), F.lit(1))).alias("turnover_rate"),
    )


def metric_replay(metrics: DataFrame, since: datetime, until: datetime, counters: tuple[str, ...]) -> DataFrame:
    """Snapshots in the window with seconds and deltas since the one before, which may be older than the window."""
    w = Window.partitionBy("bvid").orderBy("captured_at", "raw_payload_id")
    p = metrics.where(F.col("captured_at") < F.lit(until))
    for c in ("captured_at", *counters):
        p = p.withColumn(f"was_{c}", F.lag(c).over(w))
    elapsed = F.floor((F.unix_micros("captured_at") - F.unix_micros("was_captured_at")) / 1_000_000)
    return within(p, "captured_at", since, until).select("bvid", "captured_at", "raw_payload_id", elapsed.alias("elapsed_seconds"), *((F.col(c) - F.col(f"was_{c}")).alias(f"{c}_delta") for c in counters))


def hot_replay(pages: DataFrame, on_page: DataFrame, media: DataFrame, top_n: int) -> DataFrame:
    """Each snapshot with its comments in order, each with its media in order; empty snapshots stay."""
    pictures = media.groupBy("comment_observation_id").agg(F.array_sort(F.collect_list(F.struct("position", "media_source_id"))).alias("media"))
    comment = F.struct("position", "rpid", "comment_observation_id", "media")
    comments = on_page.where(F.col("position") <= top_n).join(pictures, "comment_observation_id", "left").groupBy("page_id").agg(F.array_sort(F.collect_list(comment)).alias("comments"))
    return pages.join(comments, "page_id", "left").withColumn("comments", F.coalesce("comments", F.array()))


def visibility_replay(events: DataFrame, obs: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Visibility events from since to before until, with the observations before and after as evidence, where there are any."""
    events = within(events, "created_at", since, until)
    seen = lambda side: obs.select(F.col("id").alias(f"{side}_id"), F.col("raw_payload_id").alias(f"{side}_raw_payload_id"), F.col("captured_at").alias(f"{side}_captured_at"))
    return events.join(seen("previous"), "previous_id", "left").join(seen("current"), "current_id", "left")


def view_growth(metrics: DataFrame, since: datetime, now: datetime) -> DataFrame:
    """Views now less views at `since` (or the earliest after it); null without two snapshots, at least 0."""
    t, v = F.col("captured_at"), F.col("view_count")
    known = metrics.where(v.isNotNull() & (t <= F.lit(now)))
    old, later = t <= F.lit(since), t > F.lit(since)
    g = known.groupBy("bvid").agg(F.max_by(v, t).alias("last"), F.max(t).alias("last_at"), F.max_by(F.when(old, v), F.when(old, t)).alias("base"), F.max(F.when(old, t)).alias("base_at"), F.min_by(F.when(later, v), F.when(later, t)).alias("first"), F.min(F.when(later, t)).alias("first_at"))
    base, at = F.coalesce("base", "first"), F.coalesce("base_at", "first_at")
    return g.select("bvid", F.when(at != F.col("last_at"), F.greatest(F.col("last") - base, F.lit(0))).alias("view_growth"))


def latest_availability(videos: DataFrame, snapshots: DataFrame) -> DataFrame:
    """available of each video: its latest status is visible, or it has none."""
    last = snapshots.groupBy("bvid").agg(F.max_by("status", F.struct("captured_at", "raw_payload_id")).alias("status"))
    return videos.join(last, "bvid", "left").select("bvid", (F.coalesce("status", F.lit("visible")) == "visible").alias("available"))
