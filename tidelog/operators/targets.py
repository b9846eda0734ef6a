"""One log of an event's targets, folded into targets, keywords, attached videos and first tasks.

log: ts, seq (unique; orders rows of one time), op (add, set_active or attach), event_id, target_type, target_value (as shown),
normalized_value, priority, active (of set_active), extra (map), and of attach rows bvid, association_reason, confidence.
Every output is a grouped fold over the log's order, so late parts of a log only need to be read again with the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = ("event_id", "target_type", "normalized_value")


def at() -> Column:
    return F.struct("ts", "seq")


def targets(log: DataFrame) -> DataFrame:
    """target_id (the seq of its first row), shown value, greatest priority, state after the last row, merged extra, times.

    An addition makes a target active; what sets the state of a target that is not there yet says nothing.
    """
    rows = log.where(F.col("op").isin("add", "set_active"))
    added = F.when(F.col("op") == "add", at())
    facts = rows.groupBy(*TARGET).agg(
        F.min(added).alias("first"), F.max(added).alias("last_add"), F.max_by("target_value", added).alias("target_value"), F.max(F.when(F.col("op") == "add", F.col("priority"))).alias("priority"),
        F.max_by(F.when(F.col("op") == "add", True).otherwise(F.col("active")), at()).alias("active"), F.max("ts").alias("updated_at"),
    ).where("first is not null")
    # of each name the last value, so nothing as long as the log is gathered
    pairs = rows.where("op = 'add'").select(*TARGET, "ts", "seq", F.explode("extra").alias("name", "value")).groupBy(*TARGET, "name").agg(F.max_by("value", at()).alias("value"))
    extra = pairs.groupBy(*TARGET).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("extra"))
    out = facts.join(extra, list(TARGET), "left")
    return out.select(F.col("first.seq").alias("target_id"), *TARGET, "target_value", "priority", "active", F.coalesce("extra", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("extra"), F.col("first.ts").alias("first_seen_at"), F.col("last_add.ts").alias("last_seen_at"), "updated_at")


def keywords(folded: DataFrame) -> DataFrame:
    """The first version of each keyword target's keyword, active while its target is. folded: of targets()."""
    return folded.where("target_type = 'keyword'").select("event_id", F.col("target_id").alias("source_target_id"), F.col("target_value").alias("keyword"), F.col("normalized_value").alias("normalized_keyword"), F.lit(1).alias("version"), "active", "first_seen_at")


def videos(log: DataFrame, folded: DataFrame) -> DataFrame:
    """Videos of an event: seeds of targets and attached ones, with the last source, reason and confidence.

    Attaching makes a video active. A target's state goes to the videos whose source it is at that time.
    """
    ids = folded.where("target_type = 'seed_bvid'").select(*TARGET, "target_id", F.col("first_seen_at").alias("_since"))
    seeds = log.where("op = 'add' and target_type = 'seed_bvid'").join(ids, list(TARGET)).select("event_id", F.col("normalized_value").alias("bvid"), "ts", "seq", F.col("target_id").alias("source"), F.lit("seed_bvid").alias("reason"), F.lit(1.0).alias("confidence"))
    attached = log.where("op = 'attach'").select("event_id", "bvid", "ts", "seq", F.lit(None).cast("long").alias("source"), F.col("association_reason").alias("reason"), "confidence")
    made = seeds.unionByName(attached).withColumns({"of_target": F.lit(None).cast("long"), "state": F.lit(True)})
    states = log.where("op = 'set_active' and target_type = 'seed_bvid'").join(ids, list(TARGET)).where("ts >= _since").select("event_id", F.col("normalized_value").alias("bvid"), "ts", "seq", F.lit(None).cast("long").alias("source"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("confidence"), F.col("target_id").alias("of_target"), F.col("active").alias("state"))
    before = Window.partitionBy("event_id", "bvid").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = made.unionByName(states).withColumn("now", F.last("source", ignorenulls=True).over(before))
    counts = F.col("of_target").isNull() | (F.col("of_target") == F.col("now"))
    attach = F.when(F.col("reason").isNotNull(), at())
    out = every.groupBy("event_id", "bvid").agg(
        F.max_by("now", at()).alias("source_target_id"), F.max_by("reason", attach).alias("association_reason"), F.max_by("confidence", attach).alias("confidence"),
        F.max_by("state", F.when(counts, at())).alias("active"), F.min(F.when(F.col("reason").isNotNull(), F.col("ts"))).alias("first_seen_at"), F.max(F.when(F.col("reason").isNotNull(), F.col("ts"))).alias("last_seen_at"),
    )
    return out.where("association_reason is not null")


def first_tasks(log: DataFrame, folded: DataFrame) -> DataFrame:
    """One task for each seed, when it first came: its video's statistics, with the priority of that row."""
    seeds = folded.where("target_type = 'seed_bvid'").select("event_id", "target_id", F.col("normalized_value").alias("bvid"))
    first = log.select(F.col("seq").alias("target_id"), "priority", F.col("ts").alias("not_before"))
    key = F.concat(F.lit("fetch_video_stats:video:"), F.col("bvid"), F.lit(":event:"), F.col("event_id").cast("string"))
    return seeds.join(first, "target_id").select(key.alias("idempotency_key"), F.col("bvid").alias("target_id"), "priority", F.col("target_id").alias("source_target_id"), F.lit("event_seed").alias("reason"), "not_before")
