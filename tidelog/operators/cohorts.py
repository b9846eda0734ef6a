"""Plans of snapshot cohorts by component: checkpoints, one recovery of what is overdue, and routine slots beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.values import iso_utc
from tidelog.operators.assess import PRIORITIES, component_kinds, slot_priority

#: Fixed: components of a checkpoint, and what a component adds to its slot's priority.
CHECKPOINT_KINDS = ("video_metrics", "hot_core", "latest_reconciliation")
OFFSETS = {"video_metrics": 2, "hot_core": 1}
RANGE = "array<struct<component_kind:string,start_page:bigint,end_page:bigint>>"


def routine_key(bvid: Column, slot: Column) -> Column:
    return F.concat(F.lit("snapshot:"), bvid, F.lit(":"), iso_utc(slot), F.lit(":routine"))


def checkpoint_key(bvid: Column, hours: Column) -> Column:
    return F.concat(F.lit("snapshot:"), bvid, F.lit(":age:"), hours.cast("string"), F.lit("h"))


def recovery_key(bvid: Column, hours: Column) -> Column:
    return F.concat(F.lit("snapshot:"), bvid, F.lit(":recovery:through:"), hours.cast("string"), F.lit("h"))


def component_key(cohort_key: Column, kind: Column) -> Column:
    return F.concat_ws(":", cohort_key, kind)


def of_tier(tier: Column, pages: dict[str, int]) -> Column:
    out = F.lit(None).cast("bigint")
    for t, n in pages.items():
        out = F.when(tier == t, F.lit(n).cast("bigint")).otherwise(out)
    return out


def component_ranges(kinds: Column, tier: Column, deep: Column, dormant: Column, routine: dict[str, int], checkpoint: dict[str, int]) -> Column:
    """RANGE of the components of kinds; hot_core has its pages, and hot_deep those of a checkpoint beyond them, where deep."""
    core = F.when(dormant, F.lit(1).cast("bigint")).otherwise(of_tier(tier, routine))
    total = F.when(dormant | ~deep, core).otherwise(of_tier(tier, checkpoint))
    one = lambda kind, start, end: F.struct(kind.alias("component_kind"), start.cast("bigint").alias("start_page"), end.cast("bigint").alias("end_page"))
    hot = F.array(one(F.lit("hot_core"), F.lit(1), core), F.when(total > core, one(F.lit("hot_deep"), core + 1, total)))
    none = F.lit(None)
    return F.filter(F.flatten(F.transform(kinds, lambda k: F.when(k == "hot_core", hot).otherwise(F.array(one(k, none, none))))).cast(RANGE), lambda c: c.isNotNull())


def offset(kind: Column) -> Column:
    out = F.lit(0)
    for k, n in OFFSETS.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def exploded(df: DataFrame, ranges: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(ranges).alias("_c")).select(*keep, "_c.*")


def overdue_components(missed: DataFrame, attempts: DataFrame, defaults: Column) -> DataFrame:
    """bvid, hours (of the latest missed checkpoint), component_kind and pages: what one recovery of a video's missed checkpoints scans.

    missed: bvid, hours and tier. attempts: components of checkpoints that exist (bvid, hours, component_kind, status, start_page,
    end_page, null where not recorded). A checkpoint without attempts lacks all its components, else those that are neither complete
    nor not applicable, with the pages that they recorded. Of hot components of several checkpoints the widest range holds: the last
    page, then the number of pages, then the first checkpoint.
    """
    tried = attempts.select("bvid", "hours").distinct().withColumn("tried", F.lit(True))
    state = missed.join(tried, ["bvid", "hours"], "left")
    whole = exploded(state.where("tried is null"), defaults, "bvid", "hours")
    plan = exploded(state.where("tried"), defaults, "bvid", "hours").withColumnsRenamed({"start_page": "own_start", "end_page": "own_end"})
    open_ = attempts.where(~F.col("status").isin("complete", "not_applicable")).join(plan, ["bvid", "hours", "component_kind"])
    kept = open_.select("bvid", "hours", "component_kind", F.when(F.col("start_page").isNotNull() & F.col("end_page").isNotNull() & F.col("own_start").isNotNull(), F.col("start_page")).otherwise(F.col("own_start")).alias("start_page"), F.when(F.col("start_page").isNotNull() & F.col("end_page").isNotNull() & F.col("own_start").isNotNull(), F.col("end_page")).otherwise(F.col("own_end")).alias("end_page"))
    every = whole.unionByName(kept)
    rank = F.struct(F.coalesce("end_page", F.lit(0)).alias("end"), F.coalesce(F.col("end_page") - F.col("start_page"), F.lit(0)).alias("pages"), (-F.col("hours")).alias("early"))
    widest = every.groupBy("bvid", "component_kind").agg(F.max_by(F.struct("start_page", "end_page"), rank).alias("r"))
    latest = missed.groupBy("bvid").agg(F.max("hours").alias("hours"))
    return widest.join(latest, "bvid").select("bvid", "hours", "component_kind", "r.*")


def cohort_plans(videos: DataFrame, checkpoints: DataFrame, attempts: DataFrame, bucket: int, routine: dict[str, int], checkpoint: dict[str, int]) -> DataFrame:
    """cohort_key, component_key, bvid, reason, component_kind, priority, start_page and end_page of what a planning round puts up.

    videos: bvid, tier, stage, frontier_complete, first_active and routine_due. checkpoints: bvid, hours, state (planned, missed or
    not_applicable) and in_bucket (due in the bucket of now). A routine slot is left out where a recovery, or a checkpoint of
    the same bucket, takes its place. bucket: now's, in epoch seconds.
    """
    never = F.lit(False)
    timed = checkpoints.join(videos.select("bvid", "tier"), "bvid")
    defaults = component_ranges(F.array(*(F.lit(k) for k in CHECKPOINT_KINDS)), F.col("tier"), ~never, never, routine, checkpoint)
    planned = exploded(timed.where("state = 'planned'"), defaults, "bvid", "hours").withColumns({"reason": F.lit("age_checkpoint"), "cohort_key": checkpoint_key(F.col("bvid"), F.col("hours")), "base": F.lit(PRIORITIES["checkpoint"])})
    recovery = overdue_components(timed.where("state = 'missed'"), attempts, defaults).withColumns({"reason": F.lit("recovery"), "cohort_key": recovery_key(F.col("bvid"), F.col("hours")), "base": F.lit(PRIORITIES["recovery"])})
    taken = planned.join(checkpoints.where("in_bucket"), ["bvid", "hours"], "left_semi").select("bvid").unionByName(recovery.select("bvid")).distinct()
    dormant, active = F.col("stage") == "dormant", F.col("stage") == "active"
    kinds = component_kinds(F.col("stage"), F.col("frontier_complete"))
    slots = videos.where("routine_due").join(taken, "bvid", "left_anti")
    routines = exploded(slots, component_ranges(kinds, F.col("tier"), F.col("first_active") & active, dormant, routine, checkpoint), "bvid", "tier").withColumns({"reason": F.lit("routine"), "cohort_key": routine_key(F.col("bvid"), F.lit(bucket)), "base": slot_priority(F.lit("routine"), F.col("tier"))})
    out = [df.select("cohort_key", component_key(F.col("cohort_key"), F.col("component_kind")).alias("component_key"), "bvid", "reason", "component_kind", (F.col("base") + offset(F.col("component_kind"))).cast("long").alias("priority"), "start_page", "end_page") for df in (planned, recovery, routines)]
    return out[0].unionByName(out[1]).unionByName(out[2])
