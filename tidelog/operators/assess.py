"""Video assessment as one set-based job: tier, life stage, next slot, checkpoints, gaps."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.values import local_seconds
from tidelog.operators import video

TIERS = ("s", "a", "b", "c")


@dataclass(frozen=True)
class Policy:
    """Thresholds (views an hour, comments an hour, turnover), intervals in seconds (activity window, else),
    and local activity windows in minutes of the day. The defaults are fixed values of the archive's policy."""

    thresholds: dict[str, tuple[int, int, float | None]] = field(default_factory=lambda: {"s": (6000, 60, 0.35), "a": (1200, 20, 0.20), "b": (300, 5, None)})
    intervals: dict[str, tuple[int, int]] = field(default_factory=lambda: {"s": (120, 600), "a": (600, 1800), "b": (1800, 3600), "c": (3600, 7200)})
    windows: tuple[tuple[int, int], ...] = ((11 * 60 + 30, 13 * 60 + 30), (17 * 60 + 30, 20 * 60 + 30), (21 * 60 + 30, 30))
    zone: str = "Asia/Shanghai"
    official_s_seconds: int = 6 * 3600
    confirmations: int = 2
    dormant_seconds: int = 7 * 86_400
    archive_seconds: int = 30 * 86_400
    checkpoint_hours: tuple[int, ...] = (6, 12, 18, 24)
    checkpoint_late_seconds: int = 3600


def desired_tier(p: Policy) -> Column:
    """From official, age_seconds, event_core, major_creator, pinned_tier, views_hour, comments_hour, turnover, confirmations, input_complete."""
    c = F.col
    young = c("official") & (c("age_seconds") >= 0) & (c("age_seconds") < p.official_s_seconds)
    forced = young | c("event_core") | c("major_creator") | (c("pinned_tier") == "s")
    out = F.when(F.coalesce(young, F.lit(False)) | F.coalesce(c("event_core"), F.lit(False)) | F.coalesce(c("major_creator"), F.lit(False)) | F.coalesce(forced, F.lit(False)), "s").when(c("pinned_tier").isNotNull(), c("pinned_tier"))
    sure = c("input_complete") & (c("confirmations") >= p.confirmations)
    for tier, (views, comments, turnover) in p.thresholds.items():
        met = F.coalesce(c("views_hour") >= views, F.lit(False)) | F.coalesce(c("comments_hour") >= comments, F.lit(False))
        if turnover is not None:
            met = met | F.coalesce(sure & (c("turnover") >= turnover), F.lit(False))
        out = out.when(met, tier)
    return out.otherwise("c")


def rank(tier: Column) -> Column:
    return F.array_position(F.array(*(F.lit(t) for t in TIERS)), tier)


def with_hysteresis(state: DataFrame, p: Policy) -> DataFrame:
    """One assessment against the state before: effective, candidate and count become the next ones."""
    lower = rank(F.col("desired")) > rank(F.col("effective"))
    n = F.when(F.col("candidate") == F.col("desired"), F.col("downgrades") + 1).otherwise(1)
    done = ~lower | (n >= p.confirmations)
    return state.withColumns({"effective": F.when(done, F.col("desired")).otherwise(F.col("effective")), "candidate": F.when(done, F.lit(None).cast("string")).otherwise(F.col("desired")), "downgrades": F.when(done, 0).otherwise(n)})


def hysteresis_states(p: Policy) -> list[tuple[int, int | None, int]]:
    """All states of the fold: effective tier, candidate below it (by place in TIERS) and confirmations so far."""
    n = len(TIERS)
    return [(e, None, 0) for e in range(n)] + [(e, d, k) for e in range(n) for d in range(e + 1, n) for k in range(1, p.confirmations)]


def hysteresis_steps(p: Policy) -> list[list[int]]:
    """For each desired tier, the number of the state that follows each state."""
    states = hysteresis_states(p)
    place = {s: n for n, s in enumerate(states)}

    def after(state: tuple[int, int | None, int], desired: int) -> tuple[int, int | None, int]:
        effective, candidate, n = state
        n = n + 1 if candidate == desired else 1
        return (desired, None, 0) if desired <= effective or n >= p.confirmations else (effective, desired, n)

    return [[place[after(s, d)] for s in states] for d in range(len(TIERS))]


def tier_history(assessments: DataFrame, p: Policy, key: str = "bvid", time: str = "at", block: Column | None = None, fan: int = 64) -> DataFrame:
    """The effective tier after a whole history of desired tiers, from c.

    Each block of a key's time (unless given: a day of a timestamp, else 512 rows) becomes a map from the state before it to the state
    after it. Maps compose in any grouping that keeps their order, so `fan` neighbouring blocks become one, until
    there is one a key: no list is longer than a block or `fan`, however long a history is.
    """
    states, steps = hysteresis_states(p), hysteresis_steps(p)
    table = F.array(*(F.array(*(F.lit(s) for s in row)) for row in steps))
    same = F.array(*(F.lit(n) for n in range(len(states))))
    if block is None:
        dated = dict(assessments.dtypes)[time] == "timestamp"
        block = F.floor(F.unix_seconds(time) / 86_400) if dated else F.floor((F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1) / 512)
    ordered_ = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    rows = assessments.where(F.col("desired").isin(*TIERS)).select(key, block.cast("long").alias("block"), F.col(time).alias("at"), (rank(F.col("desired")) - 1).alias("d"))
    # equal tiers in a row act as the first `confirmations` of them
    w = Window.partitionBy(key, "block").orderBy("at")
    back = F.array(*(F.lag("d", k).over(w) for k in range(1, p.confirmations + 1)))
    few = rows.withColumn("_back", back).where(~F.forall("_back", lambda x: F.coalesce(x == F.col("d"), F.lit(False)))).drop("_back")
    maps = few.groupBy(key, "block").agg(ordered_("at", "d").alias("l")).select(key, "block", F.aggregate("l", same, lambda m, x: F.transform(m, lambda s: F.get(F.get(table, x["d"]), s))).alias("map"))
    low, high = maps.agg(F.min("block"), F.max("block")).first()
    blocks = 1 if low is None else high - low + 1
    maps = maps.withColumn("block", F.col("block") - F.lit(low or 0))
    while blocks > 1:
        maps = maps.groupBy(key, F.floor(F.col("block") / fan).alias("block")).agg(ordered_(F.col("block").alias("b"), "map").alias("l")).select(key, "block", F.aggregate("l", same, lambda m, x: F.transform(m, lambda s: F.get(x["map"], s))).alias("map"))
        blocks = -(-blocks // fan)
    named = F.array(*(F.struct(F.lit(TIERS[e]).alias("effective"), F.lit(None if c is None else TIERS[c]).cast("string").alias("candidate"), F.lit(n).alias("downgrades")) for e, c, n in states))
    return maps.select(key, F.get(named, F.get("map", F.lit(len(TIERS) - 1))).alias("s")).select(key, "s.*")


def life_stage(p: Policy) -> Column:
    """active, dormant or archived from age_seconds and low_growth (null: not proven)."""
    return F.when(F.coalesce(F.col("low_growth"), F.lit(False)) & (F.col("age_seconds") >= p.archive_seconds), "archived").when(F.coalesce(F.col("low_growth"), F.lit(False)) & (F.col("age_seconds") >= p.dormant_seconds), "dormant").otherwise("active")


def age_interval(age_seconds: Column, views_hour: Column) -> Column:
    growth = F.coalesce(views_hour, F.lit(0))
    return F.when(age_seconds < 1800, 60).when(age_seconds < 21_600, 300).when(growth > 30_000, 300).when(growth > 6_000, 900).when(growth > 1_200, 1800).otherwise(7200)


def in_activity(now: Column, p: Policy) -> Column:
    """Whether an instant is in a local window, which may cross midnight."""
    minute = F.pmod(F.floor(local_seconds(now, p.zone) / 60), F.lit(1440))
    inside = [((minute >= a) & (minute < b)) if a < b else ((minute >= a) | (minute < b)) for a, b in p.windows]
    out = F.lit(False)
    for one in inside:
        out = out | one
    return out


def effective_interval(now: Column, age_seconds: Column, views_hour: Column, tier: Column, to_checkpoint: Column, p: Policy) -> Column:
    busy = in_activity(now, p)
    ceiling = F.lit(p.intervals["c"][1])
    for t, (active, normal) in p.intervals.items():
        ceiling = F.when(tier == t, F.when(busy, active).otherwise(normal)).otherwise(ceiling)
    return F.least(age_interval(age_seconds, views_hour), ceiling, F.when(to_checkpoint > 0, to_checkpoint).when(to_checkpoint <= 0, 0))


def next_slot(anchor: Column, now: Column, interval: Column) -> Column:
    """The next slot after now on the grid from anchor (epoch seconds); the anchor itself while it is ahead."""
    return F.when(now < anchor, anchor).otherwise(anchor + (F.floor((now - anchor) / interval) + 1) * interval)


def checkpoint_slots(videos: DataFrame, now: int, p: Policy) -> DataFrame:
    """Checkpoints of each video (anchor, discovered: epoch seconds): planned, missed or not_applicable."""
    s = videos.withColumn("hours", F.explode(F.array(*(F.lit(h) for h in p.checkpoint_hours)))).withColumn("due", F.col("anchor") + F.col("hours") * 3600)
    late = F.col("due") + p.checkpoint_late_seconds
    return s.withColumn("state", F.when(F.col("discovered") > late, "not_applicable").when(F.lit(now) <= late, "planned").otherwise("missed"))


def recovery_slots(slots: DataFrame) -> DataFrame:
    """One recovery for a video's missed checkpoints, named by the latest."""
    return slots.where("state = 'missed'").groupBy("bvid").agg(F.max("hours").alias("hours"), F.count("*").alias("coalesced"))


def schedule_gaps(states: DataFrame, now: int) -> DataFrame:
    """Slots missed between next_due and the bucket of now; one gap a video."""
    missed = F.floor((F.lit(now) - F.col("next_due")) / F.col("interval"))
    return states.withColumn("missed", missed).where("missed > 0").select("bvid", F.col("next_due").alias("gap_from"), F.lit(now).cast("long").alias("gap_until"), "missed")


COMPONENTS = {"archived": ("video_metrics",), "dormant": ("video_metrics", "hot_core"), "active": ("video_metrics", "hot_core", "latest_current_head")}


def component_kinds(stage: Column, frontier_complete: Column) -> Column:
    kinds = lambda s: F.array(*(F.lit(k) for k in COMPONENTS[s]))
    return F.when(stage == "archived", kinds("archived")).when((stage == "active") | frontier_complete, kinds("active")).otherwise(kinds("dormant"))


#: Fixed priorities of slots.
PRIORITIES = {"routine": {"s": 100, "a": 90, "b": 80, "c": 70}, "checkpoint": 120, "recovery": 115}


def slot_priority(kind: Column, tier: Column) -> Column:
    routine = F.lit(PRIORITIES["routine"]["c"])
    for t, v in PRIORITIES["routine"].items():
        routine = F.when(tier == t, v).otherwise(routine)
    return F.when(kind == "checkpoint", PRIORITIES["checkpoint"]).when(kind == "recovery", PRIORITIES["recovery"]).otherwise(routine)


def hot_pages(tier: Column, kind: Column, routine: dict[str, int], checkpoint: dict[str, int], core: int = 1) -> Column:
    """Core and deep page ranges of a slot."""
    total = F.lit(core)
    for t in TIERS:
        total = F.when(tier == t, F.when(kind == "routine", routine[t]).otherwise(checkpoint[t])).otherwise(total)
    return F.struct(F.lit(1).alias("core_start"), F.least(total, F.lit(core)).alias("core_pages"), F.lit(core + 1).alias("deep_start"), F.greatest(total - core, F.lit(0)).alias("deep_pages"))


def routine_slots(slots: DataFrame, taken: DataFrame) -> DataFrame:
    """Routine slots (bvid, bucket) that no checkpoint or recovery takes."""
    return slots.join(taken.select("bvid", "bucket"), ["bvid", "bucket"], "left_anti")


#: Fixed groups of component statuses.
ACTIVE = ("running", "joined_active_task")
MISSED = ("missed_due_to_capacity", "missed_due_to_service_gap")
STARTED = ("running", "complete", "partial", "joined_active_task", "failed", "corrupted")


def cohort_status(components: DataFrame, key: str = "cohort") -> DataFrame:
    """Status of each cohort from its required components' (status, started); the first rule that holds."""
    r = components.where("required")
    s = F.col("status")
    usable = s != "not_applicable"
    g = r.groupBy(key).agg(
        F.bool_or(s == "corrupted").alias("corrupted"), F.bool_or(s.isin(*ACTIVE)).alias("active"), F.bool_and(s == "pending").alias("all_pending"), F.bool_and(~usable).alias("none"), F.bool_or(F.col("started") | s.isin(*STARTED)).alias("started"),
        F.bool_and((s == "blocked") | ~usable).alias("all_blocked"), F.bool_or(s.isin(*MISSED)).alias("missed"), F.bool_and(s.isin("complete", "not_applicable")).alias("complete"), F.bool_or(s == "pending").alias("pending"), F.bool_and(s.isin("pending", "blocked", "not_applicable")).alias("waiting"),
    )
    c = F.col
    status = (
        F.when(c("corrupted"), "corrupted").when(c("active"), "running").when(c("all_pending"), "planned").when(c("none"), "not_applicable").when(~c("started") & c("all_blocked"), "blocked")
        .when(~c("started") & c("missed"), "missed").when(c("complete"), "complete").when(c("started") & c("pending"), "running").when(~c("started") & c("waiting"), "planned").otherwise("partial")
    )
    return g.select(key, status.alias("status"))


def finalized(components: DataFrame, now: int) -> DataFrame:
    """Components past their deadline: pending is missed by capacity, blocked by a service gap."""
    late = F.lit(now) > F.col("deadline")
    return components.withColumn("status", F.when(late & (F.col("status") == "pending"), "missed_due_to_capacity").when(late & (F.col("status") == "blocked"), "missed_due_to_service_gap").otherwise(F.col("status")))


def ranked_candidates(videos: DataFrame, states: DataFrame, n: int) -> DataFrame:
    """Videos to assess: never assessed, then without a due time, then by due time, first seen, id."""
    j = videos.join(states.select("bvid", "next_due", F.lit(True).alias("assessed")), "bvid", "left")
    return j.orderBy(F.col("assessed").isNotNull(), F.col("next_due").isNotNull(), "next_due", "first_seen", "bvid").limit(n)


def due_list(videos: DataFrame, now: int) -> DataFrame:
    """Available videos (anchor, last_snapshot, views_hour: at that time) whose next slot has come."""
    age = F.greatest(F.col("last_snapshot") - F.col("anchor"), F.lit(0))
    slot = next_slot(F.col("anchor"), F.col("last_snapshot"), age_interval(age, F.col("views_hour")))
    return videos.where("available").withColumn("due", F.coalesce(slot, F.lit(now))).where(F.col("due") <= now)


def terminal_list(videos: DataFrame, listed: DataFrame, now: datetime, p: Policy, hour: int = 22) -> DataFrame:
    """After the local hour, available videos published and seen by then that the date's list doesn't have."""
    local = now.astimezone(ZoneInfo(p.zone))
    until = F.lit(local.replace(hour=hour, minute=0, second=0, microsecond=0))
    rows = videos.where((F.lit(now) >= until) & (F.col("pubdate") <= until) & (F.col("first_seen_at") <= until) & F.col("available")).withColumn("date", F.lit(f"{local:%Y-%m-%d}"))
    return rows.join(listed, ["bvid", "date"], "left_anti")


def focus_slot(now: Column, zone: str, from_hour: int, to_hour: int, times: tuple[str, ...]) -> Column:
    """Whether an instant is at one of the local times (HH:mm), within the hours."""
    minute = F.pmod(F.floor(local_seconds(now, zone) / 60), F.lit(1440))
    return F.floor(minute / 60).between(from_hour, to_hour - 1) & minute.isin(*(60 * int(t[:2]) + int(t[3:]) for t in times))


def active_targets(targets: DataFrame, events: DataFrame, now: datetime) -> DataFrame:
    """uid targets of events that run now; open ends hold."""
    t = F.lit(now)
    on = events.where((F.col("status") == "active") & (F.col("start_at").isNull() | (F.col("start_at") <= t)) & (F.col("end_at").isNull() | (F.col("end_at") > t))).select(F.col("id").alias("event_id"))
    return targets.where("active and target_type = 'uid'").join(on, "event_id", "left_semi")


def signals(videos: DataFrame, sources: DataFrame, event_videos: DataFrame, growth: DataFrame) -> DataFrame:
    """Inputs of the tier rule for each video."""
    official = sources.where("active and official and monitored").select("bvid", F.lit(True).alias("official")).distinct()
    core = event_videos.where("active").select("bvid", F.lit(True).alias("event_core")).distinct()
    out = videos.join(official, "bvid", "left").join(core, "bvid", "left").join(growth, "bvid", "left")
    return out.fillna(False, ["official", "event_core"])


def planning_signals(videos: DataFrame, sources: DataFrame, event_videos: DataFrame, events: DataFrame, metrics: DataFrame, frontiers: DataFrame, now: datetime, p: Policy) -> DataFrame:
    """What a planning round knows of each video: official, event_core, views_hour, age_seconds, pinned_tier, low_growth, stage and frontier_complete.

    videos: bvid, anchor (epoch seconds) and pinned_tier; frontiers: bvid and baseline_status of latest comments. Only videos that
    are active in an active event are core. Views an hour are those of the hour before now. A video of an active event, a pinned
    one or one that grows again is active, whatever its age; without two snapshots nothing is known of its growth (null).
    """
    on = events.where("status = 'active'").select(F.col("id").alias("event_id"))
    core = event_videos.where("active").join(on, "event_id", "left_semi")
    growth = video.view_growth(metrics, now - timedelta(hours=1), now).withColumnRenamed("view_growth", "views_hour")
    complete = frontiers.where("baseline_status = 'baseline_complete'").select("bvid", F.lit(True).alias("frontier_complete")).distinct()
    out = signals(videos, sources, core, growth).join(complete, "bvid", "left").fillna(False, ["frontier_complete"])
    low = F.col("views_hour") < p.thresholds["b"][0]
    out = out.withColumn("age_seconds", F.greatest(F.lit(int(now.timestamp())) - F.col("anchor"), F.lit(0))).withColumn("low_growth", low)
    kept_on = F.col("event_core") | F.col("pinned_tier").isNotNull() | F.coalesce(~low, F.lit(False))
    return out.withColumn("stage", F.when(kept_on, "active").otherwise(life_stage(p)))
