"""Dimensions, change events and folds over append-only observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import fold_text
from tidelog.functions.values import like_bucket

BY_TIME = ("captured_at", "id")


def entities(obs: DataFrame, later: tuple[str, ...] = ("author_mid", "author_name"), maps: tuple[str, ...] = ()) -> DataFrame:
    """Comment dimension: first-seen values, later fields by their first non-null, maps with older keys winning (null without keys)."""
    order = F.struct(*BY_TIME)
    first = F.min_by(F.struct("bvid", "content", "captured_at", "raw_payload_id"), order)
    filled = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in later]
    grouped = obs.groupBy("rpid").agg(first.alias("f"), *filled)
    for c in maps:
        folded = first_keys(obs, c).groupBy(F.col("rpid").alias("_rpid")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))).alias(c))
        grouped = grouped.join(folded, F.col("rpid").eqNullSafe(F.col("_rpid")), "left").drop("_rpid")
    return grouped.select("rpid", F.col("f.bvid").alias("bvid"), F.col("f.content").alias("first_content"), F.col("f.captured_at").alias("first_seen_at"), F.col("f.raw_payload_id").alias("first_raw_payload_id"), *later, *maps)


def first_keys(obs: DataFrame, column: str) -> DataFrame:
    """rpid, key and value of the keys that a comment's maps have: each as its first observation has it, null values too."""
    each = obs.select("rpid", *BY_TIME, F.explode(column).alias("key", "value"))
    return each.groupBy("rpid", "key").agg(F.min_by("value", F.struct(*BY_TIME)).alias("value"))


def state_changes(obs: DataFrame) -> DataFrame:
    """Changes against a comment's observation before: rpid, ids, event_type, old_value, new_value, created_at."""
    w = Window.partitionBy("rpid").orderBy(*BY_TIME)
    values = F.struct("id", F.sha2(F.trim("content"), 256).alias("hash"), "content", like_bucket(F.col("like_count")).alias("likes"), "reply_count", "sort_mode", "position")
    p = obs.withColumn("now", values).withColumn("was", F.lag("now").over(w))
    was, now = F.col("was"), F.col("now")

    def event(when: Column, name: str, old: Column, new: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("event_type"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value")))

    none = F.lit(None).cast("string")
    again = was.isNotNull()
    both_hot = (was["sort_mode"] == "hot") & (now["sort_mode"] == "hot")
    events = F.array(
        event(was.isNull(), "first_seen", none, none),
        event(again & ~was["hash"].eqNullSafe(now["hash"]), "content_hash_changed", was["hash"], now["hash"]),
        event(again & ~was["likes"].eqNullSafe(now["likes"]), "like_bucket_changed", was["likes"], now["likes"]),
        event(again & ~was["reply_count"].eqNullSafe(now["reply_count"]), "reply_count_changed", was["reply_count"], now["reply_count"]),
        event(both_hot & ~was["position"].eqNullSafe(now["position"]), "hot_position_changed", was["position"], now["position"]),
    )
    out = p.select("rpid", "bvid", was["id"].alias("previous_id"), F.col("id").alias("current_id"), "captured_at", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return out.select("rpid", "bvid", "previous_id", "current_id", "e.*", F.col("captured_at").alias("created_at"))


def visibility_events(obs: DataFrame, marks: DataFrame) -> DataFrame:
    """folded, unfolded, disappeared and reappeared. marks: id, rpid, bvid, captured_at of missing comments."""
    seen = obs.select("rpid", "bvid", "id", "captured_at", "visibility", F.lit(True).alias("seen"))
    gone = marks.select("rpid", "bvid", "id", "captured_at", F.lit(None).cast("string").alias("visibility"), F.lit(False).alias("seen"))
    w = Window.partitionBy("rpid").orderBy("captured_at", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    both = seen.unionByName(gone).withColumn("was_seen", F.lag("seen").over(w)).withColumn("last", F.last(F.when(F.col("seen"), F.struct("id", "visibility")), ignorenulls=True).over(before))
    last = F.col("last.visibility")
    now = F.col("visibility")

    def event(when: Column, name: str, old: Column, new: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("event_type"), old.alias("old_visibility"), new.alias("new_visibility")))

    missing = F.lit("missing")
    events = F.array(
        event(~F.col("seen") & F.coalesce(F.col("was_seen"), F.lit(True)), "disappeared", F.coalesce(last, F.lit("visible")), missing),
        event(F.col("seen") & ~F.coalesce(F.col("was_seen"), F.lit(True)), "reappeared", missing, now),
        event(F.col("seen") & (last == "visible") & (now == "folded"), "folded", last, now),
        event(F.col("seen") & (last == "folded") & (now == "visible"), "unfolded", last, now),
    )
    out = both.select("rpid", "bvid", F.col("last.id").alias("previous_id"), F.when(F.col("seen"), F.col("id")).alias("current_id"), "captured_at", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return out.select("rpid", "bvid", "previous_id", "current_id", "e.*", F.col("captured_at").alias("created_at"))


def media_lists(links: DataFrame) -> DataFrame:
    """Ordered and set hashes of each observation's source ids."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "media_source_id"))), lambda x: x["media_source_id"])
    out = links.groupBy("comment_observation_id", "rpid").agg(ids.alias("ids"))
    text = lambda x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: v.cast("string")), ","), F.lit("]"))
    return out.withColumn("ordered_hash", F.sha2(text(F.col("ids")), 256)).withColumn("set_hash", F.sha2(text(F.array_sort(F.array_distinct("ids"))), 256))


def media_changes(links: DataFrame, observation_ids: DataFrame, parts: int | None = None) -> DataFrame:
    """Media events against the observation just before by id, where both have media.

    observation_ids: id and rpid of all observations, also those without media. parts: how many partitions the
    comments are dealt into (as the session has it, if none).
    """
    w = Window.partitionBy("rpid").orderBy("id")
    lists = media_lists(links).withColumnRenamed("comment_observation_id", "id").drop("rpid")
    now = F.struct("id", "ids", "ordered_hash", "set_hash")
    p = observation_ids.select("id", "rpid").distinct().join(lists, "id", "left")
    p = p.repartition(parts, "rpid") if parts else p
    p = p.withColumn("was", F.lag(now).over(w)).where("ids is not null and was.ids is not null")
    removed, added = F.array_except("was.ids", "ids"), F.array_except("ids", "was.ids")
    changed = F.col("was.set_hash") != F.col("set_hash")

    def event(when: Column, name: str, ids: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("event_type"), F.array_join(F.array_sort(ids), ",").alias("ids")))

    none = F.array().cast("array<bigint>")
    events = F.array(event(changed, "media_changed", none), event(changed & (F.size(added) > 0), "media_added", added), event(changed & (F.size(removed) > 0), "media_removed", removed), event(~changed & (F.col("was.ordered_hash") != F.col("ordered_hash")), "media_order_changed", none))
    return p.select("rpid", F.col("was.id").alias("previous_id"), F.col("id").alias("current_id"), F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("rpid", "previous_id", "current_id", "e.*")


def media_sources(links: DataFrame) -> DataFrame:
    """Sources keyed by platform and hash of URL. links: platform, url, captured_at, page_id."""
    key = F.sha2("url", 256)
    return links.groupBy("platform", key.alias("url_hash")).agg(F.min("url").alias("source_url"), F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at"), F.min_by("page_id", F.struct("captured_at", "page_id")).alias("first_page_id"), F.max_by("page_id", F.struct("captured_at", "page_id")).alias("last_page_id"))


def first_links(links: DataFrame, *arrival: str) -> DataFrame:
    """One link for each observation and position: the first to arrive (by these columns), then the least source."""
    w = Window.partitionBy("comment_observation_id", "position").orderBy(*arrival, "media_source_id")
    return links.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def exact_assets(blobs: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """One asset for each content hash: the least id, with how many share it."""
    return blobs.groupBy(F.sha2(body, 256).alias("blob_sha256")).agg(F.min(key).alias("asset_id"), F.count("*").alias("sources"))


@dataclass(frozen=True)
class WatchPolicy:
    hot_max_position: int = 3
    reply_growth_min: int = 5
    like_growth_min: int = 20
    keywords: tuple[str, ...] = ()
    first_seen_bonus: int = 2


def watch_candidates(obs: DataFrame, policy: WatchPolicy) -> DataFrame:
    """Scored observations of root comments that some signal marks; of equal priorities the signal named first gives the reason.

    extra: what the signals saw, as JSON without the fields of those that are not met.
    """
    obs = obs.where(F.col("root_rpid").isNull() | (F.col("root_rpid") == 0))
    w = Window.partitionBy("rpid").orderBy(*BY_TIME)
    p = obs.withColumn("was", F.lag(F.struct("reply_count", "like_count")).over(w)).withColumn("first_seen", F.row_number().over(w) == 1)
    p = p.withColumn("replies", F.col("reply_count") - F.col("was.reply_count")).withColumn("likes", F.col("like_count") - F.col("was.like_count"))
    folded = fold_text(F.coalesce("content", F.lit("")), "fold")
    p = p.withColumn("folded", folded).withColumn("matched", F.filter(F.array(*(F.lit(k) for k in policy.keywords)) if policy.keywords else F.array().cast("array<string>"), lambda k: F.contains(F.col("folded"), k))).withColumn("hits", F.size("matched"))

    def signal(when: Column, rank: int, reason: str, priority: Column, score: Column) -> Column:
        return F.when(when, F.struct(priority.cast("int").alias("priority"), F.lit(-rank).alias("order"), F.lit(reason).alias("reason"), score.cast("double").alias("score")))

    hot = (F.col("sort_mode") == "hot") & F.col("position").between(0, policy.hot_max_position)
    signals = F.array(
        signal(hot, 0, "hot_top", 100 - F.col("position"), 100 - F.col("position")),
        signal(F.col("replies") >= policy.reply_growth_min, 1, "reply_growth", 80 + F.least("replies", F.lit(19)), F.col("replies")),
        signal(F.col("likes") >= policy.like_growth_min, 2, "like_growth", 70 + F.least(F.floor(F.col("likes") / 5), F.lit(19)), F.col("likes") / 5),
        signal(F.col("hits") > 0, 3, "controversy_keyword", 75 + F.least(F.col("hits") - 1, F.lit(4)), F.col("hits") * 10),
    )
    p = p.withColumn("signals", F.filter(signals, lambda s: s.isNotNull())).where(F.size("signals") > 0).withColumn("top", F.array_max("signals"))
    bonus = F.when(F.col("first_seen"), policy.first_seen_bonus).otherwise(0)
    seen = {"hot_position": (hot, F.col("position")), "reply_delta": (F.col("replies") >= policy.reply_growth_min, F.col("replies")), "like_delta": (F.col("likes") >= policy.like_growth_min, F.col("likes")), "controversy_keywords": (F.col("hits") > 0, F.col("matched")), "recent_first_seen": (F.col("first_seen"), F.lit(True))}
    extra = F.to_json(F.struct(*(F.when(met, value).alias(name) for name, (met, value) in seen.items())))
    return p.select(extra.alias("extra"), "bvid", "rpid", "id", "captured_at", F.col("top.reason").alias("reason"), F.least(F.col("top.priority") + bonus, F.lit(100)).alias("priority"), (F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["score"]) + bonus).alias("score"), F.when(F.col("sort_mode") == "hot", F.col("position")).alias("hot_position"), "reply_count", "like_count")


def watchlist(candidates: DataFrame) -> DataFrame:
    """The list's row for each comment: best candidate's reason and extra, latest one's counts, a day to live."""
    best = F.max_by(F.struct("reason", "priority", "score", "extra"), F.struct("priority", "captured_at", "id"))
    last = F.max_by(F.struct("reply_count", "like_count", "id", "captured_at"), F.struct("captured_at", "id"))
    hot = F.max_by(F.when(F.col("hot_position").isNotNull(), F.col("hot_position")), F.when(F.col("hot_position").isNotNull(), F.struct("captured_at", "id")))
    out = candidates.groupBy("bvid", "rpid").agg(best.alias("b"), last.alias("l"), hot.alias("hot_position"), F.min("captured_at").alias("first_seen_at"))
    return out.select("bvid", "rpid", F.col("rpid").alias("root_rpid"), F.lit(True).alias("active"), "b.*", "hot_position", F.col("l.reply_count").alias("reply_count"), F.col("l.like_count").alias("like_count"), F.col("l.id").alias("last_comment_observation_id"), "first_seen_at", F.col("l.captured_at").alias("last_seen_at"), (F.col("l.captured_at") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))


def known_videos(sightings: DataFrame) -> DataFrame:
    """First sighting of each video: source_mid, pubdate, first_seen_at."""
    return sightings.groupBy("bvid").agg(F.min_by(F.struct("source_mid", "pubdate", F.col("captured_at").alias("first_seen_at")), F.struct("captured_at", "source_mid")).alias("f")).select("bvid", "f.*")


def video_sources(links: DataFrame) -> DataFrame:
    """Associations by (bvid, mid, pool): first row's fields stay, last seen and last page advance; equal times go by page_id."""
    key = ["bvid", "source_mid", "pool_type", "pool_id"]
    valid = links.where(" and ".join(f"trim({c}) != ''" for c in key))
    return valid.groupBy(*key).agg(F.min_by(F.struct("official", "monitored"), F.struct("captured_at", "page_id")).alias("f"), F.min("captured_at").alias("first_seen_at"), F.max("captured_at").alias("last_seen_at"), F.max_by("page_id", F.struct("captured_at", "page_id")).alias("last_page_id")).select(*key, "f.*", "first_seen_at", "last_seen_at", "last_page_id", F.lit(True).alias("active"))


def discovery_priority(videos: DataFrame, known: DataFrame, now: Column, late_seconds: int = 120) -> DataFrame:
    """New videos with delayed_discovery (90) or fresh_discovery (100)."""
    late = F.unix_micros(now) - F.unix_micros("pubdate") > late_seconds * 1_000_000
    return videos.join(known.select("bvid"), "bvid", "left_anti").withColumn("reason", F.when(late, "delayed_discovery").otherwise("fresh_discovery")).withColumn("priority", F.when(late, 90).otherwise(100))


def folded_targets(changes: DataFrame) -> DataFrame:
    """Event targets from their change log (ts, priority, active, extra map): greatest priority, merged maps, last state."""
    key = ["event_id", "target_type", "normalized_value"]
    maps = F.transform(F.array_sort(F.collect_list(F.struct("ts", "extra"))), lambda x: x["extra"])
    merged = F.reduce(maps, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda a, m: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(m, k)), m))
    return changes.groupBy(*key).agg(F.max("priority").alias("priority"), F.max_by("active", "ts").alias("active"), merged.alias("extra"))


def folded_event_videos(changes: DataFrame) -> DataFrame:
    """Event videos from attach rows (ts): last reason and confidence, first and last seen, active again."""
    return changes.groupBy("event_id", "bvid").agg(F.max_by(F.struct("source_target_id", "association_reason", "confidence", "active"), "ts").alias("l"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at")).select("event_id", "bvid", "l.*", "first_seen_at", "last_seen_at")


def cascaded(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Keywords or videos that are active only while their source target is."""
    state = targets.select(F.col("id").alias("source_target_id"), F.col("active").alias("_on"))
    return rows.join(state, "source_target_id", "left").withColumn("active", F.col("active") & F.coalesce("_on", F.lit(True))).drop("_on")


def with_assets(links: DataFrame, sources: DataFrame, assets: DataFrame) -> DataFrame:
    """Links with the asset of their source's content, on every link of the source.

    links: media_source_id; sources: media_source_id, blob_sha256; assets: exact_assets().
    """
    of_source = sources.join(assets.select("blob_sha256", "asset_id"), "blob_sha256").select("media_source_id", F.col("asset_id").alias("media_asset_id"))
    return links.join(of_source, "media_source_id", "left")
