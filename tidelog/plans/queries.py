"""Named queries: operators over the driver's tables, with flat results."""

from __future__ import annotations

import uuid
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.text import fold_text
from tidelog.functions.values import iso_time, url_base
from tidelog.functions.windows import as_of, bucket, newest
from tidelog.operators import assess, chains, cohorts, derive, event, flatten, graph, quality, targets, video
from tidelog.sources import bindings as b
from tidelog.session import checkpoint_folder, checkpointed
from tidelog.sources import files, sinks
from tidelog.streaming import jobs, ordered

DAY = 86_400
NOW = datetime(2024, 1, 20, 12, tzinfo=UTC)
NOW_S = int(NOW.timestamp())
LEXICON = {"support": ["the", "und", "que"], "criticism": ["idiot", "trash"], "neutral": ["for", "de la"]}
P = assess.Policy()
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: flat(f(spark, sf_dir))
    return f


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, times as epoch microseconds, lists as text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            c = c.cast("long")
        elif kind == "timestamp":
            c = F.unix_micros(c)
        elif kind.startswith("array<"):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        out.append(c.alias(name))
    return df.select(*out)


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event.in_scope(b.observations(spark, sf_dir), b.event_videos(spark))


def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return video.hot_turnover(*b.hot_pages(b.observations(spark, sf_dir)), top_n=5)


def documents_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.comments(spark, sf_dir).select(F.col("rpid").alias("id"), "rpid", "bvid", F.col("first_content").alias("content"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as comments: turn 0 is the root."""
    c = b.read(spark, sf_dir, "conversations").where("turn is not null")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("rpid"), F.concat(F.lit("v"), F.col("conv_id") % 15).alias("bvid"), (F.col("conv_id") % 40).alias("author_mid"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("root_rpid"), at.alias("first_seen_at"), F.col("text").alias("first_content"))


def exact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event.same_author_texts(b.comments(spark, sf_dir)).select("subject_rpid", "related_rpid")


@query
def keyword_trends(spark, sf_dir):
    return event.keyword_trends(scoped(spark, sf_dir), event.latest_keywords(b.event_keywords(spark)), b.SINCE, b.UNTIL, DAY)


@query
def keyword_trends_evidence(spark, sf_dir):
    return event.keyword_trends(scoped(spark, sf_dir), list(b.KEYWORDS), b.SINCE, b.UNTIL, DAY, evidence=True)


@query
def keyword_cooccurrence(spark, sf_dir):
    return event.co_occurrence(documents_obs(spark, sf_dir), ["the", "of", "que", "und"])


@query
def stance_evidence(spark, sf_dir):
    out = event.stance(documents_obs(spark, sf_dir), LEXICON)
    return out.withColumn("terms", F.array_join(F.transform("terms", lambda t: F.concat_ws("=", t["term"], t["n"].cast("string"))), ",")).fillna("", ["terms"])


@query
def hot_turnover(spark, sf_dir):
    return turnover(spark, sf_dir).withColumn("turnover_rate", F.round("turnover_rate", 6))


@query
def hot_replay(spark, sf_dir):
    pages, on_page = b.hot_pages(b.observations(spark, sf_dir))
    media = b.media_links(spark, sf_dir).select("comment_observation_id", "position", "media_source_id")
    r = video.hot_replay(pages, on_page, media, 5).select("page_id", F.explode("comments").alias("c"))
    return r.select("page_id", "c.position", "c.rpid", "c.comment_observation_id", F.size(F.coalesce("c.media", F.array())).alias("n_media"))


@query
def metric_replay(spark, sf_dir):
    return video.metric_replay(b.metrics(spark, sf_dir), datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 25, tzinfo=UTC), ("view_count", "like_count", "coin_count"))


@query
def view_growth(spark, sf_dir):
    return video.view_growth(b.metrics(spark, sf_dir), NOW - timedelta(days=2), NOW)


@query
def latest_metrics(spark, sf_dir):
    return as_of(b.metrics(spark, sf_dir), "bvid", "captured_at", NOW, "raw_payload_id").select("bvid", "captured_at", "view_count", "like_count")


@query
def recent_topn(spark, sf_dir):
    return newest(b.metrics(spark, sf_dir), "bvid", 5, "captured_at", "raw_payload_id").select("bvid", "captured_at", "view_count", "raw_payload_id")


@query
def latest_availability(spark, sf_dir):
    return video.latest_availability(b.event_videos(spark), b.metrics(spark, sf_dir))


@query
def state_changes(spark, sf_dir):
    return derive.state_changes(b.observations(spark, sf_dir))


def split_marks(spark, sf_dir):
    obs = b.observations(spark, sf_dir)
    return obs.where("event_type != 'signup'"), obs.where("event_type = 'signup'")


@query
def visibility_transitions(spark, sf_dir):
    return derive.visibility_events(*split_marks(spark, sf_dir))


@query
def visibility_replay(spark, sf_dir):
    obs, marks = split_marks(spark, sf_dir)
    return video.visibility_replay(derive.visibility_events(obs, marks), obs)


@query
def comment_entities(spark, sf_dir):
    return derive.entities(b.observations(spark, sf_dir), later=("author_mid",))


@query
def watchlist(spark, sf_dir):
    w = derive.watchlist(derive.watch_candidates(b.observations(spark, sf_dir), derive.WatchPolicy(keywords=("error", "purchase"))))
    return w.withColumn("score", F.round("score", 6))


@query
def media_changes(spark, sf_dir):
    links = b.media_links(spark, sf_dir)
    return derive.media_changes(links, links.select(F.col("comment_observation_id").alias("id"), "rpid"), b.parts_of(spark, sf_dir, "lineitem"))


@query
def media_links(spark, sf_dir):
    return derive.first_links(b.media_links(spark, sf_dir), "arrived").drop("arrived")


@query
def exact_dedup(spark, sf_dir):
    return derive.exact_assets(b.read(spark, sf_dir, "documents"), "doc_id", "text")


@query
def reuse_ranking(spark, sf_dir):
    d = b.comments(spark, sf_dir).withColumn("asset", F.sha2("first_content", 256))
    return graph.reuse_ranking(d, "asset")


@query
def duplicate_display(spark, sf_dir):
    _, on_page = b.hot_pages(b.observations(spark, sf_dir))
    return event.duplicate_display(on_page)


@query
def same_author_pairs(spark, sf_dir):
    return event.same_author_texts(b.comments(spark, sf_dir))


@query
def template_candidates(spark, sf_dir):
    """Exact ones; tests hold fuzzy ones against a plain loop."""
    return event.templates(b.comments(spark, sf_dir), DAY, 1.0)


@query
def template_candidates_keyword(spark, sf_dir):
    """Exact ones among comments that hold a keyword."""
    return event.templates(event.literal_filter(b.comments(spark, sf_dir), "first_content", " The  "), DAY, 1.0)


@query
def template_candidates_fuzzy(spark, sf_dir):
    return event.templates(b.comments(spark, sf_dir), 3600, 0.85)


def flagged_comments(spark, sf_dir):
    same = event.same_author_texts(b.comments(spark, sf_dir)).select(F.lit(1).alias("event_id"), F.lit("same_user_duplicate_submission").alias("flag_type"), "subject_rpid", "related_rpid", F.lit(None).cast("string").alias("evidence_scope"))
    _, on_page = b.hot_pages(b.observations(spark, sf_dir))
    shown = event.duplicate_display(on_page).select(F.lit(1).alias("event_id"), F.lit("same_rpid_duplicate_display").alias("flag_type"), F.col("rpid").alias("subject_rpid"), F.lit(None).cast("long").alias("related_rpid"), F.col("page_id").alias("evidence_scope"))
    return event.keyed_flags(same.unionByName(shown))


@query
def comment_flags(spark, sf_dir):
    return flagged_comments(spark, sf_dir)


@query
def propagation_nodes(spark, sf_dir):
    own = b.comments(spark, sf_dir).withColumn("root_rpid", F.when(F.col("rpid") % 3 == 0, F.col("rpid") - 1))
    return event.propagation_nodes(own, event.same_author_counts(own), b.event_targets(spark), b.SINCE, b.UNTIL)


@query
def propagation_evidence(spark, sf_dir):
    flags = exact_flags(spark, sf_dir).withColumn("id", F.col("subject_rpid") * 1_000_000 + F.col("related_rpid"))
    return event.propagation_evidence(b.comments(spark, sf_dir), flags, b.SINCE, b.UNTIL)


@query
def flagged_counts(spark, sf_dir):
    """Flags of each comment, counted from pairs; same_author_counts() gives the same without them."""
    return event.flag_counts(exact_flags(spark, sf_dir))


@query
def propagation_replay(spark, sf_dir):
    videos = b.event_videos(spark).withColumn("first_seen_at", F.lit(b.SINCE) + F.expr("INTERVAL 1 HOUR"))
    flags = entities(spark, sf_dir).where("root_rpid is not null").select(F.col("root_rpid").alias("subject_rpid"), F.col("rpid").alias("related_rpid"))
    return event.propagation_replay(videos, entities(spark, sf_dir), flags, b.SINCE, b.UNTIL)


@query
def reply_edges(spark, sf_dir):
    return event.reply_edges(entities(spark, sf_dir))


def first_seen(spark, sf_dir):
    return event.in_scope(derive.entities(b.observations(spark, sf_dir), later=()), b.event_videos(spark))


@query
def comment_spike(spark, sf_dir):
    return event.comment_spikes(first_seen(spark, sf_dir), b.SINCE, b.UNTIL, 3600, 1.2, 1)


@query
def keyword_spike(spark, sf_dir):
    return event.keyword_spikes(scoped(spark, sf_dir), list(b.KEYWORDS), b.SINCE, b.UNTIL, 3600, 1.5, 3)


@query
def spike_evidence(spark, sf_dir):
    """What the spikes of first comments and of keywords rest on."""
    entities = first_seen(spark, sf_dir).select(F.lit("event").alias("scope"), bucket(F.col("first_seen_at"), 3600).alias("bucket"), "rpid", F.lit(None).cast("long").alias("observation_id"), F.col("first_raw_payload_id").alias("raw_payload_id"))
    hits = event.matched(scoped(spark, sf_dir), list(b.KEYWORDS)).select(F.explode("hits").alias("scope"), bucket(F.col("captured_at"), 3600).alias("bucket"), "rpid", F.col("id").alias("observation_id"), "raw_payload_id")
    spikes = comment_spike(spark, sf_dir).unionByName(keyword_spike(spark, sf_dir))
    return event.spike_evidence(spikes, entities.unionByName(hits))


@query
def filtered_spikes(spark, sf_dir):
    """Spikes among comments that hold one keyword."""
    first = event.literal_filter(first_seen(spark, sf_dir), "first_content", "Error")
    rows = event.literal_filter(scoped(spark, sf_dir), "content", "Error")
    return event.comment_spikes(first, b.SINCE, b.UNTIL, 3600, 1.2, 1).unionByName(event.keyword_spikes(rows, ["error"], b.SINCE, b.UNTIL, 3600, 1.5, 3))


@query
def turnover_signal(spark, sf_dir):
    return event.turnover_signals(turnover(spark, sf_dir), 0.9)


@query
def creator_signal(spark, sf_dir):
    return event.creator_signals(event.in_scope(b.metrics(spark, sf_dir), b.event_videos(spark)), b.event_targets(spark), b.SINCE, b.UNTIL)


@query
def turnover_signal_evidence(spark, sf_dir):
    return event.turnover_evidence(turnover(spark, sf_dir), 0.9)


@query
def creator_signal_evidence(spark, sf_dir):
    return event.creator_evidence(event.in_scope(b.infos(spark, sf_dir), b.event_videos(spark)), b.event_targets(spark), b.SINCE, b.UNTIL)


@query
def turning_points(spark, sf_dir):
    out = comment_spike(spark, sf_dir)
    for f in (keyword_spike, turnover_signal, creator_signal):
        out = out.unionByName(f(spark, sf_dir))
    return out


@query
def timeline(spark, sf_dir):
    """Records of all four sources, of one video in a window."""
    at, created = F.col("captured_at"), F.col("created_at")
    of_change = F.concat_ws(":", "rpid", F.coalesce("current_id", "previous_id"), "event_type")
    return event.timeline(
        b.SINCE, datetime(2024, 1, 25, tzinfo=UTC), "v4",
        event_video_associated=(b.event_videos(spark), F.col("first_seen_at"), F.concat_ws(":", "event_id", "bvid")),
        video_metric_snapshot=(b.metrics(spark, sf_dir), at, F.concat_ws(":", "bvid", iso_time(at))),
        comment_state_event=(derive.state_changes(b.observations(spark, sf_dir)), created, of_change),
        comment_visibility_event=(derive.visibility_events(*split_marks(spark, sf_dir)), created, of_change),
    )


@query
def timeline_records(spark, sf_dir):
    """Records of all four sources with what they hold."""
    at, created = F.col("captured_at"), F.col("created_at")
    of_change = F.concat_ws(":", "rpid", F.coalesce("current_id", "previous_id"), "event_type")
    of_comment = ["rpid", "event_type", F.col("previous_id").alias("previous_comment_observation_id"), F.col("current_id").alias("current_comment_observation_id")]
    return event.timeline(
        b.SINCE, b.UNTIL,
        event_video_associated=(b.event_videos(spark), F.col("first_seen_at"), F.concat_ws(":", "event_id", "bvid"), ["active", "association_reason", "confidence"]),
        video_metric_snapshot=(b.metrics(spark, sf_dir), at, F.concat_ws(":", "bvid", iso_time(at)), ["view_count", "like_count", "coin_count", "raw_payload_id"]),
        comment_state_event=(derive.state_changes(b.observations(spark, sf_dir)), created, of_change, [*of_comment, "old_value", "new_value"]),
        comment_visibility_event=(derive.visibility_events(*split_marks(spark, sf_dir)), created, of_change, [*of_comment, "old_visibility", "new_visibility"]),
    )


@query
def coverage(spark, sf_dir):
    videos = b.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"), (F.col("s_suppkey") % 5 != 0).alias("active"))
    return event.coverage_summary(b.coverage(spark, sf_dir), videos)


@query
def coverage_window(spark, sf_dir):
    """Of a list of videos, what finished in a window."""
    videos = b.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"), (F.col("s_suppkey") % 5 != 0).alias("active"))
    return event.coverage_summary(b.coverage(spark, sf_dir), videos, date(1995, 2, 1), date(1996, 2, 1), list(range(1, 9)))


@query
def coverage_by_kind(spark, sf_dir):
    return quality.coverage_by_kind(b.coverage(spark, sf_dir))


@query
def failure_window(spark, sf_dir):
    return quality.failure_window(b.coverage(spark, sf_dir), F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date"))


@query
def queue_depth(spark, sf_dir):
    return quality.queue_depth(b.tasks(spark, sf_dir), F.lit("1998-12-31").cast("date"))


@query
def core_videos(spark, sf_dir):
    return event.core_videos(b.event_videos(spark), b.infos(spark, sf_dir), b.metrics(spark, sf_dir), NOW)


@query
def failure_streak(spark, sf_dir):
    o = b.observations(spark, sf_dir)
    return quality.failure_streaks(o.select("bvid", F.col("captured_at").alias("at"), "id", (F.col("event_type") != "view").alias("failed"), F.when(F.col("reply_count") < 20, F.col("reply_count")).alias("retry_after")), "bvid")


@query
def alert_transitions(spark, sf_dir):
    """Alerts by kind of run: failing where a tenth of its pages had errors."""
    drafts = b.coverage(spark, sf_dir).groupBy(F.col("task_kind").alias("alert_key")).agg((F.sum("request_errors") / F.sum("pages_requested") >= 0.155).alias("triggered"))
    kinds = b.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("alert_key")).distinct()
    n = F.substring("alert_key", 1, 1).cast("long")
    state = kinds.select("alert_key", (n % 2 == 1).alias("active"), n.alias("occurrences"), F.when(n != 3, F.lit(1000) * n).alias("notified_at"))
    return quality.alert_transitions(state, drafts, F.lit(6000).cast("long"))


@query
def signature_edges(spark, sf_dir):
    return graph.signature_edges(b.signatures(spark, sf_dir), 5)


@query
def signature_clusters(spark, sf_dir):
    return graph.signature_clusters(b.signatures(spark, sf_dir), 5).select("cluster", "member", "distance")


@query
def template_clusters(spark, sf_dir):
    return event.template_clusters(event.template_links(b.comments(spark, sf_dir), DAY))


@query
def evidence_index(spark, sf_dir):
    t = state_changes(spark, sf_dir)
    return event.evidence_index(previous_observation__a=t.select("previous_id"), current_observation__b=t.select("current_id"), raw_payload__c=b.metrics(spark, sf_dir).select("raw_payload_id"))


@query
def page_flatten(spark, sf_dir):
    r = flatten.comment_rows(flatten.parsed_pages(b.reply_pages(spark, sf_dir), "reply"))
    return r.select("rpid", "bvid", "position", "root_rpid", "author_mid", "author_name", "content_hash", "visibility")


@query
def page_facts(spark, sf_dir):
    return flatten.page_rows(flatten.parsed_pages(b.reply_pages(spark, sf_dir), "reply")).select("raw_payload_id", "bvid", "item_count", "is_end", "status")


def comment_records(spark, sf_dir):
    """Documents as comments with all the fields of candidates."""
    c = b.comments(spark, sf_dir)
    return c.select("rpid", "bvid", "author_mid", F.concat(F.lit("n"), F.col("author_mid")).alias("author_name"), "first_content", "first_seen_at", F.when(F.col("rpid") % 4 != 3, F.floor(F.col("rpid") / 3)).cast("long").alias("first_raw_payload_id"))


def numbered_clusters(spark, sf_dir):
    own = b.comments(spark, sf_dir)
    return event.numbered_clusters(event.template_links(own, DAY), own)


@query
def template_cluster_edges(spark, sf_dir):
    """Candidates by the cluster that they make."""
    found = event.templates(b.comments(spark, sf_dir), DAY, 1.0)
    return event.cluster_edges(found, numbered_clusters(spark, sf_dir)).select("cluster_id", "left_rpid", "right_rpid", "similarity", "seconds_apart")


def members_of_clusters(spark, sf_dir):
    return event.cluster_members(numbered_clusters(spark, sf_dir), comment_records(spark, sf_dir))


@query
def template_cluster_members(spark, sf_dir):
    """Members of clusters with author, text and raw payload."""
    return members_of_clusters(spark, sf_dir).withColumn("content", F.sha2("content", 256))


@query
def template_cluster_summaries(spark, sf_dir):
    return event.cluster_summaries(members_of_clusters(spark, sf_dir))


@query
def template_candidate_records(spark, sf_dir):
    """Candidates of one event with both comments' authors, texts and payloads."""
    found = event.with_members(event.templates(b.comments(spark, sf_dir), DAY, 1.0), comment_records(spark, sf_dir), 7, "e-7", DAY, 1.0)
    return found.withColumns({c: F.sha2(c, 256) for c in ("left_content", "right_content")})


@query
def page_chain_audit(spark, sf_dir):
    c = b.read(spark, sf_dir, "conversations").where("turn is not null")
    pages = c.select(F.col("conv_id").alias("crawl"), F.col("turn").alias("page_number"), F.concat(F.lit("c"), F.col("turn") % 5).alias("cursor"), F.concat(F.lit("c"), (F.col("turn") + 1) % 5).alias("next_offset"), F.array(F.col("turn")).alias("rpids"), F.array(F.lit(3).cast("long"), F.lit(7).cast("long")).alias("anchors"), (F.col("turn") == 4).alias("is_end"))
    return quality.page_chain_audit(pages)


def assessed(spark, sf_dir):
    """Signals of each video at NOW."""
    m = b.metrics(spark, sf_dir)
    growth = video.view_growth(m, NOW - timedelta(days=2), NOW).withColumnRenamed("view_growth", "views_hour")
    first = m.groupBy("bvid").agg(F.min("captured_at").alias("first_at"), F.min("raw_payload_id").alias("first_id"))
    v = first.join(growth, "bvid", "left").join(b.event_videos(spark).select("bvid", "active"), "bvid", "left")
    n = F.substring("bvid", 2, 9).cast("long")
    return v.select("bvid", "first_at", F.unix_seconds("first_at").alias("anchor"), (F.lit(NOW_S) - F.unix_seconds("first_at")).alias("age_seconds"), "views_hour", n.alias("n"), (n == 3).alias("official"), (n == 7).alias("event_core"), F.lit(False).alias("major_creator"), F.when(n == 9, "b").alias("pinned_tier"), (n * 4).alias("comments_hour"), (n / 40).alias("turnover"), F.lit(2).alias("confirmations"), (n % 2 == 0).alias("input_complete"))


@query
def tier_assessment(spark, sf_dir):
    a = assessed(spark, sf_dir).withColumn("desired", assess.desired_tier(P))
    s = a.withColumns({"effective": F.lit("a"), "candidate": F.when(F.col("n") % 3 == 0, "c"), "downgrades": F.when(F.col("n") % 3 == 0, 1).otherwise(0)})
    return assess.with_hysteresis(s, P).select("bvid", "desired", "effective", "candidate", "downgrades")


@query
def tier_history(spark, sf_dir):
    o = b.observations(spark, sf_dir)
    desired = F.element_at(F.array(F.lit("s"), F.lit("a"), F.lit("b"), F.lit("c")), (F.col("reply_count") % 4 + 1).cast("int"))
    return assess.tier_history(o.select("bvid", F.struct("captured_at", "id").alias("at"), desired.alias("desired")), P, block=F.floor(F.unix_seconds("at.captured_at") / 3600))


@query
def life_stage(spark, sf_dir):
    a = assessed(spark, sf_dir).withColumn("low_growth", F.when(F.col("n") % 4 != 0, F.col("views_hour") < 1200)).withColumn("age_seconds", F.col("age_seconds") + F.col("n") * 2 * DAY)
    return a.select("bvid", assess.life_stage(P).alias("life_stage"))


@query
def next_due(spark, sf_dir):
    a = assessed(spark, sf_dir).withColumn("desired", assess.desired_tier(P))
    interval = assess.effective_interval(F.lit(NOW), F.col("age_seconds"), F.col("views_hour"), F.col("desired"), F.lit(None).cast("int"), P)
    return a.withColumn("interval", interval).select("bvid", "interval", assess.next_slot(F.col("anchor"), F.lit(NOW_S), F.col("interval")).alias("next_due"))


def slots(spark, sf_dir):
    a = assessed(spark, sf_dir)
    near = a.select("bvid", (F.lit(NOW_S) - F.col("n") * 7200).alias("anchor"), (F.lit(NOW_S) - F.col("n") * 3600).alias("discovered"))
    return assess.checkpoint_slots(near, NOW_S, P)


@query
def checkpoint_slots(spark, sf_dir):
    return slots(spark, sf_dir)


@query
def recovery_slots(spark, sf_dir):
    return assess.recovery_slots(slots(spark, sf_dir))


@query
def schedule_gaps(spark, sf_dir):
    a = assessed(spark, sf_dir)
    return assess.schedule_gaps(a.select("bvid", (F.col("anchor") + F.col("n") * DAY).alias("next_due"), (F.col("n") * 600 + 60).alias("interval")), NOW_S)


@query
def cohort_status(spark, sf_dir):
    o = b.observations(spark, sf_dir)
    status = F.element_at(F.array(*(F.lit(s) for s in ("pending", "complete", "blocked", "not_applicable", "missed_due_to_capacity", "complete", "running", "corrupted"))), F.when(F.col("rpid") % 11 == 0, F.col("reply_count") % 8 + 1).when(F.col("rpid") % 3 == 0, 2).otherwise(F.col("rpid") % 5 + 1).cast("int"))
    return assess.cohort_status(o.select(F.col("rpid").alias("cohort"), status.alias("status"), (F.col("reply_count") > 50).alias("started"), (F.col("reply_count") > 10).alias("required")))


@query
def due_list(spark, sf_dir):
    a = assessed(spark, sf_dir)
    v = a.select("bvid", "anchor", (F.lit(NOW_S) - F.col("n") * 900).alias("last_snapshot"), "views_hour", (F.col("n") % 5 != 0).alias("available"))
    return assess.due_list(v, NOW_S).select("bvid", "due")


@query
def terminal_list(spark, sf_dir):
    a = assessed(spark, sf_dir)
    v = a.select("bvid", F.col("first_at").alias("pubdate"), F.col("first_at").alias("first_seen_at"), (F.col("n") % 5 != 0).alias("available"))
    listed = v.where("bvid = 'v1'").select("bvid", F.lit("2024-01-20").alias("date"))
    return assess.terminal_list(v, listed, datetime(2024, 1, 20, 15, tzinfo=UTC), P).select("bvid", "date")


@query
def raw_integrity(spark, sf_dir):
    d = b.read(spark, sf_dir, "documents")
    return quality.raw_integrity(d, "text", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.sha2("text", 256)), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.octet_length("text")))


@query
def month_layout(spark, sf_dir):
    o = b.read(spark, sf_dir, "orders").select(b.utc(F.col("o_orderdate").cast("timestamp_ntz")).alias("at"), "o_totalprice")
    return sinks.with_month(o, "at").groupBy("captured_month").agg(F.count("*").alias("rows"))


@query
def folded_texts(spark, sf_dir):
    d = b.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(fold_text(F.col("text"), "fold"), 256).alias("folded_sha256"))


def in_triggers(spark, rows, time, **end):
    """rows as a stream of several triggers, whose watermark passes all of them."""
    return ordered.in_triggers(rows, shared_folder(spark, "in"), time, end=end)


@query
def stream_state_changes(spark, sf_dir):
    """The folds of a stream that comes in several triggers, out of order."""
    obs = b.observations(spark, sf_dir).select("id", "rpid", "bvid", "captured_at", "content", "like_count", "reply_count", "sort_mode", "position")
    return jobs.drained(jobs.state_changes(in_triggers(spark, obs, "captured_at"), "400 days"), shared_folder(spark, "stream"))


@query
def stream_trends(spark, sf_dir):
    obs = b.observations(spark, sf_dir).select("id", "rpid", "captured_at", "content")
    return jobs.drained(jobs.keyword_counts(in_triggers(spark, obs, "captured_at", content=b.KEYWORDS[0]), list(b.KEYWORDS), DAY, "400 days"), shared_folder(spark, "stream"))


@query
def hot_changes(spark, sf_dir):
    pages, on_page = b.hot_pages(b.observations(spark, sf_dir))
    return event.hot_changes(video.hot_turnover(pages, on_page, 5), on_page).select("current_page_id", "previous_observation_ids", "current_observation_ids")


@query
def hot_change_payloads(spark, sf_dir):
    obs = b.observations(spark, sf_dir)
    pages, on_page = b.hot_pages(obs)
    payloads = on_page.join(obs.select(F.col("id").alias("comment_observation_id"), "raw_payload_id"), "comment_observation_id").select("page_id", "raw_payload_id")
    return event.hot_change_payloads(video.hot_turnover(pages, on_page, 5), payloads)


@query
def media_sources(spark, sf_dir):
    links = b.read(spark, sf_dir, "lineitem").join(b.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    at = b.utc(F.col("o_orderdate").cast("timestamp_ntz"))
    own = links.select(F.lit("p").alias("platform"), F.concat(F.lit("https://x.org/"), F.col("l_partkey") % 50).alias("url"), at.alias("captured_at"), F.col("l_orderkey").alias("page_id"))
    return derive.media_sources(own)


def sightings(spark, sf_dir):
    """Orders as sightings of customers' videos."""
    at = b.utc(F.col("o_orderdate").cast("timestamp_ntz"))
    return b.read(spark, sf_dir, "orders").select(F.concat(F.lit("v"), F.col("o_custkey")).alias("bvid"), F.col("o_orderkey").cast("string").alias("source_mid"), at.alias("pubdate"), at.alias("captured_at"), F.col("o_orderpriority").alias("pool_type"), F.col("o_orderstatus").alias("pool_id"), (F.col("o_orderkey") % 2 == 0).alias("official"), F.lit(True).alias("monitored"))


@query
def known_videos(spark, sf_dir):
    return derive.known_videos(sightings(spark, sf_dir).withColumn("source_mid", F.lpad("source_mid", 12, "0")))


@query
def video_sources(spark, sf_dir):
    own = sightings(spark, sf_dir).withColumn("page_id", F.col("source_mid").cast("long")).withColumn("source_mid", F.col("pool_id"))
    return derive.video_sources(own)


@query
def discovery_priority(spark, sf_dir):
    s = sightings(spark, sf_dir)
    known = s.where(F.col("captured_at") < F.lit(datetime(1993, 1, 1, tzinfo=UTC))).select("bvid").distinct()
    new = s.groupBy("bvid").agg(F.max("pubdate").alias("pubdate"))
    return derive.discovery_priority(new, known, F.lit(datetime(1998, 1, 1, tzinfo=UTC)))


@query
def event_video_log(spark, sf_dir):
    log = sightings(spark, sf_dir).select(F.lit(1).cast("long").alias("event_id"), "bvid", F.col("source_mid").cast("long").alias("source_target_id"), F.col("pool_type").alias("association_reason"), F.lit(1.0).alias("confidence"), F.lit(True).alias("active"), F.struct("captured_at", "source_mid").alias("ts"))
    return derive.folded_event_videos(log).select("event_id", "bvid", F.col("first_seen_at.captured_at").alias("first_seen_at"), F.col("last_seen_at.captured_at").alias("last_seen_at"), "active")


@query
def active_event_videos(spark, sf_dir):
    """Videos that are active only while their target (the nation) is."""
    targets = b.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") != 2).alias("active"))
    videos = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bvid"), F.col("c_nationkey").alias("source_target_id"), F.lit(True).alias("active"))
    return derive.cascaded(videos, targets)


def metric_payloads(spark, sf_dir):
    m = b.metrics(spark, sf_dir)
    body = F.to_json(F.struct(F.when(F.col("status") == "deleted", -404).otherwise(0).alias("code"), F.struct(F.struct(F.col("view_count").alias("view"), F.col("like_count").alias("like"), F.col("coin_count").alias("coin")).alias("stat"), F.concat(F.lit("t"), F.col("raw_payload_id")).alias("title"), F.struct(F.col("owner_mid").alias("mid")).alias("owner"), F.col("bvid"), F.array(F.lit("x"), F.lit(" y "), F.lit("x")).alias("tag"), F.lit("y").alias("tname")).alias("data")))
    return m.select("bvid", "captured_at", "raw_payload_id", body.alias("body"))


@query
def metric_flatten(spark, sf_dir):
    return flatten.video_metrics(metric_payloads(spark, sf_dir)).select("bvid", "raw_payload_id", "view_count", "like_count", "coin_count", "share_count")


@query
def info_flatten(spark, sf_dir):
    out = flatten.video_info(metric_payloads(spark, sf_dir))
    return out.select("raw_payload_id", "title", "owner_mid", F.col("tags.names").alias("tag_names"), F.col("tags.source_fields").alias("tag_fields"))


@query
def availability_flatten(spark, sf_dir):
    return flatten.video_availability(metric_payloads(spark, sf_dir)).select("raw_payload_id", "status", "code")


@query
def request_errors(spark, sf_dir):
    """Orders as requests: status by priority."""
    o = b.read(spark, sf_dir, "orders")
    status = F.element_at(F.array(*(F.lit(s) for s in (403, 429, 412, 503, 200))), F.substring("o_orderpriority", 1, 1).cast("int"))
    from tidelog.functions.values import error_class

    return o.groupBy(error_class(status, F.col("o_comment") if "o_comment" in o.columns else F.lit("")).alias("kind")).agg(F.count("*").alias("requests"))


@query
def run_summary(spark, sf_dir):
    return quality.run_summary(b.tasks(spark, sf_dir).withColumn("run_id", F.col("id") % 10).withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status"))))


@query
def slot_plan(spark, sf_dir):
    """Next routine slots with key, priority and number of components."""
    a = assessed(spark, sf_dir).withColumn("tier", assess.desired_tier(P))
    slot = assess.next_slot(F.col("anchor"), F.lit(NOW_S), F.lit(600))
    stage = F.when(F.col("n") % 3 == 0, "archived").when(F.col("n") % 3 == 1, "dormant").otherwise("active")
    return a.select("bvid", cohorts.routine_key(F.col("bvid"), slot).alias("slot_key"), assess.slot_priority(F.lit("routine"), F.col("tier")).alias("priority"), F.size(assess.component_kinds(stage, F.col("n") % 2 == 0)).alias("components"))


@query
def cohort_plans(spark, sf_dir):
    """Customers as videos, line items as components of their checkpoints that were tried."""
    c, hours = F.col("c_custkey"), F.array(*(F.lit(h) for h in P.checkpoint_hours))
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (n + 1).cast("int"))
    people = b.read(spark, sf_dir, "customer").select(c, F.concat(F.lit("v"), c).alias("bvid"))
    videos = people.select("bvid", pick(assess.TIERS, c % 4).alias("tier"), pick(("active", "dormant", "archived"), c % 3).alias("stage"), (c % 2 == 0).alias("frontier_complete"), (c % 5 < 2).alias("first_active"), (c % 7 != 0).alias("routine_due"))
    due = people.select("bvid", c, F.explode(hours).alias("hours")).select("bvid", "hours", pick(("planned", "missed", "not_applicable", "not_applicable", "missed"), (c + F.col("hours") / 6) % 5).alias("state"), (c % 3 == 0).alias("in_bucket"))
    items = b.read(spark, sf_dir, "lineitem").join(b.read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind, first = pick(("video_metrics", "hot_core", "hot_deep", "latest_reconciliation"), F.col("l_orderkey") % 4), F.col("l_partkey") % 3 + 1
    status = F.when(F.col("l_returnflag") == "N", "pending").when(F.col("l_returnflag") == "R", "complete").otherwise("failed")
    tried = items.select(F.concat(F.lit("v"), F.col("o_custkey")).alias("bvid"), F.element_at(hours, (F.col("l_linenumber") % 4 + 1).cast("int")).alias("hours"), kind.alias("component_kind"), F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey", "l_suppkey", "l_returnflag", status.alias("status"), F.when(F.col("l_suppkey") % 2 == 0, first).alias("start_page"), F.when(F.col("l_suppkey") % 2 == 0, first + F.col("l_linenumber")).alias("end_page")).alias("r"))
    attempts = tried.groupBy("bvid", "hours", "component_kind").agg(F.max("r").alias("r")).select("bvid", "hours", "component_kind", "r.status", "r.start_page", "r.end_page")
    return cohorts.cohort_plans(videos, due, attempts, NOW_S, {"s": 3, "a": 2, "b": 1, "c": 1}, {"s": 5, "a": 4, "b": 3, "c": 1})


@query
def cursor_chain_audit(spark, sf_dir):
    """Events as pages of crawls, whose cursors make the order; some lead back, some share a cursor, some lead nowhere."""
    e, n = b.read(spark, sf_dir, "events"), F.col("event_id")
    w = Window.partitionBy("crawl").orderBy("ts", "event_id")
    pages = e.select((F.col("user_id") % 97).alias("crawl"), "ts", "event_id", "user_id").withColumns({"k": F.row_number().over(w), "prior": F.lag("event_id").over(w), "after": F.lead("event_id").over(w)})
    cursor = F.concat(F.lit("c"), F.when(n % 53 == 0, F.coalesce("prior", n)).otherwise(n).cast("string"))
    onward = F.when(n % 211 == 0, "nowhere").when((n % 389 == 0) & (F.col("k") > 3), F.concat(F.lit("c"), F.col("prior").cast("string"))).otherwise(F.concat(F.lit("c"), F.col("after").cast("string")))
    own = pages.select("crawl", F.col("event_id").alias("page_id"), cursor.alias("cursor"), onward.alias("next_cursor"), F.array("user_id").alias("rpids"), F.when(F.col("crawl") % 4 == 0, F.array(F.col("crawl") + 97)).otherwise(F.array(F.lit(-1).cast("long"))).alias("anchors"), F.col("after").isNull().alias("is_end"))
    return chains.chain_audit(own)


def page_archive(spark, sf_dir):
    """Pages as captured bodies in an archive of the shared folder, and the archive's rows."""
    path = shared_folder(files.register(spark), "raw")
    n = F.col("page_id")
    pages = b.read(spark, sf_dir, "pages").where("html is not null")
    bodies = pages.select(F.timestamp_seconds(F.lit(1704067200) + n % 10 * DAY + 3600).alias("captured_at"), F.concat(F.lit("run"), n % 3).alias("run"), F.lit(".html").alias("suffix"), F.encode("html", "utf-8").alias("body"))
    bodies.write.format("tidelog_archive").mode("append").save(path)
    return spark.read.format("tidelog_archive").load(path)


@query
def raw_archive(spark, sf_dir):
    """All days of an archive, by day and run."""
    return page_archive(spark, sf_dir).groupBy(F.col("date").cast("string").alias("date"), "run").agg(F.count("*").alias("payloads"), F.sum(F.octet_length("body")).alias("bytes"), F.count_if("intact").alias("intact"))


@query
def raw_archive_day(spark, sf_dir):
    """One day of an archive; no other is listed."""
    day = page_archive(spark, sf_dir).where(F.col("date") == F.lit("2024-01-04").cast("date"))
    return day.select("run", "payload_hash", "suffix", F.octet_length("body").alias("bytes"), "intact")


@query
def visibility_replay_window(spark, sf_dir):
    obs, marks = split_marks(spark, sf_dir)
    return video.visibility_replay(derive.visibility_events(obs, marks), obs, datetime(2024, 1, 5, tzinfo=UTC), datetime(2024, 1, 15, tzinfo=UTC))


@query
def template_flags(spark, sf_dir):
    """Flags of candidates, keyed by how they were found."""
    drafts = event.template_flags(event.templates(b.comments(spark, sf_dir), DAY, 1.0), DAY, 1.0)
    return event.keyed_flags(drafts.withColumns({"event_id": F.lit(3), "evidence_scope": F.lit(None).cast("string")})).drop("evidence_scope")


@query
def flags_refreshed(spark, sf_dir):
    """A refresh of all three kinds of flags, where those of every third subject are there already."""
    columns = ["event_id", "flag_type", "subject_rpid", "related_rpid", "evidence_scope", "stable_key"]
    templates_ = event.template_flags(event.templates(b.comments(spark, sf_dir), DAY, 1.0), DAY, 1.0)
    third = event.keyed_flags(templates_.withColumns({"event_id": F.lit(1), "evidence_scope": F.lit(None).cast("string")})).select(*columns)
    drafts = checkpointed(flagged_comments(spark, sf_dir).select(*columns).unionByName(third))
    return event.refreshed(drafts, drafts.where("subject_rpid % 3 = 0"))


def target_log(spark, sf_dir):
    """Orders as the log of five events' targets."""
    o, k, n = b.read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 40
    kind = F.element_at(F.array(*(F.lit(x) for x in ("uid", "keyword", "seed_bvid"))), (k % 3 + 1).cast("int"))
    value = F.when(kind == "uid", n.cast("string")).when(kind == "keyword", F.concat(F.lit("Word "), n)).otherwise(F.concat(F.lit("v"), n))
    op = F.when(k % 7 == 0, "set_active").when(k % 7 == 1, "attach").otherwise("add")
    extra = F.map_from_arrays(F.array(F.concat(F.lit("k"), k % 4), F.lit("last")), F.array("o_orderpriority", k.cast("string")))
    return o.select(b.utc(F.col("o_orderdate").cast("timestamp_ntz")).alias("ts"), k.alias("seq"), op.alias("op"), (F.col("o_custkey") % 5).alias("event_id"), kind.alias("target_type"), value.alias("target_value"), F.lower(value).alias("normalized_value"), (k % 11).alias("priority"), (F.col("o_custkey") % 2 == 0).alias("active"), extra.alias("extra"), F.concat(F.lit("v"), n).alias("bvid"), F.concat(F.lit("by "), F.col("o_orderstatus")).alias("association_reason"), (k % 4 / 4).alias("confidence"))


@query
def target_states(spark, sf_dir):
    """Targets after all of the log."""
    extra = F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return targets.targets(target_log(spark, sf_dir)).withColumn("extra", extra)


@query
def target_keywords(spark, sf_dir):
    return targets.keywords(targets.targets(target_log(spark, sf_dir)))


@query
def target_videos(spark, sf_dir):
    log = target_log(spark, sf_dir)
    return targets.videos(log, targets.targets(log))


@query
def target_tasks(spark, sf_dir):
    log = target_log(spark, sf_dir)
    return targets.first_tasks(log, targets.targets(log))


#: Sections of a report from named queries, and what names a row of one.
REPORT = {
    "coverage": ("coverage", ("coverage_rows", "items_observed")), "key_timeline": ("timeline", ("source_key",)), "core_videos": ("core_videos", ("bvid", "view_count")), "hot_comment_changes": ("hot_changes", ("current_page_id", "current_observation_ids")),
    "keyword_trends": ("keyword_trends", ("keyword", "bucket", "distinct_comments")), "template_clusters": ("template_cluster_summaries", ("cluster_id", "members")), "evidence_index": ("evidence_index", ("kind", "id")),
}


@query
def report_sections(spark, sf_dir):
    """The ten sections of an event's report, published as one version and read back; a row is known by its names."""
    path = shared_folder(spark, "report")
    sections = {name: QUERIES[made](spark, sf_dir) for name, (made, _) in REPORT.items()}
    of_event = spark.range(1).select(F.lit("e-7").alias("slug"), F.lit("active").alias("status"))
    window = spark.range(1).select(F.lit(b.SINCE).alias("since"), F.lit(b.UNTIL).alias("until"))
    limits = event.limitations(coverage(spark, sf_dir))
    sinks.publish_report(path, event=of_event, window=flat(window), limitations=limits, **sections)
    names = {name: keys for name, (_, keys) in REPORT.items()} | {"event": ("slug",), "window": ("since", "until"), "limitations": ("limitation",)}
    found = sinks.read_report(spark, path)
    key = F.lit(None).cast("string")
    for name, keys in names.items():
        key = F.when(F.col("section") == name, F.concat_ws(":", *(F.get_json_object("value", f"$.{k}") for k in keys))).otherwise(key)
    return found.select("section", key.alias("key"))


@query
def finalized_components(spark, sf_dir):
    t = b.tasks(spark, sf_dir).select("id", F.when(F.col("status") == "succeeded", "complete").when(F.col("status") == "running", "blocked").otherwise(F.col("status")).alias("status"), (F.col("id") * 100).alias("deadline"))
    return assess.finalized(t, 1_000_000).groupBy("status").agg(F.count("*").alias("components"))


@query
def candidate_ranking(spark, sf_dir):
    """The 10 first videos to assess."""
    a = assessed(spark, sf_dir)
    states = a.where("n % 3 != 0").select("bvid", F.when(F.col("n") % 2 == 0, F.col("anchor") + F.col("n")).alias("next_due"))
    return assess.ranked_candidates(a.select("bvid", F.col("anchor").alias("first_seen")), states, 10).select("bvid")


@query
def focus_slots(spark, sf_dir):
    o = b.observations(spark, sf_dir)
    return o.where(assess.focus_slot(F.col("captured_at"), P.zone, 9, 18, ("10:00", "12:30", "15:15"))).select("id")


@query
def alert_drafts(spark, sf_dir):
    """Drafts over the runs and tasks; nations are the jobs, with their number as failures."""
    runs = b.coverage(spark, sf_dir).agg(F.sum("pages_requested").alias("pages"), F.sum("request_errors").alias("errors"))
    waiting = b.tasks(spark, sf_dir).where("status = 'pending'").agg(F.count("*").alias("pending"), F.lit(0).alias("oldest_seconds"))
    workers = b.read(spark, sf_dir, "supplier").agg(F.count_if(F.col("s_suppkey") < 0).alias("fresh_workers"))
    jobs = b.read(spark, sf_dir, "nation").select(F.col("n_name").alias("job_key"), (F.col("n_regionkey") != 1).alias("enabled"), (F.col("n_nationkey") % 5).alias("consecutive_failures"))
    return quality.alert_drafts(runs.crossJoin(waiting).crossJoin(workers), jobs)  # one row each


@query
def coverage_statuses(spark, sf_dir):
    """Status of each run from its marks."""
    runs = b.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97 == 0).alias("corrupted"), (F.col("l_linestatus") == "O").alias("truncated"), F.when(F.col("l_linenumber") == 3, "time_budget").when(F.col("l_linenumber") == 5, "done").alias("reason"), (F.col("l_linenumber") == 7).alias("failed"))
    return runs.groupBy(quality.coverage_status(F.col("failed")).alias("status")).agg(F.count("*").alias("runs"))


@query
def failed_attempts(spark, sf_dir):
    """Orders as attempts; times in days."""
    at = lambda n: b.utc((F.col("o_orderdate").cast("timestamp_ntz")) + F.make_dt_interval(mins=n))
    outcome = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "abandoned").otherwise("succeeded")
    attempts = b.read(spark, sf_dir, "orders").select("o_orderkey", at(F.lit(0)).alias("started_at"), at((F.col("o_orderkey") % 7 - 1).cast("int")).alias("finished_at"), outcome.alias("outcome"))
    return quality.failed_attempts(attempts, F.lit(datetime(1995, 1, 1, tzinfo=UTC)))


@query
def comment_media(spark, sf_dir):
    """Pictures of a page's comments, as texts and objects in both lists."""
    c = b.read(spark, sf_dir, "conversations").where("turn is not null")
    link = F.concat(F.lit("https://x.org/"), F.col("conv_id"), F.lit("?q="), F.col("turn"))
    item = F.to_json(F.struct(F.struct(F.array(link, F.lit(" ")).alias("pictures"), F.array(F.struct(F.concat(link, F.lit("&b")).alias("url"))).alias("picture")).alias("content")))
    found = flatten.comment_media(c.select(F.col("conv_id").alias("raw_payload_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("rpid"), item.alias("item")))
    return found.select("rpid", "position", "url", url_base(F.col("url")).alias("base"))


@query
def user_videos(spark, sf_dir):
    """Lists of videos of each customer: those without id or time are left out."""
    o = b.read(spark, sf_dir, "orders")
    video = F.struct(F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("v"), F.col("o_orderkey"))).alias("bvid"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") + 1_700_000_000).alias("created"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + 1_600_000_000).alias("pubdate"))
    body = F.to_json(F.struct(F.struct(F.struct(F.collect_list(video).alias("vlist")).alias("list")).alias("data")))
    pages = o.groupBy(F.col("o_custkey").alias("source_mid")).agg(body.alias("body")).withColumn("captured_at", F.timestamp_seconds(F.lit(NOW_S)))
    return flatten.user_videos(pages).drop("captured_at")


@query
def assessment_signals(spark, sf_dir):
    """Marks of each customer's videos, and their growth."""
    s = sightings(spark, sf_dir)
    videos = s.select("bvid").distinct()
    n = F.substring("bvid", 2, 12).cast("long")
    return assess.signals(videos, s.withColumn("active", F.col("pool_id") != "P"), videos.select("bvid", (n % 4 == 0).alias("active")), videos.where(n % 3 == 0).select("bvid", (n * 10).alias("views_hour")))


@query
def planning_signals(spark, sf_dir):
    """Signals of each video at NOW, of metrics, customers' videos as sources, two events and frontiers."""
    a = assessed(spark, sf_dir).select("bvid", "anchor", "n", "pinned_tier")
    events = spark.createDataFrame([(1, "active"), (2, "closed")], "id long, status string")
    of_event = b.event_videos(spark).withColumn("event_id", F.when(F.substring("bvid", 2, 9).cast("int") % 3 == 0, 1).otherwise(2))
    sources = sightings(spark, sf_dir).withColumn("active", F.col("pool_id") != "P")
    frontiers = a.select("bvid", F.when(F.col("n") % 2 == 0, "baseline_complete").otherwise("running").alias("baseline_status"))
    return assess.planning_signals(a.drop("n"), sources, of_event, events, b.metrics(spark, sf_dir), frontiers, NOW, assess.Policy(dormant_seconds=18 * DAY, archive_seconds=19 * DAY))


@query
def entity_keys(spark, sf_dir):
    """Keys of the maps that a comment's observations hold, as its first ones have them."""
    o = b.observations(spark, sf_dir)
    extra = F.create_map(F.col("event_type"), F.when(F.col("id") % 3 != 0, F.col("id")), F.concat(F.lit("k"), F.col("reply_count") % 3), F.col("reply_count"))
    folded = derive.entities(o.withColumn("extra", F.when(F.col("id") % 5 != 0, extra)), later=(), maps=("extra",))
    return folded.select("rpid", F.explode("extra").alias("key", "value"))


@query
def media_backfill(spark, sf_dir):
    """Order lines as links to parts; parts of one type hold one blob, some hold none yet."""
    links = b.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("comment_observation_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("media_source_id"))
    blobs = b.read(spark, sf_dir, "part").where("p_size % 7 != 0").select(F.col("p_partkey").alias("id"), F.col("p_type").cast("binary").alias("body"))
    return derive.with_assets(links, blobs.select(F.col("id").alias("media_source_id"), F.sha2("body", 256).alias("blob_sha256")), derive.exact_assets(blobs))


@query
def hot_page_plan(spark, sf_dir):
    """Core and deep pages of each customer's slot."""
    c = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    tier = F.element_at(F.array(*(F.lit(t) for t in assess.TIERS)), (F.col("id") % 4 + 1).cast("int"))
    pages = assess.hot_pages(tier, F.when(F.col("id") % 3 == 0, "checkpoint").otherwise("routine"), {"s": 3, "a": 2, "b": 1, "c": 1}, {"s": 5, "a": 4, "b": 3, "c": 2})
    return c.select("id", pages.alias("p")).select("id", "p.*")


@query
def active_targets(spark, sf_dir):
    """Customers as targets of nations' events, which are open, running, over or to come."""
    n = F.col("n_nationkey")
    time = lambda days: F.lit(NOW) + F.make_dt_interval(days=days.cast("int"))
    events = b.read(spark, sf_dir, "nation").select(n.alias("id"), F.when(n % 6 != 5, "active").otherwise("closed").alias("status"), F.when(n % 4 != 0, time(n % 4 - 2)).alias("start_at"), F.when(n % 3 != 0, time(n % 3 - 1)).alias("end_at"))
    targets = b.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("event_id"), F.when(F.col("c_custkey") % 2 == 0, "uid").otherwise("seed_bvid").alias("target_type"), (F.col("c_custkey") % 5 != 0).alias("active"))
    return assess.active_targets(targets, events, NOW).select("id", "event_id")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def month_window(spark, sf_dir):
    """Orders written by month, and a window of them read again."""
    o = b.read(spark, sf_dir, "orders").select("o_orderkey", b.utc(F.col("o_orderdate").cast("timestamp_ntz")).alias("at"))
    path = shared_folder(spark, "months")
    sinks.write_by_month(o, "at", path)
    return sinks.read_window(spark, path, "at", datetime(1995, 3, 15, tzinfo=UTC), datetime(1995, 6, 15, tzinfo=UTC))


@query
def json_records(spark, sf_dir):
    """Turnover points as exported: JSON lines, written and read again."""
    out = turnover(spark, sf_dir).select("bvid", "current_page_id", "retained", iso_time(F.col("captured_at")).alias("captured_at"), "entered")
    path = shared_folder(spark, "lines")
    sinks.write_json_lines(sinks.contract(out, "hot_turnover-v1", "descriptive_only"), path)
    return spark.read.text(path)


@query
def event_report(spark, sf_dir):
    """One document of an event's bounded sections."""
    return sinks.report(coverage=coverage_by_kind(spark, sf_dir).groupBy("task_kind").agg(F.sum("runs").alias("runs")).coalesce(1).sortWithinPartitions("task_kind"), videos=b.event_videos(spark).select("bvid", "active").coalesce(1))


@query
def stream_pages(spark, sf_dir):
    """Conversations as captured pages that arrive as a stream."""
    path = shared_folder(spark, "pages")
    b.reply_pages(spark, sf_dir).write.parquet(path)
    pages = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return jobs.drained(jobs.flat_pages(pages), shared_folder(spark, "stream")).select("rpid", "bvid", "position", "author_mid")


@query
def stream_visibility(spark, sf_dir):
    obs = b.observations(spark, sf_dir, jobs.stream_of(spark, sf_dir, "events"))
    return jobs.drained(jobs.visibility_events(obs.withColumn("seen", F.col("event_type") != "signup")), shared_folder(spark, "stream"))


@query
def stream_intake(spark, sf_dir):
    """Each observation once, of a stream that brings all twice."""
    obs = b.observations(spark, sf_dir, jobs.stream_of(spark, sf_dir, "events"))
    return jobs.drained(jobs.intake(obs.unionByName(obs), "60 days"), shared_folder(spark, "stream")).select("id", "rpid")


def closed_counts(spark, sf_dir):
    obs = b.observations(spark, sf_dir).select("id", "rpid", "captured_at", "content")
    return jobs.drained(jobs.closed_counts(in_triggers(spark, obs, "captured_at", content=b.KEYWORDS[0]), list(b.KEYWORDS), DAY, "400 days"), shared_folder(spark, "stream"))


@query
def stream_closed_counts(spark, sf_dir):
    """Exact counts of the windows that the watermark has closed."""
    return closed_counts(spark, sf_dir)


@query
def stream_spikes(spark, sf_dir):
    """Jumps of the closed windows, from a stream of their table."""
    counts = closed_counts(spark, sf_dir).withColumn("starts_at", F.timestamp_seconds("bucket"))
    path = shared_folder(spark, "in")
    stream = ordered.in_triggers(counts, path, "starts_at").withColumn("bucket", F.unix_seconds("starts_at"))
    return jobs.drained(ordered.spikes(stream, DAY, 1.1, 3, "400 days"), shared_folder(spark, "stream"))


@query
def stream_tiers(spark, sf_dir):
    """The last effective tier of each video, of a stream of assessments."""
    o = b.observations(spark, sf_dir)
    desired = F.element_at(F.array(*(F.lit(t) for t in assess.TIERS)), (F.col("reply_count") % 4 + 1).cast("int"))
    rows = o.select("bvid", F.col("captured_at").alias("at"), "id", desired.alias("desired"))
    out = jobs.drained(jobs.tiers(in_triggers(spark, rows, "at"), P, "400 days"), shared_folder(spark, "stream"))
    return out.groupBy("bvid").agg(F.max_by("effective", F.struct("at", "id")).alias("effective"), F.count("*").alias("assessments"))


@query
def stream_watchlist(spark, sf_dir):
    """The watch list, kept up batch by batch."""
    obs = b.observations(spark, sf_dir)
    candidates = derive.watch_candidates(obs, derive.WatchPolicy(keywords=("error", "purchase")))
    path = shared_folder(spark, "watch")
    candidates.repartition(2, "rpid").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(jobs.watchlist_upkeep(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return jobs.read_watchlist(spark, f"{path}/out").withColumn("score", F.round("score", 6))


@query
def stream_alerts(spark, sf_dir):
    """Alert states after all batches of drafts."""
    path = shared_folder(spark, "alerts")
    alert_drafts(spark, sf_dir).coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    fold = jobs.alert_upkeep(f"{path}/out", "alert_key string, active boolean, occurrences long, notified_at long", F.lit(6000).cast("long"))
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out/batch={jobs.last_batch(spark, f'{path}/out')}")
