"""Analytics of events (research topics): scopes of videos, keywords, targets, and half-open windows."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import fold_text, least_shared_grams, shared_counts, with_folded
from tidelog.functions.values import quoted, ratio, slug, stable_key
from tidelog.functions.windows import band_join, bucket, check_range, check_window, grid, numbered, within
from tidelog.operators.components import components
from tidelog.operators.similar import similar_pairs
from tidelog.session import checkpointed

CATEGORIES = ("support", "criticism", "neutral")


def resolved(events: DataFrame, reference: int | str) -> DataFrame:
    """The event of an id or a slug (one row of id, slug and more); an error where there is none."""
    by_id = isinstance(reference, int) or reference.strip().isdecimal()
    found = events.where(F.col("id") == int(reference) if by_id else F.col("slug") == slug(F.lit(reference)))
    if found.isEmpty():
        raise LookupError(f"no event {reference}")
    return found


def in_scope(rows: DataFrame, videos: DataFrame, bvid: str | None = None, active: bool = True) -> DataFrame:
    """Rows of an event's videos (active ones only, unless told otherwise), or of one of them."""
    chosen = videos.where("active") if active else videos
    if bvid is not None:
        chosen = chosen.where(F.col("bvid") == bvid)
        if chosen.isEmpty():
            raise ValueError(f"{bvid} is no video of the event")
    return rows.join(chosen.select("bvid").distinct(), "bvid", "left_semi")


def latest_keywords(keywords: DataFrame) -> list[str]:
    """Normalized keywords of an event, active ones; a bounded configuration list."""
    w = Window.partitionBy("normalized_keyword").orderBy(F.desc("version"), F.desc("id"))
    rows = keywords.where("active").withColumn("n", F.row_number().over(w)).where("n = 1").orderBy("normalized_keyword").select("normalized_keyword").collect()
    return [r[0] for r in rows]


def matched(obs: DataFrame, terms: list[str], fold: str = "fold") -> DataFrame:
    """obs with `hits`, the terms in its folded content, in the given order."""
    folded = with_folded(obs, "_folded", F.coalesce("content", F.lit("")), fold)
    listed = F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")
    return folded.withColumn("hits", F.filter(listed, lambda t: F.contains(F.col("_folded"), t))).drop("_folded").where(F.size("hits") > 0)


def literal_filter(rows: DataFrame, column: str, keyword: str | None) -> DataFrame:
    """Rows whose lower-case text holds the keyword (trimmed, one blank between words, folded) literally; all without one."""
    if keyword is None:
        return rows
    wanted = " ".join(keyword.split()).casefold()
    if not wanted:
        raise ValueError("the keyword filter is empty")
    return rows.where(F.contains(F.lower(column), F.lit(wanted)))


def keyword_trends(obs: DataFrame, keywords: list[str], since: datetime, until: datetime, seconds: int, evidence: bool = False) -> DataFrame:
    """Distinct comments and observations of each keyword and bucket, zero-filled; with ids as evidence on request."""
    check_window(since, until)
    check_range("bucket_seconds", seconds, 60, 86_400)
    hits = matched(within(obs, "captured_at", since, until), keywords).select("id", "rpid", "raw_payload_id", bucket(F.col("captured_at"), seconds).alias("bucket"), F.explode("hits").alias("keyword"))
    ids = [F.array_sort(F.collect_set("raw_payload_id")).alias("raw_payload_ids"), F.array_sort(F.collect_set("id")).alias("observation_ids")] if evidence else []
    counts = hits.groupBy("keyword", "bucket").agg(F.count_distinct("rpid").alias("distinct_comments"), F.count("*").alias("observations"), *ids)
    cells = grid(obs, since, until, seconds).withColumn("keyword", F.explode(F.array(*(F.lit(k) for k in keywords)) if keywords else F.array().cast("array<string>")))
    out = cells.join(counts, ["keyword", "bucket"], "left").fillna(0, ["distinct_comments", "observations"])
    for c in ("raw_payload_ids", "observation_ids") if evidence else ():
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<bigint>")))
    return out


def co_occurrence(obs: DataFrame, keywords: list[str]) -> DataFrame:
    """Pairs of keywords in one observation: distinct comments and observations; no pair, no row."""
    hits = matched(obs, sorted(keywords)).where(F.size("hits") > 1)
    pairs = F.flatten(F.transform("hits", lambda a: F.transform(F.filter("hits", lambda b: b > a), lambda b: F.struct(a.alias("keyword_a"), b.alias("keyword_b")))))
    return hits.select("id", "rpid", F.explode(pairs).alias("p")).groupBy("p.keyword_a", "p.keyword_b").agg(F.count_distinct("rpid").alias("distinct_comments"), F.count_distinct("id").alias("observations"))


def stance(obs: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """Distinct comments, observations and counts by term of each category; all categories, terms of one only."""
    owner: dict[str, str] = {}
    for category, terms in lexicon.items():
        for term in terms:
            if owner.setdefault(term, category) != category:
                raise ValueError(f"{term} is in two categories")
    hits = matched(obs, sorted(owner), "phrase").select("id", "rpid", "bvid", F.explode("hits").alias("term"))
    of = F.element_at(F.create_map(*(F.lit(x) for kv in owner.items() for x in kv)), F.col("term"))
    hits = hits.withColumn("category", of)
    counts = hits.groupBy("category").agg(F.count_distinct("bvid", "rpid").alias("distinct_comments"), F.count_distinct("id").alias("observations"))
    by_term = hits.groupBy("category", "term").agg(F.count_distinct("id").alias("n")).groupBy("category").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("terms"))
    all_ = obs.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return all_.join(counts, "category", "left").join(by_term, "category", "left").fillna(0, ["distinct_comments", "observations"])


def similar_candidates(keys: DataFrame, seconds: int, least: float, condition: Column) -> DataFrame:
    """Pairs that can have the ratio `least`, told without their texts: of columns left_ and right_ rpid, bvid, hash and first_seen_at.

    templates() has the same bounds where it compares texts (similar.pairs_of()). keys: rpid, bvid, hash, first_seen_at, size, letters, grams. All bounds hold for every pair of the ratio `least`,
    so none is lost. Lengths differ by at most the factor (2 - least) / least, so texts meet in the bands of time
    that classes of length cut up; then the letters that both have, and the pairs of neighbouring letters, must
    suffice for the ratio.
    """
    factor = math.log((2 - least) / least) * 1.0001
    length = F.floor(F.log("size") / factor).cast("int")
    side = lambda s: keys.select(*(F.col(c).alias(f"{s}_{c}") for c in ("rpid", "bvid", "hash", "size", "letters", "grams")), "first_seen_at", length.alias(f"{s}_length"))
    left = side("left").withColumn("left_length", F.explode(F.array(*(F.col("left_length") + k for k in (-1, 0, 1)))))
    total = F.col("left_size") + F.col("right_size")
    differ = F.col("left_hash") != F.col("right_hash")
    size = 2 * F.least("left_size", "right_size") >= least * total
    pairs = band_join(left, side("right"), "first_seen_at", seconds, condition & differ & size, "length", forward=True)
    enough = 2 * shared_counts(F.col("left_letters"), F.col("right_letters")) >= least * total
    grams = shared_counts(F.col("left_grams"), F.col("right_grams")) >= least_shared_grams(total, least)
    return pairs.where(enough & grams).drop(*(f"{s}_{c}" for s in ("left", "right") for c in ("size", "letters", "grams", "length")))


def templates(entities: DataFrame, seconds: int, least: float, min_chars: int = 4) -> DataFrame:
    """Pairs of comments of two videos, at most `seconds` apart, whose folded texts are similar; left is earlier.

    Equal texts meet by their hash, so at `least` 1 no other pair is formed. Below 1, texts near in time are compared by
    the tasks that hold them (similar_pairs()).
    """
    check_range("window_seconds", seconds, 60, 86_400)
    check_range("min_similarity", least, 0.5, 1.0)
    if least < 1:
        algorithm = F.when(F.col("equal"), "normalized_exact_text_cross_video").otherwise("similar_text_cross_video")
        return similar_pairs(entities, seconds, least, min_chars).withColumn("algorithm", algorithm).drop("equal")
    folded = with_folded(entities.select("rpid", "bvid", "first_seen_at", "first_content"), "folded", F.col("first_content"), "alnum").drop("first_content").where(F.length("folded") >= min_chars)
    keys = checkpointed(folded.withColumn("hash", F.sha2("folded", 256)).drop("folded"))
    side = lambda s: keys.select(*(F.col(c).alias(f"{s}_{c}") for c in ("rpid", "bvid", "hash")), "first_seen_at")
    order = F.struct("left_first_seen_at", "left_rpid") < F.struct("right_first_seen_at", "right_rpid")
    both = order & (F.col("left_bvid") != F.col("right_bvid"))
    apart = F.floor((F.unix_micros("right_first_seen_at") - F.unix_micros("left_first_seen_at")) / 1_000_000)
    pairs = band_join(side("left"), side("right"), "first_seen_at", seconds, both, "hash", forward=True)
    return pairs.select("left_rpid", "right_rpid", "left_bvid", "right_bvid", F.lit(1.0).alias("similarity"), apart.alias("seconds_apart"), F.lit("normalized_exact_text_cross_video").alias("algorithm"))


def with_members(candidates: DataFrame, entities: DataFrame, event_id: int, slug_: str, seconds: int, least: float) -> DataFrame:
    """Candidates with the fields that a reader sees: both comments (author, name, content, time, payload), the event, and how they were found.

    entities: rpid, author_mid, author_name, first_content, first_seen_at, first_raw_payload_id.
    """
    fields = {"author_mid": "author_mid", "author_name": "author_name", "content": "first_content", "first_seen_at": "first_seen_at", "raw_payload_id": "first_raw_payload_id"}
    side = lambda s: entities.select(F.col("rpid").alias(f"{s}_rpid"), *(F.col(c).alias(f"{s}_{name}") for name, c in fields.items()))
    out = candidates.join(side("left"), "left_rpid").join(side("right"), "right_rpid")
    return out.withColumns({"event_id": F.lit(event_id).cast("long"), "event_slug": F.lit(slug_), "window_seconds": F.lit(seconds).cast("long"), "min_similarity": F.lit(float(least)), "candidate_only": F.lit(True)})


def template_links(entities: DataFrame, seconds: int, min_chars: int = 4) -> DataFrame:
    """left_rpid and right_rpid: at most two links a comment, which connect what the pairs of templates() at similarity 1 connect.

    Of the comments of one folded text in the order of time, each is linked to the last one before it and
    the first one after it on another video, where they are in the window; a group of copies so costs no
    more than its own size. Two comments of a pair are connected by these: what stands between them on
    other videos is nearer to both.
    """
    check_range("window_seconds", seconds, 60, 86_400)
    folded = with_folded(entities.where("bvid is not null and first_seen_at is not null"), "folded", F.col("first_content"), "alnum")
    keyed = folded.where(F.length("folded") >= min_chars).select("rpid", "bvid", "first_seen_at", F.sha2("folded", 256).alias("hash"))
    before = Window.partitionBy("hash").orderBy("first_seen_at", "rpid")
    after = Window.partitionBy("hash").orderBy(F.desc("first_seen_at"), F.desc("rpid"))
    # at the first comment of a run on one video the neighbour is on another; the others of the run have the same one
    marked = keyed
    for name, w in (("before", before), ("after", after)):
        step = F.when(F.lag("bvid").over(w) != F.col("bvid"), F.lag(F.struct("rpid", "first_seen_at")).over(w))
        marked = marked.withColumn("_step", step).withColumn(name, F.last("_step", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    ends = marked.select("rpid", "first_seen_at", F.explode(F.array("before", "after")).alias("o")).where("o is not null")
    apart = F.floor(F.abs(F.unix_micros("o.first_seen_at") - F.unix_micros("first_seen_at")) / 1_000_000)
    return ends.where(apart <= seconds).select(F.least("rpid", "o.rpid").alias("left_rpid"), F.greatest("rpid", "o.rpid").alias("right_rpid")).distinct()


def duplicate_display(on_page: DataFrame) -> DataFrame:
    """Comments shown more than once on one page."""
    return on_page.groupBy("page_id", "rpid").agg(F.count("*").alias("shown"), F.array_sort(F.collect_list("comment_observation_id")).alias("observation_ids")).where("shown > 1")


def same_author_texts(entities: DataFrame) -> DataFrame:
    """Pairs of comments of one author with equal folded texts; the smaller id is the subject."""
    f = with_folded(entities.where("author_mid is not null"), "folded", F.col("first_content"), "alnum").where("folded != ''").select("author_mid", F.sha2("folded", 256).alias("h"), "rpid")
    a, b = f.withColumnRenamed("rpid", "subject_rpid"), f.withColumnRenamed("rpid", "related_rpid")
    return a.join(b, ["author_mid", "h"]).where("subject_rpid < related_rpid").drop("h")


def same_author_counts(entities: DataFrame) -> DataFrame:
    """rpid, origins and amplified: in how many pairs of same_author_texts() a comment is the subject and the related one.

    Counted by its place among the equal texts of its author, so that no pair is made.
    """
    f = with_folded(entities.where("author_mid is not null"), "folded", F.col("first_content"), "alnum").where("folded != ''").select("author_mid", F.sha2("folded", 256).alias("h"), "rpid")
    n = f.groupBy("author_mid", "h").agg(F.count("*").alias("n")).where("n > 1")
    place = F.row_number().over(Window.partitionBy("author_mid", "h").orderBy("rpid"))
    return f.join(n, ["author_mid", "h"]).select("rpid", (F.col("n") - place).alias("origins"), (place - 1).cast("long").alias("amplified"))


def flag_counts(flags: DataFrame) -> DataFrame:
    """The same of flags (subject_rpid, related_rpid)."""
    ends = flags.select(F.explode(F.array(F.struct(F.col("subject_rpid").alias("rpid"), F.lit(1).alias("origins")), F.struct(F.col("related_rpid").alias("rpid"), F.lit(0).alias("origins")))).alias("e")).select("e.*")
    return ends.where("rpid is not null").groupBy("rpid").agg(F.sum("origins").alias("origins"), F.sum(1 - F.col("origins")).alias("amplified"))


def template_flags(candidates: DataFrame, seconds: int, least: float, min_chars: int = 4) -> DataFrame:
    """Drafts of template_like_comment from candidates: the earlier comment is the subject, the similarity the confidence.

    algorithm_version says how they were found, so another setting's flags have other keys.
    """
    version = f"sequence_matcher-v1:min={least:.6f}:window={seconds}:minchars={min_chars}"
    return candidates.select(F.lit("template_like_comment").alias("flag_type"), F.col("left_rpid").alias("subject_rpid"), F.col("right_rpid").alias("related_rpid"), F.col("similarity").alias("confidence"), F.lit("sequence_matcher").alias("algorithm"), F.lit(version).alias("algorithm_version"))


def refreshed(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """matched and created flags of a refresh by kind: drafts with their keys, against the keys that are there."""
    keys = existing.select("stable_key", F.lit(True).alias("there")).distinct()
    return drafts.join(keys, "stable_key", "left").groupBy("flag_type").agg(F.count("*").alias("matched"), F.count_if(F.col("there").isNull()).alias("created"))


def keyed_flags(drafts: DataFrame, version: str = "1") -> DataFrame:
    """Drafts (event_id, flag_type, subject_rpid, related_rpid, evidence_scope) with their stable keys, one for each key."""
    text = lambda c: F.col(c).cast("string")
    own = quoted(F.col("algorithm_version")) if "algorithm_version" in drafts.columns else F.lit(f'"{version}"')
    key = stable_key(algorithm_version=own, event_id=text("event_id"), evidence_scope=quoted(F.col("evidence_scope")), flag_type=quoted(F.col("flag_type")), related_rpid=text("related_rpid"), subject_rpid=text("subject_rpid"))
    return drafts.withColumn("stable_key", key).dropDuplicates(["stable_key"])


def new_flags(drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """Keyed drafts whose key is not there yet."""
    return keyed_flags(drafts).join(existing.select("stable_key"), "stable_key", "left_anti")


def with_role(targets: DataFrame, role: str, name: str) -> DataFrame:
    """Ids (as `name`) of an event's active uid targets in a role, with their target ids; a configuration list."""
    same = fold_text(F.get_json_object("extra", "$.role"), "fold") == role
    found = targets.where(F.col("active") & (F.col("target_type") == "uid") & same)
    return found.groupBy(F.col("normalized_value").try_cast("long").alias(name)).agg(F.array_sort(F.collect_set("id")).alias("target_ids"))


def propagation_nodes(entities: DataFrame, counts: DataFrame, targets: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Role scores of authors of comments first seen in the window, relative to their maxima.

    counts: rpid, origins and amplified, of template flags of the event (flag_counts()). author_name is the
    first that is known. The comments, payloads and flags behind a score are rows of propagation_evidence().
    """
    own = within(entities, "first_seen_at", since, until).where("author_mid is not null")
    order = F.struct("first_seen_at", "rpid")
    name = F.min_by(F.when(F.col("author_name").isNotNull(), F.col("author_name")), F.when(F.col("author_name").isNotNull(), order))
    base = own.join(counts, "rpid", "left").groupBy("author_mid").agg(
        name.alias("author_name"), F.count("*").alias("comments"), F.count_distinct("bvid").alias("videos"), F.count_if((F.col("root_rpid") != 0) & F.col("root_rpid").isNotNull()).alias("replies"),
        F.coalesce(F.sum("origins"), F.lit(0)).alias("origins"), F.coalesce(F.sum("amplified"), F.lit(0)).alias("amplified"),
    )
    official = with_role(targets, "official", "author_mid").select("author_mid", F.lit(1.0).alias("official"), F.col("target_ids").alias("official_target_ids"))
    p = base.join(F.broadcast(official), "author_mid", "left").fillna(0, ["official"]).withColumn("official_target_ids", F.coalesce("official_target_ids", F.array().cast("array<bigint>")))
    top = p.agg(*(F.max(c).alias(f"max_{c}") for c in ("videos", "replies", "origins", "amplified")))
    p = p.crossJoin(F.broadcast(top))  # one row
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"max_{c}")), F.lit(0.0))
    scores = {"originator": share("origins"), "amplifier": share("amplified"), "bridge": F.when(F.col("max_videos") > 1, (F.col("videos") - 1) / (F.col("max_videos") - 1)).otherwise(0.0), "responder": share("replies"), "official": F.col("official").cast("double")}
    return p.select("author_mid", "author_name", "comments", "videos", "replies", "origins", "amplified", "official_target_ids", *(F.round(v, 6).alias(k) for k, v in scores.items()), F.round(F.greatest(*scores.values()), 6).alias("overall"))


def propagation_evidence(entities: DataFrame, flags: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """author_mid, kind (comment, raw_payload, template_flag) and id: a row for each that a node's scores rest on.

    flags: id, subject_rpid and related_rpid.
    """
    own = within(entities, "first_seen_at", since, until).where("author_mid is not null")
    who = own.select("rpid", "author_mid")
    part = lambda df, kind, c: df.where(F.col(c).isNotNull()).select("author_mid", F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id"))
    out = part(own, "comment", "rpid").unionByName(part(own, "raw_payload", "first_raw_payload_id"))
    for end in ("subject_rpid", "related_rpid"):
        out = out.unionByName(part(flags.join(who.withColumnRenamed("rpid", end), end), "template_flag", "id"))
    return out.distinct()


def is_spike(was: Column, now: Column, multiplier: float, least: int) -> Column:
    return was.isNotNull() & (now >= least) & (now >= F.greatest(F.lit(float(least)), was * multiplier))


def signals(rows: DataFrame, kind: str, scope_type: str, bucket: Column, scope: Column, magnitude: Column, previous: Column | None = None, current: Column | None = None) -> DataFrame:
    """Rows as signals: signal_type, bucket (epoch seconds), scope_type, scope, magnitude, previous_count and current_count."""
    count = lambda c: (F.lit(None) if c is None else c).cast("long")
    return rows.select(F.lit(kind).alias("signal_type"), bucket.alias("bucket"), F.lit(scope_type).alias("scope_type"), scope.alias("scope"), magnitude.alias("magnitude"), count(previous).alias("previous_count"), count(current).alias("current_count"))


def comment_spikes(entities: DataFrame, since: datetime, until: datetime, seconds: int, multiplier: float, least: int) -> DataFrame:
    """Buckets whose first-seen comments jump against the bucket before."""
    counts = within(entities, "first_seen_at", since, until).groupBy(bucket(F.col("first_seen_at"), seconds).alias("bucket")).agg(F.count("*").alias("n"))
    series = grid(entities, since, until, seconds).join(counts, "bucket", "left").fillna(0, ["n"])
    w = Window.orderBy("bucket")  # the grid has MOST_BUCKETS at most
    p = series.withColumn("was", F.lag("n").over(w))
    return signals(p.where(is_spike(F.col("was"), F.col("n"), multiplier, least)), "comment_spike", "event", F.col("bucket"), F.lit("event"), ratio(F.col("n"), F.greatest("was", F.lit(1))), F.col("was"), F.col("n"))


def keyword_spikes(obs: DataFrame, keywords: list[str], since: datetime, until: datetime, seconds: int, multiplier: float, least: int) -> DataFrame:
    """The same for the distinct comments of each keyword."""
    p = keyword_trends(obs, keywords, since, until, seconds).withColumn("was", F.lag("distinct_comments").over(Window.partitionBy("keyword").orderBy("bucket")))
    n = F.col("distinct_comments")
    return signals(p.where(is_spike(F.col("was"), n, multiplier, least)), "keyword_spike", "keyword", F.col("bucket"), F.col("keyword"), ratio(n, F.greatest("was", F.lit(1))), F.col("was"), n)


def spike_evidence(spikes: DataFrame, hits: DataFrame) -> DataFrame:
    """signal_type, scope, bucket, kind (comment, observation, raw_payload) and id: a row for each that is in a spike's bucket.

    hits: scope, bucket and rpid, observation_id, raw_payload_id (null where a signal has none).
    """
    met = spikes.select("signal_type", "scope", "bucket").join(hits, ["scope", "bucket"])
    kinds = {"comment": "rpid", "observation": "observation_id", "raw_payload": "raw_payload_id"}
    ids = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id")) for kind, c in kinds.items()))
    return met.select("signal_type", "scope", "bucket", F.explode(ids).alias("e")).select("signal_type", "scope", "bucket", "e.*").where("id is not null").distinct()


def turnover_signals(turnover: DataFrame, threshold: float) -> DataFrame:
    return signals(turnover.where(F.col("turnover_rate") >= threshold), "hot_turnover", "video", F.unix_seconds("captured_at"), F.col("bvid"), F.round("turnover_rate", 6))


def creator_signals(infos: DataFrame, targets: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """First snapshot of each video by an owner in the role, where it is in the window."""
    owners = with_role(targets, "major_creator", "owner_mid").select("owner_mid")
    first = infos.join(F.broadcast(owners), "owner_mid", "left_semi").where(F.col("captured_at") < F.lit(until)).groupBy("bvid").agg(F.min("captured_at").alias("at"))
    return signals(first.where(F.col("at") >= F.lit(since)), "major_creator_involvement", "video", F.unix_seconds("at"), F.col("bvid"), F.lit(1.0))


def turnover_evidence(turnover: DataFrame, threshold: float) -> DataFrame:
    """signal_type, scope, bucket, kind (previous_page, current_page, entered, exited) and id as text: what each signal of turnover rests on."""
    one = lambda kind, c: F.array(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id")))
    many = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("id")))
    ids = F.concat(one("previous_page", "previous_page_id"), one("current_page", "current_page_id"), many("entered", "entered"), many("exited", "exited"))
    met = turnover.where(F.col("turnover_rate") >= threshold)
    return met.select(F.lit("hot_turnover").alias("signal_type"), F.col("bvid").alias("scope"), F.unix_seconds("captured_at").alias("bucket"), F.explode(ids).alias("e")).select("signal_type", "scope", "bucket", "e.*")


def creator_evidence(infos: DataFrame, targets: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """The snapshot and the target that each signal of a major creator rests on.

    Of a video's snapshots before until by an owner in the role the first counts (of equal times the least payload id),
    where it is not before since.
    """
    owners = with_role(targets, "major_creator", "owner_mid").select("owner_mid", F.explode("target_ids").alias("event_target_id"))
    snapshot = F.struct("captured_at", "raw_payload_id", "title", "owner_mid", "owner_name")
    first = infos.where(F.col("captured_at") < F.lit(until)).join(owners.select("owner_mid").distinct(), "owner_mid", "left_semi").groupBy("bvid").agg(F.min(snapshot).alias("s"))
    met = first.select("bvid", "s.*").where(F.col("captured_at") >= F.lit(since)).join(owners, "owner_mid")
    return met.select(F.lit("major_creator_involvement").alias("signal_type"), F.col("bvid").alias("scope"), F.unix_seconds("captured_at").alias("bucket"), "title", "owner_mid", "owner_name", "event_target_id", F.lit("major_creator").alias("event_target_role"), "raw_payload_id")


def reply_edges(entities: DataFrame) -> DataFrame:
    """root_rpid to reply, where the root exists."""
    roots = entities.select(F.col("rpid").alias("root_rpid"), F.col("first_seen_at").alias("root_seen_at"))
    return entities.where("root_rpid is not null").join(roots, "root_rpid").select("root_rpid", "rpid", "bvid", "first_seen_at")


def propagation_replay(videos: DataFrame, entities: DataFrame, flags: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """video_associated, comment_reply and template_propagation in time, over all videos of the event."""
    seen = within(entities, "first_seen_at", since, until)
    one = within(videos, "first_seen_at", since, until).select(F.lit("video_associated").alias("kind"), F.col("first_seen_at").alias("at"), "bvid", F.lit(None).cast("long").alias("from_rpid"), F.lit(None).cast("long").alias("to_rpid"))
    roots = entities.select(F.col("rpid").alias("root_rpid"))
    two = seen.where("root_rpid is not null").join(roots, "root_rpid").select(F.lit("comment_reply").alias("kind"), F.col("first_seen_at").alias("at"), "bvid", F.col("root_rpid").alias("from_rpid"), F.col("rpid").alias("to_rpid"))
    subject = entities.select(F.col("rpid").alias("subject_rpid"))
    three = flags.join(subject, "subject_rpid").join(seen.withColumnRenamed("rpid", "related_rpid"), "related_rpid").select(F.lit("template_propagation").alias("kind"), F.col("first_seen_at").alias("at"), "bvid", F.col("subject_rpid").alias("from_rpid"), F.col("related_rpid").alias("to_rpid"))
    return one.unionByName(two).unionByName(three)


#: Record types of a timeline, and the tables that their keys name.
TIMELINE = {"event_video_associated": "event_videos", "video_metric_snapshot": "video_metric_snapshots", "comment_state_event": "comment_state_events", "comment_visibility_event": "comment_visibility_events"}


def timeline(since: datetime | None = None, until: datetime | None = None, bvid: str | None = None, **sources: tuple) -> DataFrame:
    """Records of an event's sources (by record type: rows with bvid, time, key): record_type, at, source_key and bvid.

    Where sources give a list of columns too, data holds them as JSON, nulls included, and source_table tells where they are from.
    The window is half-open, and either end may be open; rows of other videos than bvid are left out.
    """
    out = None
    for kind, (df, time, key, *data) in sources.items():
        more = [c for fields in data for c in (F.lit(TIMELINE[kind]).alias("source_table"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("data"))]
        part = df.select(F.lit(kind).alias("record_type"), time.alias("at"), F.concat(F.lit(f"{TIMELINE[kind]}:"), key.cast("string")).alias("source_key"), "bvid", *more)
        out = part if out is None else out.unionByName(part)
    out = within(out, "at", since, until)
    return out if bvid is None else out.where(F.col("bvid") == bvid)


def coverage_summary(rows: DataFrame, videos: DataFrame, since=None, until=None, targets: list | None = None) -> DataFrame:
    """One row: coverage of the active videos (or those of them in targets), of what finished from since to before until.

    Ratios are null where nothing was asked for.
    """
    if since is not None and until is not None and until <= since:
        raise ValueError("until must be after since")
    active = videos.where("active").select("target_id").distinct()
    if targets is not None:
        active = active.where(F.col("target_id").isin(*targets))
    n = active.agg(F.count("*").alias("active_videos"))
    c = within(rows, "finished_at", since, until).join(active, "target_id", "left_semi")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    s = c.agg(
        F.count_distinct("target_id").alias("covered_videos"), F.count("*").alias("coverage_rows"), *(F.count_if(F.col("status") == k).alias(k) for k in ("succeeded", "partial", "failed")),
        total("pages_requested").alias("pages_requested"), total("pages_succeeded").alias("pages_succeeded"), total("request_errors").alias("request_errors"), F.count_if("truncated").alias("truncated"),
        total("items_observed").alias("items_observed"), total("raw_payloads_saved").alias("raw_payloads_saved"), total("parse_errors").alias("parse_errors"), F.count_if("corrupted").alias("corrupted"),
        F.datediff(F.min("started_at"), F.lit("1970-01-01").cast("date")).alias("first_day"), F.datediff(F.max("finished_at"), F.lit("1970-01-01").cast("date")).alias("last_day"),
    )
    return n.crossJoin(s).withColumn("video_ratio", ratio(F.col("covered_videos"), F.col("active_videos"))).withColumn("page_ratio", ratio(F.col("pages_succeeded"), F.col("pages_requested")))  # one row each


def core_videos(videos: DataFrame, infos: DataFrame, metrics: DataFrame, until: datetime) -> DataFrame:
    """Each video with its association and its last snapshots of either kind before a time.

    Those with metrics come first, then with a title, then by confidence, first seen and id.
    """
    order = F.struct("captured_at", "raw_payload_id")
    last = lambda df, *names: df.where(F.col("captured_at") < F.lit(until)).groupBy("bvid").agg(F.max_by(F.struct(*names), order).alias("r"))
    info = last(infos, "title", "owner_mid", "owner_name", F.col("raw_payload_id").alias("info_raw_payload_id")).select("bvid", "r.*")
    metric = last(metrics, "captured_at", "view_count", "like_count", "coin_count", "raw_payload_id").select("bvid", "r.*")
    both = videos.join(info, "bvid", "left").join(metric, "bvid", "left")
    both = both.select("bvid", "active", "association_reason", "confidence", "first_seen_at", "title", "owner_mid", "owner_name", "info_raw_payload_id", "captured_at", "view_count", "like_count", "coin_count", "raw_payload_id")
    return both.orderBy(F.col("captured_at").isNull(), F.col("title").isNull(), F.desc("confidence"), "first_seen_at", "bvid")


def template_clusters(pairs: DataFrame) -> DataFrame:
    """Members of each group of linked comments; the group is named by its least member."""
    return components(checkpointed(pairs.select("left_rpid", "right_rpid")), "left_rpid", "right_rpid").withColumnsRenamed({"node": "rpid", "component": "cluster"})


def numbered_clusters(links: DataFrame, entities: DataFrame) -> DataFrame:
    """cluster_id and rpid of each group of linked comments; groups are numbered by their first candidate.

    links: all candidates, or template_links(), which connect the same and hold each group's first candidate.
    entities: rpid, first_seen_at. Candidates are ordered by the earlier comment's time and id, then the later one's.
    """
    pairs = checkpointed(links.select("left_rpid", "right_rpid"))
    parts = checkpointed(template_clusters(pairs))
    time = lambda s: entities.select(F.col("rpid").alias(f"{s}_rpid"), F.struct("first_seen_at", "rpid").alias(s))
    timed = pairs.join(time("left"), "left_rpid").join(time("right"), "right_rpid").join(parts.withColumnRenamed("rpid", "left_rpid"), "left_rpid")
    first = timed.groupBy("cluster").agg(F.min(F.struct(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b"))).alias("f")).select("cluster", "f.a", "f.b")
    return parts.join(numbered(first, "cluster_id", "a", "b").select("cluster", "cluster_id"), "cluster").select("cluster_id", "rpid")


def cluster_edges(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_id and each candidate of it. clusters: of numbered_clusters()."""
    return candidates.join(clusters.withColumnRenamed("rpid", "left_rpid"), "left_rpid")


def cluster_members(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """cluster_id and each member with what a reader sees of it; its raw_payload_id is evidence of the cluster.

    entities: rpid, bvid, author_mid, author_name, first_content, first_seen_at, first_raw_payload_id.
    """
    return clusters.join(entities.select("rpid", "bvid", "author_mid", "author_name", F.coalesce("first_content", F.lit("")).alias("content"), "first_seen_at", F.col("first_raw_payload_id").alias("raw_payload_id")), "rpid")


def cluster_summaries(members: DataFrame) -> DataFrame:
    """cluster_id, members, videos, authors, distinct raw payloads, first and last sight of each cluster, and what it may be taken for."""
    out = members.groupBy("cluster_id").agg(F.count("*").alias("members"), F.count_distinct("bvid").alias("videos"), F.count_distinct("author_mid").alias("authors"), F.count_distinct("raw_payload_id").alias("raw_payloads"), F.min("first_seen_at").alias("first_seen_at"), F.max("first_seen_at").alias("last_seen_at"))
    return out.withColumns({"candidate_only": F.lit(True), "interpretation_limit": F.lit("candidate_only_not_proof_of_coordination")})


#: What holds of every report.
GENERAL_LIMITS = ("only_successfully_collected_data_in_the_window", "coverage_by_finish_time", "absence_is_no_deletion_and_candidates_no_proof", "check_against_raw_evidence")


def limitations(coverage: DataFrame) -> DataFrame:
    """limitation: what a reader of a report has to keep in mind, from its one row of coverage_summary()."""
    c = F.col
    own = [
        F.when(c("active_videos") == 0, "no_active_videos").when(F.coalesce(c("video_ratio"), F.lit(0.0)) != 1, "videos_without_coverage"),
        F.when((c("partial") > 0) | (c("failed") > 0), "partial_or_failed_runs"),
        F.when((c("truncated") > 0) | (c("corrupted") > 0), "truncated_or_corrupted_runs"),
    ]
    return coverage.select(F.explode(F.array_compact(F.array(*(F.lit(t) for t in GENERAL_LIMITS), *own))).alias("limitation"))


def evidence_index(**ids: DataFrame) -> DataFrame:
    """Distinct (kind, id) of one-column frames of ids; prefixes previous_, current_ and info_ are dropped."""
    out = None
    for name, df in ids.items():
        kind = name.split("__")[0]
        for p in ("previous_", "current_", "info_"):
            kind = kind.removeprefix(p)
        part = df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).cast("long").alias("id")).where("id is not null")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def hot_change_payloads(turnover: DataFrame, payloads: DataFrame) -> DataFrame:
    """current_page_id, side (previous, current) and raw_payload_id: a row for each payload that a point's pages came from.

    payloads: page_id and raw_payload_id. Pages without payloads give no row.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_page_id").alias("page_id")) for s in ("previous", "current"))))
    return turnover.select("current_page_id", sides.alias("s")).select("current_page_id", "s.*").join(payloads.distinct(), "page_id").select("current_page_id", "side", "raw_payload_id")


def hot_changes(turnover: DataFrame, on_page: DataFrame) -> DataFrame:
    """Turnover points with the observation ids of both of their pages."""
    ids = on_page.groupBy("page_id").agg(F.array_sort(F.collect_set("comment_observation_id")).alias("ids"))
    side = lambda s: ids.select(F.col("page_id").alias(f"{s}_page_id"), F.col("ids").alias(f"{s}_observation_ids"))
    return turnover.join(side("previous"), "previous_page_id", "left").join(side("current"), "current_page_id", "left")
