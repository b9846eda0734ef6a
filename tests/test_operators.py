"""Literal cases and properties of operators."""

import difflib
import itertools
import json
import random
from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.catalog import QUERIES
from tidelog.functions import values, windows
from tidelog.functions.text import fold_text, seq_ratio
from tidelog.operators import assess, cohorts, derive, event, flatten, graph, quality, video
from tidelog.operators.components import components
from tidelog.sources import bindings, sinks
from tidelog.streaming import jobs, ordered

T0 = datetime(2026, 7, 10, 10, tzinfo=UTC)


def minutes(n):
    return T0 + timedelta(minutes=n)


def observed(spark, rows):
    return spark.createDataFrame([(i, v, r, r, minutes(m), t, i) for i, v, r, m, t in rows], "id long, bvid string, rpid long, author_mid long, captured_at timestamp, content string, raw_payload_id long")


def test_trend_zero_fills_and_counts_distinct(spark):
    obs = observed(spark, [(1, "A", 1001, 0, "质疑控评"), (2, "A", 1001, 10, "仍在质疑控评"), (3, "A", 1002, 0, "普通评论"), (4, "B", 1003, 0, "控评了吗"), (5, "C", 1004, 0, "失活视频也提到控评")])
    videos = spark.createDataFrame([("A", True), ("B", True), ("C", False)], "bvid string, active boolean")
    out = event.keyword_trends(event.in_scope(obs, videos), ["控评"], T0, minutes(120), 3600).orderBy("bucket").collect()
    assert [(r.distinct_comments, r.observations) for r in out] == [(2, 3), (0, 0)]
    one = event.keyword_trends(event.in_scope(obs, videos, "A"), ["控评"], T0, minutes(120), 3600).orderBy("bucket").first()
    assert (one.distinct_comments, one.observations) == (1, 2)
    with pytest.raises(ValueError):
        event.in_scope(obs, videos, "C")


def test_stance_returns_every_category(spark):
    obs = observed(spark, [(1, "A", 1001, 0, "赞同, 但也质疑"), (2, "A", 1001, 5, "仍然赞同, 继续求证"), (3, "A", 1002, 0, "先观望")])
    out = {r.category: (r.distinct_comments, r.observations) for r in event.stance(obs, {"support": ["赞同"], "criticism": ["质疑"], "neutral": ["求证", "观望"]}).collect()}
    assert out == {"support": (1, 2), "criticism": (1, 1), "neutral": (2, 2)}
    empty = event.stance(obs.limit(0), {"support": ["赞同"]}).collect()
    assert len(empty) == 3 and not any(r.observations for r in empty)
    with pytest.raises(ValueError):
        event.stance(obs, {"support": ["x"], "neutral": ["x"]})


def test_turnover_keeps_empty_snapshots(spark):
    lists = [[101, 102, 103], [102, 103, 104], [103, 104, 105], [], [106]]
    pages = spark.createDataFrame([(n, "A", minutes(10 * n)) for n in range(5)], "page_id long, bvid string, captured_at timestamp")
    on_page = spark.createDataFrame([(n, p + 1, r) for n, rs in enumerate(lists) for p, r in enumerate(rs)], "page_id long, position int, rpid long")
    out = video.hot_turnover(pages, on_page, 3).orderBy("captured_at").collect()
    assert (out[0].retained, out[0].entered, out[0].exited) == (2, [104], [101]) and abs(out[0].turnover_rate - 1 / 3) < 1e-9
    assert [r.turnover_rate for r in out[2:]] == [1.0, 1.0]


def test_view_growth(spark):
    rows = [(-70, 100), (-30, 600), (-5, 1100)]
    df = lambda rs: spark.createDataFrame([("A", minutes(m), v) for m, v in rs], "bvid string, captured_at timestamp, view_count long")
    grown = lambda rs: video.view_growth(df(rs), minutes(-60), T0).first().view_growth
    assert (grown(rows), grown(rows[1:]), grown([(-70, 9), (-5, 4)]), grown(rows[2:])) == (1000, 500, 0, None)


def test_templates_match_a_plain_loop(spark):
    random.seed(3)
    base = ["server is down for maintenance now", "nothing to see here move along please", "the same words again and again"]
    rows = []
    for n in range(60):
        t = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            t[random.randrange(len(t))] = random.choice("abcxyz ")
        rows.append((n, random.choice("ABC"), minutes(random.randint(0, 200)), "".join(t)))
    df = spark.createDataFrame(rows, "rpid long, bvid string, first_seen_at timestamp, first_content string")
    got = {(r.left_rpid, r.right_rpid): r.similarity for r in event.templates(df, 3600, 0.85).collect()}
    fold = lambda t: "".join(c for c in t.casefold() if c.isalnum())
    want = {}
    for a in rows:
        for b in rows:
            if (a[2], a[0]) < (b[2], b[0]) and a[1] != b[1] and (b[2] - a[2]).total_seconds() <= 3600:
                r = difflib.SequenceMatcher(None, fold(a[3]), fold(b[3]), autojunk=False).ratio()
                if r >= 0.85:
                    want[a[0], b[0]] = round(r, 6)
    assert got == want and want


def test_templates_of_long_texts(spark, tmp_path):
    """Whole queries on documents of more than 500 characters, and of unknown length, against a plain loop."""
    random.seed(7)
    words = [["".join(random.choice("etaoinshrdlucmfwyp") for _ in range(random.randint(2, 8))) for _ in range(n)] for n in (150, 150, 300)]
    rows = []
    for n in range(16):
        t = list(random.choice(words))
        for _ in range(random.choice((0, 0, 6, 40))):
            t[random.randrange(len(t))] = "other"
        rows.append((n, random.choice("ABC"), " ".join(t), None if n % 4 == 0 else len(" ".join(t))))
    spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for (i, s, a, _), (j, r, b, _) in itertools.combinations(rows, 2):
        x, y = (t.replace(" ", "") for t in (a, b))
        ratio = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if s != r else 0
        if ratio >= 0.85:
            want[i, j] = round(ratio, 6)
    equal = {k for k, v in want.items() if v == 1}
    assert 0 < len(equal) < len(want)
    got = QUERIES["template_candidates_fuzzy"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.left_rpid, r.right_rpid): r.similarity for r in got} == want
    assert {(r.left_rpid, r.right_rpid) for r in QUERIES["template_candidates"](spark, str(tmp_path)).collect()} == equal
    assert {r.rpid for r in QUERIES["template_clusters"](spark, str(tmp_path)).collect()} == {x for k in equal for x in k}


def test_template_links_connect_what_pairs_connect(spark):
    random.seed(17)
    rows = [(n, random.choice("AABC") if n % 30 else None, T0 + timedelta(seconds=random.randint(0, 900)), random.choice(["same text", "Same-Text!", "other words", "ab"]), n) for n in range(150)]
    own = spark.createDataFrame(rows, "rpid long, bvid string, first_seen_at timestamp, first_content string, x int").repartition(3)
    for seconds in (60, 300):
        links = event.template_links(own, seconds)
        pairs = event.templates(own, seconds, 1.0)
        assert links.count() <= 2 * len(rows)
        groups = [{(r.rpid, r.cluster) for r in event.template_clusters(x).collect()} for x in (links, pairs)]
        assert groups[0] == groups[1] and groups[0]


def test_signature_edges_lose_nothing(spark):
    random.seed(4)
    sig = []
    for n in range(300):
        x = random.getrandbits(64) if n % 3 == 0 else sig[-1][1]
        for _ in range(random.randint(0, 4)):
            x ^= 1 << random.randrange(64)
        sig.append((n, x))
    signed = [(n, x - (1 << 64) if x >> 63 else x) for n, x in sig]
    got = {(r.a, r.b, r.distance) for r in graph.signature_edges(spark.createDataFrame(signed, "id long, signature long")).collect()}
    want = {(a, b, (x ^ y).bit_count()) for a, x in sig for b, y in sig if a < b and (x ^ y).bit_count() <= 5}
    assert got == want and want
    small = graph.signature_clusters(spark.createDataFrame([(1, 0), (2, 5), (3, 4095), (4, 7), (5, -1), (6, -1)], "id long, signature long")).collect()
    assert {(r.cluster, r.member, r.distance, r.confidence) for r in small} == {(1, 1, None, 1.0), (1, 2, 2, 1 - 2 / 64), (1, 4, 3, 1 - 3 / 64), (5, 5, None, 1.0), (5, 6, 0, 1.0)}


def test_components_equal_union_find(spark):
    random.seed(1)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(260)] + [(1000 + n, 1001 + n) for n in range(50)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges + edges[:40], "a long, b long").repartition(3).cache()
    for per_part in (100_000, 40, 7):  # one task, and stars over some and many
        got = components(table, per_part=per_part).collect()
        assert len(got) == len(root) and {r.node: r.component for r in got} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_media_order_and_removal(spark):
    links = spark.createDataFrame([(1, 0, 1, 9), (1, 1, 2, 9), (2, 0, 1, 9), (3, 0, 1, 8), (3, 1, 2, 8), (4, 0, 2, 8), (4, 1, 1, 8)], "comment_observation_id long, position int, media_source_id long, rpid long")
    ids = links.select(F.col("comment_observation_id").alias("id"), "rpid")
    got = {(r.rpid, r.event_type) for r in derive.media_changes(links, ids).collect()}
    assert got == {(9, "media_changed"), (9, "media_removed"), (8, "media_order_changed")}


def test_watchlist_takes_the_highest_signal(spark):
    rows = [(1, "A", 5, T0, "x", 10, 1, "latest", 9), (2, "A", 5, minutes(5), "Error and purchase", 50, 9, "hot", 2)]
    obs = spark.createDataFrame(rows, "id long, bvid string, rpid long, captured_at timestamp, content string, like_count long, reply_count long, sort_mode string, position int").withColumn("root_rpid", F.lit(0))
    assert derive.watch_candidates(obs.withColumn("root_rpid", F.lit(4)), derive.WatchPolicy()).count() == 0  # replies are not watched
    out = derive.watchlist(derive.watch_candidates(obs, derive.WatchPolicy(keywords=("error", "purchase")))).collect()
    assert [(r.reason, r.priority, r.score, r.hot_position) for r in out] == [("hot_top", 98, 98 + 8 + 8 + 20, 2)]
    assert derive.watch_candidates(obs.where("id = 1"), derive.WatchPolicy()).count() == 0


def test_pages_that_fail_keep_their_error(spark):
    bodies = [{"code": 0, "data": {"replies": [{"rpid": 1, "content": {"message": " a ", "pictures": [{"img_src": "u1"}, "u2"]}, "root": 0, "folder": {"is_folded": True}}, 5, {"rpid": 3}]}}, {"code": -1, "data": {}}, {"code": 0, "data": {"replies": {}}}, {"code": 0, "data": {"replies": None}}]
    df = spark.createDataFrame([(n, "A", T0, json.dumps(x)) for n, x in enumerate(bodies)] + [(9, "A", T0, "nonsense")], "raw_payload_id long, bvid string, captured_at timestamp, body string")
    parsed = flatten.parsed_pages(df, "latest")
    assert {r.raw_payload_id: r.error is None for r in parsed.collect()} == {0: True, 1: False, 2: False, 3: True, 9: False}
    rows = {r.rpid: r for r in flatten.comment_rows(parsed).collect()}
    assert (rows[1].position, rows[3].position, rows[1].root_rpid, rows[1].visibility) == (1, 3, None, "folded")
    assert [(r.position, r.url) for r in flatten.comment_media(flatten.comment_rows(parsed)).orderBy("position").collect()] == [(0, "u1"), (1, "u2")]


def test_text_rules(spark):
    df = spark.createDataFrame([("Straße ＡＢ! 1",), (None,)], "t string")
    assert [r[0] for r in df.select(fold_text(F.col("t"), "alnum")).collect()] == ["strasseab1", None]
    pair = spark.createDataFrame([("abcd", "abce"), ("a", None), ("same", "same"), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in pair.select(seq_ratio(F.col("a"), F.col("b"), 0.5)).collect()] == [0.75, None, 1.0, None]
    urls = spark.createDataFrame([("https://x.org/a?b#c",), ("no url?x",)], "u string")
    assert [r[0] for r in urls.select(values.url_base(F.col("u"))).collect()] == ["https://x.org/a", "no url?x"]


def test_tiers_need_two_downgrades(spark):
    p = assess.Policy()
    seq = [(n, t) for n, t in enumerate("sbbasc")]
    out = assess.tier_history(spark.createDataFrame([("A", n, t) for n, t in seq], "bvid string, at int, desired string"), p).first()
    assert (out.effective, out.candidate, out.downgrades) == ("s", "c", 1)
    random.seed(6)
    rows, want = [], {}
    for key in range(40):
        effective, candidate, n = "c", None, 0
        for at in range(random.randint(1, 40)):
            desired = rows[-1][2] if rows and random.random() < 0.6 else random.choice("sabc")
            rows.append((str(key), at, desired))
            if "sabc".index(desired) <= "sabc".index(effective):
                effective, candidate, n = desired, None, 0
            else:
                n = n + 1 if candidate == desired else 1
                effective, candidate, n = (desired, None, 0) if n >= p.confirmations else (effective, desired, n)
        want[str(key)] = (effective, candidate, n)
    got = assess.tier_history(spark.createDataFrame(rows, "bvid string, at int, desired string"), p).collect()
    assert {r.bvid: (r.effective, r.candidate, r.downgrades) for r in got} == want


def test_alerts_repeat_and_resolve(spark):
    state = spark.createDataFrame([("a", True, 1, None), ("b", True, 1, 5000), ("c", True, 1, 100), ("d", True, 1, 100), ("scheduled_job_failure:x", True, 1, 100), ("e", False, 3, 100)], "alert_key string, active boolean, occurrences long, notified_at long")
    drafts = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("e", True), ("new", True), ("quiet", False)], "alert_key string, triggered boolean")
    got = {r.alert_key: (r.action, r.active, r.occurrences, r.notified_at) for r in quality.alert_transitions(state, drafts, F.lit(6000).cast("long")).collect()}
    assert got == {"a": ("repeated", True, 2, 6000), "b": ("none", True, 2, 5000), "c": ("resolved", False, 1, 100), "d": ("none", True, 1, 100), "scheduled_job_failure:x": ("resolved", False, 1, 100), "e": ("triggered", True, 4, 6000), "new": ("triggered", True, 1, 6000)}


def test_first_writer_and_last_page_win(spark):
    links = spark.createDataFrame([(1, 0, 9, 1), (1, 0, 4, 2), (1, 1, 5, 3)], "comment_observation_id long, position int, media_source_id long, arrived int")
    assert {(r.position, r.media_source_id) for r in derive.first_links(links, "arrived").collect()} == {(0, 9), (1, 5)}
    tied = spark.createDataFrame([("A", T0, 1), ("A", T0, 2)], "bvid string, captured_at timestamp, id long")
    assert windows.as_of(tied, "bvid", "captured_at", minutes(1), "id").first().id == 2


def test_times_do_not_depend_on_the_session_zone(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2024, 1, 31, 20, tzinfo=UTC)), (2, datetime(2024, 2, 1, 3, 31, tzinfo=UTC)), (3, datetime(2024, 2, 29, 17, tzinfo=UTC))], "id long, at timestamp")
    far = timezone(timedelta(hours=8))
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Shanghai", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            path = str(tmp_path / zone.replace("/", "-"))
            sinks.write_by_month(df, "at", path)
            assert {r.id: r.captured_month for r in sinks.with_month(df, "at").collect()} == {1: "2024-01", 2: "2024-02", 3: "2024-02"}
            got = sinks.read_window(spark, path, "at", datetime(2024, 2, 1, tzinfo=far), datetime(2024, 3, 1, tzinfo=far)).collect()
            assert {r.id for r in got} == {1, 2}
            p = assess.Policy()
            marks = df.select("id", assess.in_activity(F.col("at"), p).alias("busy"), assess.focus_slot(F.col("at"), p.zone, 9, 18, ("11:31",)).alias("focus"), cohorts.routine_key(F.lit("v"), F.unix_seconds("at")).alias("key"), values.iso_time(F.col("at")).alias("iso"))
            assert [tuple(r) for r in marks.orderBy("id").collect()] == [
                (1, False, False, "snapshot:v:2024-01-31T20:00:00Z:routine", "2024-01-31T20:00:00Z"), (2, True, True, "snapshot:v:2024-02-01T03:31:00Z:routine", "2024-02-01T03:31:00Z"), (3, False, False, "snapshot:v:2024-02-29T17:00:00Z:routine", "2024-02-29T17:00:00Z"),
            ]
            videos = spark.createDataFrame([("A", datetime(2024, 1, 31, 13, tzinfo=UTC)), ("B", datetime(2024, 1, 31, 15, tzinfo=UTC))], "bvid string, pubdate timestamp").withColumn("first_seen_at", F.col("pubdate")).withColumn("available", F.lit(True))
            none = spark.createDataFrame([], "bvid string, date string")
            listed = assess.terminal_list(videos, none, datetime(2024, 1, 31, 15, 30, tzinfo=UTC), p).collect()
            assert [(r.bvid, r.date) for r in listed] == [("A", "2024-01-31")]
            assert assess.terminal_list(videos, none, datetime(2024, 1, 31, 13, 30, tzinfo=UTC), p).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_events_and_targets_by_their_names(spark):
    events = spark.createDataFrame([(1, "big-patch-2"), (2, "other")], "id long, slug string")
    assert [event.resolved(events, x).first().id for x in (2, "1", " Big  Patch 2 ")] == [2, 1, 1]
    with pytest.raises(LookupError):
        event.resolved(events, "no_slug!")
    rows = [("uid", " 007 "), ("uid", "0"), ("uid", "x1"), ("seed_bvid", " BV1xx411c7mD "), ("seed_bvid", "BV1"), ("keyword", "  Big   PATCH "), ("game", "  "), ("other", "x")]
    df = spark.createDataFrame(rows, "kind string, value string").select(values.target_value(F.col("kind"), F.col("value")))
    assert [r[0] for r in df.collect()] == ["7", None, None, "BV1xx411c7mD", None, "big patch", None, None]


def test_literal_filter_folds_the_keyword(spark):
    df = spark.createDataFrame([(1, "x ERROR code y"), (2, "error  code"), (3, "50% off"), (4, None)], "id long, t string")
    assert [r.id for r in event.literal_filter(df, "t", "  Error Code ").collect()] == [1]
    assert [r.id for r in event.literal_filter(df, "t", "0% o").collect()] == [3]
    with pytest.raises(ValueError):
        event.literal_filter(df, "t", "  ")


def test_streams_end_where_folds_end(spark, sf):
    """Streaming tiers, closed counts and alert states against the batch forms."""
    tiers = {r.bvid: (r.effective, r.assessments) for r in QUERIES["stream_tiers"](spark, sf).collect()}
    assert {k: v[0] for k, v in tiers.items()} == {r.bvid: r.effective for r in QUERIES["tier_history"](spark, sf).collect()}
    drafts = QUERIES["alert_drafts"](spark, sf)
    on = {r.alert_key for r in drafts.where("triggered").collect()}
    assert {(r.alert_key, r.action, r.active) for r in QUERIES["stream_alerts"](spark, sf).collect()} == {(k, "triggered", True) for k in on}


def test_streaming_spikes(spark, tmp_path):
    rows = [(k, minutes(0 if n < 2 else 60), n, "error") for n in range(7) for k in ("A",)] + [("A", minutes(60 * h), 100 + h, "error") for h in range(2, 9)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "bvid string, captured_at timestamp, rpid long, content string").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    counts = jobs.drained(jobs.closed_counts(stream, ["error"], 3600), str(tmp_path / "counts"))
    again = spark.readStream.schema(counts.schema).parquet(str(tmp_path / "counts" / "out"))
    out = jobs.drained(ordered.spikes(again, 3600, 2.0, 3), str(tmp_path / "out")).collect()
    assert [(r.keyword, r.was, r.n, r.kind) for r in out] == [("error", 2, 5, "folded")]


def test_backoff_counts_since_success(spark):
    log = spark.createDataFrame([("k", n, n, f, None) for n, f in enumerate([True, False, True, True, True])], "k string, at int, id int, failed boolean, retry_after long")
    assert quality.failure_streaks(log, "k").first()[1:] == (3, 1200)


def test_month_layout_and_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2026, 12, 31, 23, 59, tzinfo=UTC)), (2, datetime(2027, 1, 1, tzinfo=UTC))], "id long, at timestamp")
    assert [r.captured_month for r in sinks.with_month(df, "at").orderBy("id").collect()] == ["2026-12", "2027-01"]
    sinks.write_by_month(df, "at", str(tmp_path / "m"))
    assert sinks.read_window(spark, str(tmp_path / "m"), "at", datetime(2026, 12, 1, tzinfo=UTC), datetime(2027, 1, 1, tzinfo=UTC)).count() == 1
    assert sinks.json_lines(df.select(F.lit(None).cast("string").alias("b"), F.col("id").alias("a"))).first().value == '{"a":1,"b":null}'
    with pytest.raises(ValueError):
        sinks.guarded(df, 1)


def test_window_checks():
    with pytest.raises(ValueError):
        windows.check_window(T0, T0)
    with pytest.raises(ValueError):
        windows.check_window(datetime(2026, 1, 1), T0)


def test_target_log_in_order(spark):
    """A target's state, its merged extra, and videos whose source changes; states before a first addition say nothing."""
    from tidelog.operators import targets

    add = lambda seq, kind, value, priority, **extra: (T0 + timedelta(minutes=seq), seq, "add", 1, kind, value, value.lower(), priority, None, {k: str(v) for k, v in extra.items()}, None, None, None)
    state = lambda seq, kind, value, on: (T0 + timedelta(minutes=seq), seq, "set_active", 1, kind, value, value.lower(), None, on, {}, None, None, None)
    attach = lambda seq, bvid, reason: (T0 + timedelta(minutes=seq), seq, "attach", 1, None, None, None, None, None, {}, bvid, reason, 0.5)
    rows = [state(0, "keyword", "News", False), add(1, "keyword", "News", 5, a=1, b=1), add(2, "keyword", "NEWS", 3, b=2), state(3, "keyword", "news", False), add(4, "seed_bvid", "v1", 7), attach(5, "v1", "search"), state(6, "seed_bvid", "v1", False), attach(7, "v2", "search"), add(8, "seed_bvid", "v1", 1)]
    log = spark.createDataFrame(rows[::-1], "ts timestamp, seq long, op string, event_id long, target_type string, target_value string, normalized_value string, priority long, active boolean, extra map<string,string>, bvid string, association_reason string, confidence double").repartition(3)
    folded = targets.targets(log)
    got = {r.normalized_value: (r.target_id, r.target_value, r.priority, r.active, r.extra) for r in folded.collect()}
    assert got == {"news": (1, "NEWS", 5, False, {"a": "1", "b": "2"}), "v1": (4, "v1", 7, True, {})}
    assert [(r.source_target_id, r.keyword, r.active) for r in targets.keywords(folded).collect()] == [(1, "NEWS", False)]
    seen = lambda n: {r.bvid: (r.source_target_id, r.association_reason, r.active) for r in targets.videos(log.where(f"seq <= {n}"), targets.targets(log.where(f"seq <= {n}"))).collect()}
    assert seen(5) == {"v1": (4, "search", True)}
    assert seen(7) == {"v1": (4, "search", False), "v2": (None, "search", True)}
    assert seen(8)["v1"] == (4, "seed_bvid", True)
    assert [(r.idempotency_key, r.priority) for r in targets.first_tasks(log, folded).collect()] == [("fetch_video_stats:video:v1:event:1", 7)]


def test_recovery_takes_the_widest_pages(spark):
    """Of missed checkpoints one recovery, its hot pages the widest recorded or planned; the routine slot gives way."""
    videos = spark.createDataFrame([("A", "s", "active", True, True, True), ("B", "c", "dormant", False, False, True), ("C", "a", "active", True, True, True)], "bvid string, tier string, stage string, frontier_complete boolean, first_active boolean, routine_due boolean")
    due = spark.createDataFrame([("A", 6, "missed", False), ("A", 12, "missed", False), ("A", 18, "planned", False), ("C", 6, "planned", True)], "bvid string, hours int, state string, in_bucket boolean")
    tried = spark.createDataFrame([("A", 6, "hot_core", "failed", 1, 9), ("A", 6, "video_metrics", "complete", None, None)], "bvid string, hours int, component_kind string, status string, start_page long, end_page long")
    plan = cohorts.cohort_plans(videos, due, tried, 1_704_067_200, {"s": 3, "a": 2, "b": 1, "c": 1}, {"s": 5, "a": 2, "b": 1, "c": 1}).collect()
    of = lambda bvid, reason: {(r.component_kind, r.priority, r.start_page, r.end_page) for r in plan if (r.bvid, r.reason) == (bvid, reason)}
    assert of("A", "recovery") == {("video_metrics", 117, None, None), ("hot_core", 116, 1, 9), ("hot_deep", 115, 4, 5), ("latest_reconciliation", 115, None, None)}
    assert of("A", "age_checkpoint") == {("video_metrics", 122, None, None), ("hot_core", 121, 1, 3), ("hot_deep", 120, 4, 5), ("latest_reconciliation", 120, None, None)}
    assert not of("A", "routine") and not of("C", "routine") and of("C", "age_checkpoint")
    assert of("B", "routine") == {("video_metrics", 72, None, None), ("hot_core", 71, 1, 1)}
    assert {r.component_key for r in plan if r.bvid == "B"} == {"snapshot:B:2024-01-01T00:00:00Z:routine:video_metrics", "snapshot:B:2024-01-01T00:00:00Z:routine:hot_core"}
    assert {r.cohort_key for r in plan if r.reason == "recovery"} == {"snapshot:A:recovery:through:12h"}


def test_older_keys_of_maps_win(spark):
    rows = [(1, 5, T0, {"a": None, "b": 1}), (2, 5, minutes(1), {"a": 2, "c": 3}), (3, 6, T0, None), (4, 6, T0, {}), (5, None, T0, {"z": 9}), (5, None, T0, {"z": 9})]
    obs = spark.createDataFrame(rows, "id long, rpid long, captured_at timestamp, extra map<string,int>").selectExpr("*", "'A' bvid", "'x' content", "id raw_payload_id")
    out = {r.rpid: r.extra for r in derive.entities(obs, later=(), maps=("extra",)).collect()}
    assert out == {5: {"a": None, "b": 1, "c": 3}, 6: None, None: {"z": 9}}


def test_evidence_of_signals(spark):
    points = spark.createDataFrame([("A", "p1", "p2", T0, [1], [2, 3], 1.0), ("A", "p2", "p3", T0, [], [], 0.1)], "bvid string, previous_page_id string, current_page_id string, captured_at timestamp, entered array<long>, exited array<long>, turnover_rate double")
    assert sorted((r.kind, r.id) for r in event.turnover_evidence(points, 0.5).collect()) == [("current_page", "p2"), ("entered", "1"), ("exited", "2"), ("exited", "3"), ("previous_page", "p1")]
    infos = spark.createDataFrame([("A", minutes(1), 9, "t9", 3, "o"), ("A", minutes(1), 8, "t8", 3, "o"), ("B", minutes(-1), 1, "t", 3, "o"), ("C", minutes(1), 2, "t", 4, None), ("D", minutes(9), 3, "t", 3, "o")], "bvid string, captured_at timestamp, raw_payload_id long, title string, owner_mid long, owner_name string")
    targets = spark.createDataFrame([(7, "uid", "3", True, '{"role":"Major_Creator"}'), (8, "uid", "4", False, '{"role":"major_creator"}')], "id long, target_type string, normalized_value string, active boolean, extra string")
    assert [(r.scope, r.title, r.event_target_id, r.raw_payload_id) for r in event.creator_evidence(infos, targets, T0, minutes(9)).collect()] == [("A", "t8", 7, 8)]


def test_planning_signals(spark):
    now = minutes(120)
    second = int(T0.timestamp())
    videos = spark.createDataFrame([("A", second, None), ("B", second + 9000, "a"), ("C", second, None), ("D", second, None)], "bvid string, anchor long, pinned_tier string")
    sources = spark.createDataFrame([("A", True, True, True), ("B", True, True, False)], "bvid string, active boolean, official boolean, monitored boolean")
    of_event = spark.createDataFrame([(1, "A", True), (2, "C", True), (1, "D", False)], "event_id long, bvid string, active boolean")
    events = spark.createDataFrame([(1, "active"), (2, "archived")], "id long, status string")
    metrics = spark.createDataFrame([("C", minutes(0), 10), ("C", minutes(110), 20), ("D", minutes(61), 0), ("D", minutes(119), 900), ("D", minutes(121), 9)], "bvid string, captured_at timestamp, view_count long")
    frontiers = spark.createDataFrame([("C", "baseline_complete"), ("D", "running")], "bvid string, baseline_status string")
    out = {r.bvid: r for r in assess.planning_signals(videos, sources, of_event, events, metrics, frontiers, now, assess.Policy(dormant_seconds=3600, archive_seconds=7200)).collect()}
    assert {k: (r.official, r.event_core, r.views_hour, r.age_seconds, r.low_growth, r.stage, r.frontier_complete) for k, r in out.items()} == {
        "A": (True, True, None, 7200, None, "active", False), "B": (False, False, None, 0, None, "active", False),
        "C": (False, False, 10, 7200, True, "archived", True), "D": (False, False, 900, 7200, False, "active", False),
    }


def test_records_hold_their_fields(spark):
    rows = spark.createDataFrame([("A", T0, 1, None)], "bvid string, at timestamp, id long, note string")
    out = event.timeline(comment_state_event=(rows, F.col("at"), F.col("id"), ["id", "note"])).collect()
    assert [(r.source_table, r.source_key, r.data) for r in out] == [("comment_state_events", "comment_state_events:1", '{"id":1,"note":null}')]


def test_links_get_the_asset_of_their_content(spark):
    links = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, None)], "id long, media_source_id long")
    blobs = spark.createDataFrame([(11, b"x"), (10, b"x")], "id long, body binary")
    sources = blobs.select(F.col("id").alias("media_source_id"), F.sha2("body", 256).alias("blob_sha256"))
    out = derive.with_assets(links, sources, derive.exact_assets(blobs))
    assert {r.id: r.media_asset_id for r in out.collect()} == {1: 10, 2: 10, 3: None, 4: None}


def test_media_links_are_dealt_into_parts_by_the_rows_of_the_table(spark, tmp_path):
    rows = spark.range(0, 1_000, 1, 2)
    rows.selectExpr("id % 300 l_orderkey", "cast(id div 300 as int) l_linenumber", "id l_partkey", "date'2024-01-01' l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows.where("id < 300").selectExpr("id o_orderkey", "id % 7 o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert bindings.parts_of(spark, str(tmp_path), "lineitem") == spark.sparkContext.defaultParallelism
    assert bindings.parts_of(spark, str(tmp_path), "lineitem", 30) == 34
    links = bindings.media_links(spark, str(tmp_path))
    assert links.count() == 1_000 and links.select("comment_observation_id", "position").distinct().count() == 1_000
    changes = derive.media_changes(links, links.selectExpr("comment_observation_id id", "rpid"), 9)
    assert changes.rdd.getNumPartitions() == 9 and {r.event_type for r in changes.collect()} >= {"media_changed", "media_added", "media_removed"}
