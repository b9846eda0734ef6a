"""Split joins, numbering, clusters in the archive's order, candidates that bounds leave, folding of ASCII."""

import difflib
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import text, windows
from tidelog.operators import event, similar

T0 = datetime(2026, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize("per_key", [3, 20_000])
def test_busy_bands_are_split_and_lose_no_pair(spark, per_key):
    rng = random.Random(2)
    rows = [(n, T0 + timedelta(seconds=rng.choice([rng.randrange(4000), 1800])), rng.choice("xxxy")) for n in range(120)]
    side = lambda s: spark.createDataFrame(rows, f"{s}_id long, at timestamp, {s}_word string")
    for equal in ((), ("word",)):
        pairs = windows.band_join(side("left"), side("right"), "at", 300, F.col("left_id") != F.col("right_id"), *equal, per_key=per_key)
        got = [(r.left_id, r.right_id) for r in pairs.collect()]
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and abs((a[1] - b[1]).total_seconds()) <= 300 and (not equal or a[2] == b[2])}
        assert len(got) == len(want) and set(got) == want
    # the hot second alone would be one key; its rows are dealt into parts
    keys = side("left").groupBy(F.floor(F.unix_seconds("at") / 301)).count().agg(F.max("count")).first()[0]
    assert keys > 3


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), n) for n in range(500)]
    got = {(r.a, r.b): r.place for r in windows.numbered(spark.createDataFrame(rows, "a long, b long").repartition(5), "place", "a", "b").collect()}
    assert got == {r: n for n, r in enumerate(sorted(rows), 1)}
    assert windows.numbered(spark.createDataFrame([], "a long"), "place", "a").count() == 0


def test_clusters_are_numbered_by_their_first_candidate(spark):
    rng = random.Random(9)
    rows = [(100 - n, rng.choice("ABC"), T0 + timedelta(seconds=rng.randrange(2000)), f"text number {rng.randrange(12)}", f"n{n}", n % 7, None if n % 3 else n) for n in range(90)]
    own = spark.createDataFrame(rows, "rpid long, bvid string, first_seen_at timestamp, first_content string, author_name string, author_mid long, first_raw_payload_id long").repartition(3)
    found = event.templates(own, 300, 1.0)
    clusters = event.numbered_clusters(event.template_links(own, 300), own)
    assert sorted(clusters.collect()) == sorted(event.numbered_clusters(found, own).collect())
    edges = event.cluster_edges(found, clusters)
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    pairs = [(a[0], b[0]) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if a[1] != b[1] and a[3] == b[3] and (b[2] - a[2]).total_seconds() <= 300]
    group, number = {}, {}
    for a, b in pairs:
        whole = group.get(a, {a}) | group.get(b, {b})
        for x in whole:
            group[x] = whole
    want = {}
    for a, b in pairs:
        want[a, b] = number.setdefault(min(group[a]), len(number) + 1)
    assert {(r.left_rpid, r.right_rpid): r.cluster_id for r in edges.collect()} == want and len(number) > 3
    members = event.cluster_members(clusters, own)
    assert {(r.cluster_id, r.rpid) for r in members.collect()} == {(c, x) for k, c in want.items() for x in k}
    sums = {r.cluster_id: (r.members, r.raw_payloads) for r in event.cluster_summaries(members).collect()}
    payload = {r[0]: r[6] for r in rows}
    for c in number.values():
        inside = {x for k, n in want.items() if n == c for x in k}
        assert sums[c] == (len(inside), len({payload[x] for x in inside} - {None}))


@pytest.mark.parametrize("least", [0.5, 0.72, 0.85, 0.95])
def test_bounds_leave_all_pairs_of_the_ratio_and_few_others(spark, least):
    rng = random.Random(int(least * 100))
    rows = []
    for n in range(80):
        size = rng.choice([4, 5, 7, 12, 30, 60])
        t = "".join(rng.choice("abcdefghij") for _ in range(size)) if n % 2 else "abcdefghij" * (size // 4)
        t = "".join(c if rng.random() > 0.06 else rng.choice("xyz") for c in t)
        rows.append((n, "AB"[n % 2 ^ n // 2 % 2], T0 + timedelta(seconds=n), t))
    own = spark.createDataFrame(rows, "rpid long, bvid string, first_seen_at timestamp, first_content string")
    got = {(r.left_rpid, r.right_rpid): r.similarity for r in event.templates(own, 3600, least).collect()}
    both = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1]]
    ratios = {(a[0], b[0]): difflib.SequenceMatcher(None, a[3], b[3], autojunk=False).ratio() for a, b in both}
    assert got == {k: round(v, 6) for k, v in ratios.items() if v >= least} and got
    keys = own.withColumns({"hash": F.sha2("first_content", 256), "size": F.length("first_content"), "letters": text.letter_counts(F.col("first_content")), "grams": text.gram_counts(F.col("first_content"))})
    n = event.similar_candidates(keys, 3600, least, F.col("left_bvid") != F.col("right_bvid")).where("left_rpid < right_rpid").count()
    assert len([k for k, v in got.items() if v < 1]) <= n < (0.9 if least < 0.6 else 0.45) * len(both)


def test_ascii_folds_like_the_rest(spark):
    rng = random.Random(6)
    texts = ["".join(chr(rng.randrange(128)) for _ in range(rng.randrange(30))) for _ in range(300)] + ["Straße  ①", None, "", "\n", "\x1c a\x85B ", "İI"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    for mode, fold in text.FOLDS.items():
        for r in df.select("t", text.fold_text(F.col("t"), mode).alias("f")).collect():
            assert r.f == (None if r.t is None else fold(r.t)), (mode, r.t)


def test_letters_and_signs_of_latin_1_fold_like_the_rest(spark):
    from tidelog.functions import text

    plain = [chr(c) for c in (*range(0x80, 0x180), 0x2013, 0x2014, *range(0x2018, 0x2023), 0x2026, 0x20AC, 0x1E9E, 0x301)]
    texts = [f"A{c}b {c}" for c in plain] + ["Straße ÉÈ\u00a0Ñandú «x» — e\u0301", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    # of Latin-1, only letters (and the two signs among them) stay
    assert df.where(~F.col("t").rlike(text.PLAIN) & ~F.col("t").rlike("[^\\x00-\\xFF]")).count() == 64
    for mode, fold in text.FOLDS.items():
        for r in text.with_folded(df, "f", F.col("t"), mode).collect():
            assert r.f == fold(r.t), (mode, r.t)


def test_a_folded_text_is_worked_out_once(spark):
    df = spark.createDataFrame([(1, "Ab"), (2, None)], "id long, content string")
    plan = event.matched(df, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp") + plan.lower().count("rlike") <= 3, plan
    assert [r.hits for r in event.matched(df, ["a", "b", "c"]).collect()] == [["a", "b"]]


def test_most_long_texts_end_before_their_common_subsequence_and_none_is_lost(monkeypatch):
    rng, asked = random.Random(5), []
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(300)]
    prose = lambda n: "".join(rng.choices(words, k=n))
    whole = lambda a, b: 2 * sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / (len(a) + len(b))
    reaches = text._subsequence_reaches
    monkeypatch.setattr(text, "_subsequence_reaches", lambda *a: asked.append(1) or reaches(*a))
    for _ in range(40):
        a, b = prose(250), prose(250)
        assert text._ratio(a, b, 0.85) == (round(whole(a, b), 6) if whole(a, b) >= 0.85 else None)
    assert len(asked) < 20
    for _ in range(60):
        a = prose(60)
        b = list(a)
        for k in sorted(rng.sample(range(len(a)), rng.randint(0, 60)), reverse=True):
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "漢"])
        b = "".join(b)
        assert text._ratio(a, b, 0.85) == (round(whole(a, b), 6) if whole(a, b) >= 0.85 else None)


def test_texts_are_shuffled_by_themselves_and_not_once_a_pair(spark):
    rng = random.Random(8)
    rows = [(n, "AB"[n % 2], T0 + timedelta(seconds=n), "".join(rng.choices("abcdefghijklmnop", k=3000))) for n in range(40)]
    own = spark.createDataFrame(rows, "rpid long, bvid string, first_seen_at timestamp, first_content string")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).head().totalShuffleWrite()

    name = "spark.sql.autoBroadcastJoinThreshold"
    held, before = spark.conf.get(name), shuffled()
    spark.conf.set(name, "-1")
    try:
        assert event.templates(own, 3600, 0.85).collect() == []
    finally:
        spark.conf.set(name, held)
    assert shuffled() - before < 3 * 40 * 3000


@pytest.mark.parametrize(("most", "chars"), [(20_000, 16 << 20), (25, 16 << 20), (20_000, 900), (7, 300)])
def test_similar_pairs_of_busy_bands_are_found_once(spark, monkeypatch, most, chars):
    monkeypatch.setattr(similar, "ROWS", most)
    monkeypatch.setattr(similar, "CHARS", chars)
    rng = random.Random(most + chars)
    base = ["".join(rng.choices("abcdefgh", k=n)) for n in (5, 9, 14, 14, 30, 41, 60)]
    rows = []
    for n in range(150):
        t = "".join(c if rng.random() > 0.04 else rng.choice("xyz") for c in rng.choice(base))
        # most in one window; times that repeat, at the ends of windows and bands too
        second = rng.choice([rng.randrange(-700, 2500), 60 * rng.randrange(8), 61 * 4 * rng.randrange(9) - rng.randrange(2), 100])
        rows.append((None if n % 37 == 0 else n // 2 if n % 29 == 0 else n, None if n % 41 == 0 else rng.choice("ABC"), None if n % 43 == 0 else datetime.fromtimestamp(second, UTC), None if n % 47 == 0 else t))
    own = spark.createDataFrame(rows, "rpid long, bvid string, first_seen_at timestamp, first_content string").repartition(3)
    got = [tuple(r) for r in event.templates(own, 60, 0.8).collect()]
    order = lambda r: (r[2], r[0] is not None, r[0] or 0)
    want = []
    whole = [r for r in rows if None not in r[1:]]
    for a in whole:
        for b in whole:
            apart = (b[2] - a[2]).total_seconds()
            if order(a) < order(b) and a[1] != b[1] and apart <= 60:
                ratio = difflib.SequenceMatcher(None, a[3], b[3], autojunk=False).ratio()
                if ratio >= 0.8:
                    want.append((a[0], b[0], a[1], b[1], round(ratio, 6), int(apart), f"{'normalized_exact' if a[3] == b[3] else 'similar'}_text_cross_video"))
    assert sorted(got, key=str) == sorted(want, key=str) and len({r[6] for r in want}) == 2


def test_one_text_with_many_is_compared_as_with_each():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60)]
    base = rng.choices(words, k=80)
    others = ["".join(w if rng.random() > share else rng.choice(words) for w in base) for share in (0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.4, 1) for _ in range(8)] + ["", "ab", "abab" * 100, "漢" * 300]
    one, first = "".join(base), np.array([rng.random() < 0.5 for _ in others])
    pairs = [(one, x) if f else (x, one) for x, f in zip(others, first, strict=True)]
    ratios = [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    for chars in (10**6, 1000):
        got = text.ratios_of(one, others, first, 0.85, text.Codes(chars))
        assert got == [round(r, 6) if r >= 0.85 else None for r in ratios] and 8 < len([r for r in got if r]) < 60
