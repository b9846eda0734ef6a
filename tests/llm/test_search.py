"""Ranking, phrase fingerprints and hard negatives against plain Python on small tables with awkward rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import negatives, phrases, ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score long, rank int, item_id long, term string"
random.seed(11)
WORDS = [f"t{n}" for n in range(40)] + ["Äpfel", "né", "中文", "A1", "a1"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return TERM.findall(lower(text))


def corpus():
    texts = [None, "", " \n", "...", "t1", "T1", "t1 t2", "x\x1cy \x85 z", "é" * 500, "t3 " * 3000, "ab" * 4000]
    texts += [" ".join(random.choices(WORDS, weights=[1 / (n + 1) for n in range(len(WORDS))], k=random.randint(1, 120))) for _ in range(150)]
    texts += texts[12:40]
    rows = [(n * 3, t, 1, 2, n, "x") for n, t in enumerate(texts)]
    return [*rows, rows[20], (rows[30][0], texts[31], 1, 2, 3, "x"), (None, texts[15], 1, 2, 3, "x"), (None, None, 1, 2, 3, "x")]


ROWS = corpus()
ITEMS = [(n, " ".join(random.choices(WORDS, k=random.randint(1, 25)))) for n in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (3, "t1 t1 t9"), (None, "t2 t5"), (23, "t3"), (24, "中文! Né")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))


def scored():
    own = [Counter(terms(r[1])) for r in ROWS]
    held = [sum(c.values()) for c in own]
    n, total = sum(1 for h in held if h), sum(held)
    df = Counter(t for c in own for t in c)
    asked = {}
    for item, text in ITEMS:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, wanted in asked.items():
        rows = []
        for r, c, h in zip(ROWS, own, held, strict=True):
            m = 50 + (50 * h * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                rows.append((-score, r[0] is None, r[0] or 0, r[0]))
        out[item] = [(-s, d) for s, _, _, d in sorted(rows, key=lambda x: x[:3])]
    return out


@pytest.mark.parametrize("params", [ranking.Params(), ranking.Params(most=5, block=16), ranking.Params(most=3, block=1, round_bytes=600)])
def test_ranking_equals_scoring_all(documents, items, params):
    got = {}
    for r in ranking.search(documents, items, params).collect():
        got.setdefault(r["item_id"], {})[r["rank"]] = (r["score"], r["doc_id"])
    want = {item: dict(enumerate(rows[: params.most], 1)) for item, rows in scored().items() if rows}
    assert got == want


def test_pair_bounds_skip_more_than_single_ones(spark):
    # a and b peak in different documents, so that together they are worth little more than one
    rows = [(n, ("a " * 30 if n % 2 else "b " * 30) + "f") for n in range(400)] + [(500 + n, "a b r r r") for n in range(60)] + [(1000 + n, "f") for n in range(400)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, "a b r")], "item_id long, text string")
    part = next(ranking.rounds(asked, 1 << 20))
    blocks = ranking.counted(docs, part.terms, ranking.Params())
    n, total, held = ranking.statistics(blocks, len(part.terms))
    weight = ranking.weights(n, held)
    chain = part.of[0][np.lexsort((part.of[0], weight[part.of[0]]))]
    block = ranking.Block(ranking.indexed(blocks, [chain], weight, n, total, 50).first().asDict())
    numbers = {p: k for k, p in enumerate(sorted(set(zip(chain.tolist(), chain.tolist()[1:], strict=False))))}
    units = ranking.combined(chain.tolist(), block, numbers)
    alone = sum(block.peaks)
    assert any(len(u[1]) == 2 for u in units) and sum(u[0] for u in units) < alone
    # at a floor between the bounds, the pair's documents are not scored though single bounds would have them scored
    pair = next(u for u in units if len(u[1]) == 2)
    floor = pair[0] + 1
    assert floor <= sum(block.peaks[block.place[t]] for t in pair[1])
    at, score = ranking.searched(block, chain.tolist(), numbers, weight, floor)
    full_at, full = ranking.searched(block, chain.tolist(), numbers, weight, 0)
    assert dict(zip(at, score, strict=True)) == {a: s for a, s in zip(full_at, full, strict=True) if s >= floor}


def test_ranking_of_empty_tables(spark, documents, items):
    none = documents.limit(0)
    assert ranking.search(none, items).count() == 0
    assert ranking.search(documents, items.limit(0)).count() == 0
    assert ranking.search(spark.createDataFrame([(1, "  .")], "doc_id long, text string"), items).count() == 0


def lz78(data):
    known, start = set(), 0
    for stop in range(1, len(data) + 1):
        if data[start:stop] not in known:
            known.add(data[start:stop])
            start = stop
    return known


def in_order(rows):
    """Rows by descending id, of one id by the hash of the text that Spark gives; null ids last."""
    return sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["key"]))


@pytest.mark.parametrize("params", [phrases.Params(), phrases.Params(size=16, range_bytes=2000), phrases.Params(range_bytes=300)])
def test_phrases_equal_a_plain_parse(documents, params):
    rows = in_order(documents.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS key").collect())
    make = phrases.Fingerprints(params)
    sets = {}

    def plain(text):
        if text not in sets:
            found = lz78(text.encode())
            data = text.encode()
            ends = make.parse.clear() or make.parse.more(data, 0)
            starts = [0, *ends][:-1]
            assert {data[a:b] for a, b in zip(starts, ends, strict=True)} == found and len(ends) == len(found)
            sets[text] = found, make.of(text)
        return sets[text]

    want = []
    for n, r in enumerate(rows):
        after, text = rows[(n + 1) % len(rows)]["text"], r["text"]
        most = len(text) // 3
        edited = text[: len(text) - most] + after[:most]
        own, other, next_ = plain(text), plain(edited), plain(after)
        like = [phrases.likeness(own[1], x[1], params.size) for x in (other, next_)]
        for value, x in zip(like, (other, next_), strict=True):
            union = own[0] | x[0]
            if len(union) <= params.size:
                assert value == pytest.approx(len(own[0] & x[0]) / len(union) if union else 1.0)
        want.append((r["doc_id"], len(text), hashlib.sha256(edited.encode()).hexdigest(), phrases.shown(own[1]), phrases.shown(other[1]), *like))
    got = [tuple(r) for r in phrases.fingerprints(documents, params).collect()]
    assert Counter(got) == Counter(want)


def test_phrases_estimate_and_bounds():
    make = phrases.Fingerprints(phrases.Params())
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(3000)]
    other = base[:1800] + [rng.choice(WORDS) for _ in range(1200)]
    a, b = " ".join(base), " ".join(other)
    exact = len(lz78(a.encode()) & lz78(b.encode())) / len(lz78(a.encode()) | lz78(b.encode()))
    assert abs(phrases.likeness(make.of(a), make.of(b), 128) - exact) < 0.12
    assert phrases.shown_likeness(phrases.shown(make.of(a)), phrases.shown(make.of(a))) == 1.0
    # a small dictionary: the parse starts anew, in the edited text too
    small = phrases.Fingerprints(phrases.Params(most_phrases=50))
    long = "".join(chr(97 + rng.randrange(26)) for _ in range(300_000))
    own, edited, text = small.of_both(long, long[::-1])
    assert (own == small.of(long)).all() and (edited == small.of(text)).all() and len(small.parse.known) < 70_000


def test_phrases_of_few_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert phrases.fingerprints(empty).count() == 0
    one = phrases.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    same = phrases.fingerprints(spark.createDataFrame([(7, "abc")] * 9 + [(None, "abc")] * 4, "doc_id long, text string"), phrases.Params(range_bytes=4)).collect()
    assert len(same) == 13 and {r["near_next"] for r in same} == {1.0}


def vectors(rng, d, n, spread):
    centres = rng.standard_normal((5, d))
    return [[float(v) for v in centres[k % 5] + spread * rng.standard_normal(d)] for k in range(n)]


@pytest.mark.parametrize(("d", "spread", "params"), [(64, 3.0, negatives.Params()), (64, 0.2, negatives.Params(block_bytes=60_000, first_share=3)), (7, 0.5, negatives.Params(least_blocks=5, negatives=3, positives=2)), (1, 1.0, negatives.Params())])
def test_negatives_equal_scoring_all(spark, d, spread, params):
    rng = np.random.default_rng(d)
    rows = [(n, v, int(rng.integers(0, 4)), float(n)) for n, v in enumerate(vectors(rng, d, 600, spread))]
    rows += [(n + 600, rows[n][1], rows[n][2], 0.0) for n in range(0, 100, 7)]
    odd = [(None, rows[0][1], 1, 0.0), (901, None, 1, 0.0), (902, rows[1][1], None, 0.0), (903, [float("nan")] * d, 1, 0.0), (904, [float("inf")] * d, 1, 0.0), (905, [None] * d, 1, 0.0), (920, rows[2][1] + [1.0], 1, 0.0), (921, [], 1, 0.0), (940, [], 2, 0.0)]
    table = spark.createDataFrame([*rows, *odd, rows[5]], "vec_id long, embedding array<double>, label int, score double").repartition(3)
    got = {}
    for r in negatives.mined(table, F.col("id") % 20 == 0, params=params).collect():
        got[r["anchor_id"], r["positive_id"], r["rank"]] = (r["negative_id"], r["positive_score"], r["negative_score"])
    whole = [(i, [math.floor(256 * x) for x in v], l) for i, v, l, _ in [*rows, odd[6], odd[7], odd[8]]]
    want = {}
    for i, v, label in whole:
        if i % 20:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, w, m in whole if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scores if s[2] == label][: params.positives]:
            inside = [(k, -n) for n, k, m in scores if m != label and params.low * -p <= 100 * -n <= params.high * -p]
            want |= {(i, j, rank): (k, -p, n) for rank, (k, n) in enumerate(inside[: params.negatives], 1)}
    assert got == want and want


def test_segment_bounds_hold_and_narrow():
    rng = np.random.default_rng(1)
    for d in (1, 3, 17, 64):
        x, y = np.floor(256 * rng.standard_normal((30, d))), np.floor(256 * (rng.standard_normal((40, d)) + 1))
        exact, last = x @ y.T, None
        for (am, av), (bm, bv) in zip(*(negatives.levels(*negatives.summaries(v, 16), d, 16) for v in (x, y)), strict=True):
            middle, width = am @ bm.T, av @ bv.T
            assert (np.abs(exact - middle) <= width * (1 + 1e-9) + 1e-6).all()
            assert last is None or (middle + width <= last + 1e-6 * np.abs(last) + 1e-6).all()
            last = middle + width


def test_clustered_vectors_are_mostly_skipped():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 64)) + rng.standard_normal((8, 1)) * 3
    x = np.floor(256 * (centres[np.arange(800) % 8] + 0.02 * rng.standard_normal((800, 64))))
    rows = negatives.Rows(np.arange(800), np.zeros(800, np.int64), x, negatives.levels(*negatives.summaries(x, 16), 64, 16), float(np.abs(x).max()))
    asked = rows.part(0, 8)
    exact = asked.x @ x.T
    low = np.sort(exact, axis=1)[:, -100]
    _, _, open_ = negatives.admitted(asked, rows, low, np.full(8, np.inf), np.ones((8, 800), bool))
    assert open_.sum() >= (exact >= low[:, None]).sum() and open_.sum() < 0.3 * exact.size


def test_negatives_of_large_numbers_and_none(spark):
    scaled = [(0, [2.0**19, 2.0**18 + 1 / 256], 1), (1, [2.0**19, 3 / 256], 1), (2, [2.0**18, 5 / 256], 2)]
    table = spark.createDataFrame(scaled, "vec_id long, embedding array<double>, label int")
    assert negatives.mined(table.limit(0), F.col("id") == 0).count() == 0
    assert negatives.mined(table, F.col("id") == 77).count() == 0
    got = negatives.mined(table, F.col("id") == 0).first()
    a, p, n = ([int(256 * v) for v in r[1]] for r in scaled)
    assert (got["positive_score"], got["negative_score"]) == (a[0] * p[0] + a[1] * p[1], a[0] * n[0] + a[1] * n[1])


def test_many_finds_in_one_text_cost_their_number(spark):
    from tidelog.llm import pii

    seconds = {}
    for n in (500, 16_000, 64_000):
        rows = spark.createDataFrame([(1, "a@b.co x1y " * n, 11 * n)], "doc_id long, text string, n_chars long")
        began = time.time()
        found = pii.find_pii(rows).first()
        seconds[n] = time.time() - began
        assert found["n_email"] == n and found["spans"].endswith(f"email:{11 * (n - 1)}:{11 * (n - 1) + 6}")
    out = pii.redact(rows).first()
    assert out["text"] == "[EMAIL] x1y " * n and out["n_chars"] == 12 * n
    # quadratic work would cost sixteen times as much
    assert seconds[64_000] < 8 * seconds[16_000] + 10


def test_redacted_texts_of_many_blocks(spark):
    from tidelog.llm import pii

    text = "é😀" * 5000 + " a@b.co " + "z" * 4090 + " 1.2.3.4" + "ü" * 9000 + "\nq@r.st"
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert out == text.replace("a@b.co", "[EMAIL]").replace("1.2.3.4", "[IP]").replace("q@r.st", "[EMAIL]")


def test_stages_keep_columns_of_any_name(spark):
    from tidelog.llm import decontamination, neardup, pii, toxicity

    names = "doc_id long, text string, _score double, _score_ string, _hash string, _key string, _row string, _kept string, _id string, _spans string, _blocks string, _size string"
    rows = [(n, f"mail a{n}@b.co " + " ".join(random.choices(WORDS, k=30)), 0.5, *"abcdefghi") for n in range(20)]
    docs = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([(n, n % 2) for n in range(20)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    model = toxicity.fit(docs, labels)
    for out in (toxicity.without_toxic(docs, model), neardup.without_copies(docs), decontamination.without_matches(docs, items), pii.redact(docs)):
        assert out.columns == docs.columns and out.select(*docs.columns[2:]).distinct().collect() == [(0.5, *"abcdefghi")]


def test_a_common_line_brings_no_item_to_tiling(spark):
    from tidelog.llm import decontamination

    rng = random.Random(12)
    vocabulary, params = [f"w{n}" for n in range(3000)], decontamination.Params()
    text = lambda: " ".join(rng.choices(vocabulary, k=60) + "this line is in every text".split() + rng.choices(vocabulary, k=60))
    rows, tests = [(n, text()) for n in range(200)], [(n, text()) for n in range(50)]
    # an item whose sentences come in another order, and one of which too little is there
    parts = tests[7][1].split()
    rows += [(500, "x " + " ".join(parts[80:] + parts[40:80] + parts[:40])), (501, " ".join(parts[:50]))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    known = decontamination._known(items.select(F.col("item_id").alias("number"), F.col("text").alias("item_text")), params)
    found = docs.select("doc_id", F.explode(decontamination._sharing(F.col("text"), known, params)).alias("n")).collect()
    assert [(r.doc_id, r.n) for r in found] == [(500, 7)]
    for p in (params, decontamination.Params(most_sent=1)):
        assert [(r.doc_id, r.item_id) for r in decontamination.matches(docs, items, p).collect()] == [(500, 7)]


def test_word_hasher_holds_no_words():
    """Words that were seen were kept in a map of Python objects, which took more time and memory than hashing them."""
    import tracemalloc

    from tidelog.llm.common import WordHasher

    hasher, kept = WordHasher(), 0
    tracemalloc.start()
    try:
        for k in range(20):
            hasher([b"w%d" % n for n in range(k * 1000, (k + 1) * 1000)])
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert kept < 500_000


def test_gram_hashes_by_halves():
    """Sequences of any length have the hash of their words one by one."""
    import numpy as np

    from tidelog.llm.common import BASE, gram_hashes, mixed

    hashes = np.random.default_rng(5).integers(0, 2**64, 70, np.uint64)
    for n in (1, 2, 3, 4, 5, 7, 12, 34, 70, 71):
        plain = [sum(int(h) * BASE ** (n - 1 - k) for k, h in enumerate(hashes[i : i + n])) + n for i in range(len(hashes) - n + 1)]
        assert gram_hashes(hashes, n).tolist() == mixed(np.array([x % (1 << 64) for x in plain], np.uint64)).tolist()
