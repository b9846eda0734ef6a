"""Corpus operators against plain Python on small tables with awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import ann, common, decontamination, html, lm, neardup, packing, pii, substrings, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, raw string, row_key long, signature string, n_chars long"
random.seed(7)
VOCABULARY = [f"w{n}" for n in range(120)]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    base = [random.choice(VOCABULARY) for _ in range(90)]
    texts = [None, "", "   \n", "one", "One two", "one two", "é" * 3000, "a " * 400, "b" * 20000, "x\x1cy \x85 z  w", "<|endoftext|> a<|endoftext|>", "mail bob.x@mail.example.com card 4111 1111 1111 1111 ip 1.2.3.4 call +1 (555) 555-1234 😀 1.2.3.999"]
    for n in range(60):
        w = list(base)
        for _ in range(n % 9):
            w[random.randrange(len(w))] = random.choice(VOCABULARY)
        texts.append(" ".join(w) + ".")
    for _ in range(60):
        texts.append(". ".join(" ".join(random.choices(VOCABULARY, k=random.randint(1, 12))) for _ in range(random.randint(1, 30))))
    texts += texts[12:20]
    rows = [(n, t, "r", n % 3, "s", len(t or "")) for n, t in enumerate(texts)]
    return [*rows, rows[20], (None, texts[15], "r", 1, "s", 1), (None, None, "r", 1, "s", 0)]


ROWS = corpus()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))


def test_token_counts(documents, empty, library):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(documents).collect())
    want = Counter()
    for i, t, *_ in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    assert tokens.count_tokens(empty).count() == 0


def test_token_counts_of_random_texts(library):
    parts = list("aaabcdeé ÷\n\t  ..,'‘’`sdtmllvere0123٣½Ⅷß你好😀\x1c\x85\xa0 \r\x00ªº<|>") + ["<|endoftext|>", "'ll", " the"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(3000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(tokens.vocabulary_path("byte_bpe_50k.json")).count(texts).tolist() == want


def test_packing_round_trip(documents, empty, library):
    rows = packing.pack(documents).collect()
    encoded = lambda t: (*library.encode(t or "", add_special_tokens=False).ids, 0)
    copies = Counter((i, encoded(t)) for i, t, *_ in ROWS)  # rows that repeat, and null ids, are packed each
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert set(pieces) == {(i, len(x)) for i, x in copies}
    for (i, ids), n in copies.items():
        own = pieces[i, len(ids)]
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], np.uint32).tobytes()) == r.ids_crc32 for r in own)
        # each copy's pieces follow one another from 0 to its end
        assert Counter(r.start for r in own) + Counter({len(ids): n}) == Counter(r.start + r.length for r in own) + Counter({0: n})
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
    sums = packing.padding(packing.pack(documents)).first()
    assert sums.padded <= 0.05 * sums.tokens
    assert packing.pack(empty).count() == 0


def test_cuts_are_the_least_cost():
    rng = np.random.default_rng(1)
    for _ in range(40):
        at = np.unique(rng.integers(1, 60, 14))
        at = np.unique(np.concatenate([at, np.arange(12, at[-1], 12)]))
        penalty = rng.integers(0, 5, len(at)).astype(float)
        penalty[-1] = 0
        spots, pen = [0, *at.tolist()], [0.0, *penalty]
        waste = lambda n: 0 if n in (16, 32) else 32 - n
        best = [0.0] + [math.inf] * len(at)
        for i in range(1, len(spots)):
            best[i] = min(best[j] + waste(spots[i] - spots[j]) + pen[i] for j in range(i) if spots[i] - spots[j] <= 32)
        cuts = packing.optimal_cuts(at, penalty, 32)
        cost = sum(waste(b - a) + pen[spots.index(b)] for a, b in zip([0, *cuts[:-1]], cuts, strict=True))
        assert cost == pytest.approx(best[-1])


def test_repeats(documents, empty):
    seen = {}
    lists = [words(t) for _, t, *_ in ROWS]
    for n, w in enumerate(lists):
        for s in range(len(w) - 34):
            seen.setdefault(tuple(w[s : s + 35]), []).append((n, s))
    gone = [set() for _ in lists]
    for places in seen.values():
        if len(places) > 1:
            for n, s in places:
                gone[n].update(range(s, s + 35))
    want = Counter((ROWS[n][0], len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for n, (w, g) in enumerate(zip(lists, gone, strict=True)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(documents).collect()) == want
    assert substrings.remove_repeats(empty).count() == 0


def components_of(sets, percent=80):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(n) for n in range(len(sets))]


def test_near_duplicates(documents, empty):
    sets = []
    for _, t, *_ in ROWS:
        w = words(lower(t))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    parts = components_of(sets)
    least = {}
    for p, (i, *_) in zip(parts, ROWS, strict=True):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    want = Counter()
    for p, s, (i, *_) in zip(parts, sets, ROWS, strict=True):
        c = least.get(p) if s else i
        want[i, len(s), c, i == c] += 1
    for block in (256, 16):
        got = neardup.near_duplicates(documents, neardup.Params(shingle=4, block=block)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.without_copies(documents, neardup.Params(shingle=4))
    assert kept.columns == documents.columns
    assert kept.where("doc_id is not null").count() == len({k for k in want if k[3] and k[0] is not None})


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        x = int(c) * (1 + n % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(pii.BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if fine:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_personal_data(spark, documents, empty):
    parts = list("ab@@..--+++  ()019😀é%_\n") + ["4111 1111 1111 1111", "1.2.3.4", "a@b.c", "+1 (555) 555-1234", "@b.c_"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(1500)] + ["1" * 30000, "a" * 30000 + "@"]
    for df, rows in ((spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), list(enumerate(texts))), (documents, [r[:2] for r in ROWS])):
        got = Counter((r.doc_id, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.find_pii(df).collect())
        spans = [(i, base_spans(t or "")) for i, t in rows]
        assert got == Counter((i, hashlib.sha256(s.encode()).hexdigest(), s.count(":") // 2) for i, s in spans)
    assert pii.find_pii(empty).count() == 0
    clean = pii.redact(documents).where("doc_id = 11").first()
    assert clean.text == "mail [EMAIL] card [CARD] ip [IP] call [PHONE] 😀 1.2.3.999" and clean.n_chars == len(clean.text) and clean.raw == "r"


def test_contexts_discover_more(spark):
    rows = [(n, f"{random.choice(VOCABULARY)} reach me at u{n}@mail.example.com today") for n in range(20)] + [(100, "reach me at u77@intranet today")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 100").first()
    assert (found.n_email, found.spans) == (0, "email:12:24")


def plain_bootstrap(rows, boot):
    """Spans of each row (id, text) by the rules of pii, in loops and dicts."""
    import regex

    blank = "[\\x20\\x09-\\x0D]"
    short = lambda t, most: t if len(t) <= most else hashlib.sha256(t.encode()).hexdigest()
    found = []
    for row, (_, text) in enumerate(rows):
        base = [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in base_spans(text or "").split(",") if s)]
        end = 0
        matches = list(regex.finditer(pii.TOKEN, text or ""))
        for n, m in enumerate(matches):
            gap, end = text[end : m.start()], m.end()
            core = regex.sub(r"^[^\p{L}0-9+(]++", "", m[0])
            start = m.start() + len(m[0]) - len(core)
            core = regex.sub(r"(?<![^\p{L}0-9])[^\p{L}0-9]++$", "", core)
            before = regex.sub(r"[\x09-\x0D]", " ", gap.rstrip(" ")).split(" ")[-1].lower()
            following = text[end : matches[n + 1].start() if n + 1 < len(matches) else len(text)]
            after = regex.match(rf"^{blank}*+([^\x20\x09-\x0D]*+)", following)[1].lower()
            plain = regex.sub(r"[^\p{L}0-9]++", "", core)
            runs = regex.sub("[0-9]++", "9", regex.sub(r"\p{L}++", "a", plain))
            shape = "@" if "@" in core else runs if len(plain) > 6 else "short" if runs == "9" else runs
            form = short(regex.sub(r"\p{L}+", "a", regex.sub("[0-9]", "9", core)), 40)
            digits = regex.sub("[^0-9]", "", core)
            failed = bool(regex.search(pii.LINEAR["ip"], core) or regex.search(pii.LINEAR["card"], core) or regex.search(pii.LINEAR["phone"], core) and not 10 <= len(digits) <= 15)
            kind = next((k for a, k, b in base if a < start + len(core) and b > start), None)
            patterns = [(side, f"{w} {shape}") for side, w in (("before", before), ("after", after)) if w] + [("form", form)]
            found.append((row, start, start + len(core), short(core, 120), kind, failed, patterns))
    known, never, edges = {}, set(), set()
    for _, _, _, token, kind, failed, patterns in found:
        edges |= {(token, *p) for p in patterns}
        if kind:
            known[token] = max(kind, known.get(token, ""))
    never = {t for _, _, _, t, _, failed, _ in found if failed} - set(known)
    seeds = set(known)
    total = Counter((side, p) for _, side, p in edges)
    own = Counter((t, side) for t, side, _ in edges)
    while True:
        hits = Counter((side, p, known[t]) for t, side, p in edges if t in known)
        score = {k: n / total[k[0], k[1]] for k, n in hits.items() if n >= boot.least_known and total[k[0], k[1]] >= boot.least_known}
        votes = Counter()
        for t, side, p in edges:
            if t not in known and t not in never:
                for kind in pii.BASE:
                    if score.get((side, p, kind), 0) >= boot.pattern_score:
                        votes[t, side, kind] += score[side, p, kind]
        best = {}
        for (t, side, kind), s in votes.items():
            if s / own[t, side] >= boot.instance_score:
                best[t] = max(best.get(t, (0, "")), (s / own[t, side], kind))
        if not best:
            break
        known |= {t: kind for t, (_, kind) in best.items()}
    out = [[(int(a), list(pii.BASE).index(k), k, int(b)) for k, a, b in (s.split(":") for s in base_spans(t or "").split(",") if s)] for _, t in rows]
    for row, start, stop, token, kind, _, _ in found:
        if kind is None and stop > start and token in known and token not in seeds:
            out[row].append((start, list(pii.BASE).index(known[token]), known[token], stop))
    return [",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(set(x))) for x in out]


def test_spans_equal_plain_bootstrapping(spark):
    random.seed(12)
    lead = ["write at", "mail", "call", "reach me:", "host", "card no", "room", "on the", "see\n", "(about)"]
    ends = ["today", "please.", "soon", "or so", "\nnext", "", "now,"]

    def phrase():
        n = random.randrange(30)
        tokens = [f"u{n}@mail.example.com", f"u{n % 6}@lan", f"+1 (555) 555-12{n:02}", f"(555) 987-65{n % 6:02}", f"10.0.0.{n}", f"10.0.0.{n % 6}9{n % 6}", f"4111 1111 1111 11{n:02}", "4111 1111 1111 1111", f"{n}", f"x{n}-{n}", "a@b", f"<{n}@q>"]
        k = random.randrange(len(tokens))
        usual = ["write at", "write at", "call", "call", "host", "host", "card no", "card no", "room", "room", "mail", "mail"][k]
        return f"{usual if random.random() < 0.9 else random.choice(lead)} {tokens[k]} {random.choice(ends)}"

    rows = [(i, " ".join(phrase() for _ in range(random.randint(0, 4)))) for i in range(300)] + [(300, None), (301, ""), (302, "k" * 200 + "@lan")]
    boot = pii.Bootstrap()
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), boot).collect()}
    want = plain_bootstrap(rows, boot)
    assert [got[i] for i, _ in rows] == want
    assert sum(w != base_spans(t or "") for w, (_, t) in zip(want, rows, strict=True)) > 10  # the method finds more


def test_contexts_discover_other_forms(spark):
    """Planted identifiers that base cannot match, by the word before or after; failed candidates and numbers elsewhere stay."""
    rows = [(n, f"write at u{n}@mail.example.com today {n} or call +1 (555) 555-12{n:02} now") for n in range(20)]
    planted = {100: ("write at u77@intranet please", "u77@intranet", "email"), 101: ("then call (555) 987-6543 soon", "(555) 987-6543", "phone"), 102: ("or a@b today", "a@b", "email")}
    rows += [(i, text) for i, (text, _, _) in planted.items()] + [(200, "call 4111 1111 1111 1112 soon"), (201, "room 12 on 4 May"), (202, "+1 (826) 555-4081 190.137.223.9")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, word, kind) in planted.items():
        assert got[i] == f"{kind}:{text.index(word)}:{text.index(word) + len(word)}"
    assert got[200] == got[201] == ""
    assert got[202] == "phone:0:17,ip:18:31"


def test_long_tokens_with_one_prefix_stay_apart(spark):
    rows = [(n, f"write at u{n}@mail.example.com today") for n in range(20)]
    long = "k" * 130
    rows += [(100, f"write at {long}@a please"), (101, f"room {long}@b on")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[100], got[101]) == ("email:9:141", "")


def test_reordered_passages_are_found(spark, documents):
    item = " ".join(f"t{n}" for n in range(40))
    pieces = [" ".join(f"T{n}," for n in range(k, k + 8)) for k in range(0, 40, 8)]
    random.shuffle(pieces)
    docs = spark.createDataFrame([(1, "x y z " + " foo ".join(pieces)), (2, "t1 t2 t3 t4 t5 nothing"), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, "t1 t2"), (7, None)], "item_id long, text string")
    for params in (decontamination.Params(), decontamination.Params(most_sent=1)):
        got = decontamination.matches(docs, bench, params).collect()
        assert [(r.doc_id, r.item_id, r.coverage) for r in got] == [(1, 5, 1.0)]
    assert {r.doc_id for r in decontamination.without_matches(docs, bench).collect()} == {2, 3, 4}
    assert decontamination.without_matches(documents, bench).columns == documents.columns
    assert decontamination.matches(docs, bench.limit(0)).count() == 0


def plain_tiles(doc, item, least):
    """Greedy string tiling by the definition: the longest free match, first in doc and then in item, again and again."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    for n in range(min(len(doc), len(item)), least - 1, -1):
        for p in range(len(doc) - n + 1):
            for q in range(len(item) - n + 1) if all(free_doc[p : p + n]) else ():
                if all(free_item[q : q + n]) and doc[p : p + n] == item[q : q + n]:
                    free_doc[p : p + n], free_item[q : q + n] = [False] * n, [False] * n
                    out.append((p, q, n))
                    break
    return out


def plain_matches(docs, bench, params=decontamination.Params()):  # noqa: B008
    """(doc_id, item_id, coverage, tiles) of rows (id, text) and items, in loops."""
    found = []
    items = {(i, t): re.findall(r"[^\W_]+", (t or "").lower()) for i, t in bench}
    for d, text in docs:
        ws = re.findall(r"[^\W_]+", (text or "").lower())
        for (i, _), item in items.items():
            seeds = {tuple(item[k : k + params.seed]) for k in range(len(item) - params.seed + 1)}
            if seeds & {tuple(ws[k : k + params.seed]) for k in range(len(ws) - params.seed + 1)}:
                tiles = plain_tiles(ws, item, params.least)
                if (share := sum(n for *_, n in tiles) / len(item)) >= params.coverage:
                    found.append((d, i, round(share, 9), tuple(sorted(tiles))))
    return Counter(found)


def test_matches_equal_plain_tiling(spark):
    random.seed(21)
    item = lambda n: [random.choice(VOCABULARY[:40]) for _ in range(n)]
    bench = [(k, " ".join(item(random.randint(3, 30)))) for k in range(15)] + [(99, None), (98, ""), (97, "w1 w2"), (3, "other text of the same id w1 w2 w3")]
    bench.append(bench[0])
    docs = []
    for n in range(60):
        text = item(random.randint(0, 25))
        for _ in range(random.randint(0, 3)):
            taken = random.choice(bench[:15])[1].split()
            low = random.randrange(len(taken))
            at = random.randrange(len(text) + 1)
            text[at:at] = taken[low : low + random.randint(4, 30)]
        docs.append((n, ", ".join(text).upper() if n % 2 else " ".join(text)))
    docs += [(60, None), (61, ""), (62, "w1 " * 3000), (None, bench[1][1]), docs[5], docs[5], (63, bench[2][1] + " filler" * 5000)]
    df = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, item_text string, coverage double").repartition(3)
    items = spark.createDataFrame([(*b, 5) for b in bench], "item_id long, text string, number long")
    want = plain_matches(docs, bench)
    assert len(want) > 10 and (None, 1, 1.0) in {k[:3] for k in want}
    for params in (decontamination.Params(), decontamination.Params(most_sent=1)):
        got = decontamination.matches(df, items, params).collect()
        assert Counter((r.doc_id, r.item_id, round(r.coverage, 9), tuple(sorted((t.doc_word, t.item_word, t.length) for t in r.tiles))) for r in got) == want
    hit = {text for d, text in docs if any(k[0] == d for k in want)}
    kept = decontamination.without_matches(df, items)
    assert kept.columns == df.columns and Counter(r.text for r in kept.collect()) == Counter(t for _, t in docs if t not in hit)
    assert decontamination.without_matches(df.limit(0), items).count() == 0


def test_tiling_takes_near_linear_time():
    rng = np.random.default_rng(1)
    for text in (rng.integers(1, 1 << 60, 20_000, np.uint64), np.ones(20_000, np.uint64), np.tile(np.arange(1, 8, dtype=np.uint64), 3000)):
        began = time.process_time()
        assert decontamination.tile(text, text, 4) == [(0, 0, len(text))]
        assert time.process_time() - began < 2


def test_tiles_are_greedy_and_do_not_overlap():
    a, b = np.array([1, 2, 3, 4, 5, 9, 3, 4, 5, 6], np.uint64), np.array([3, 4, 5, 6, 1, 2, 3], np.uint64)
    assert sorted(decontamination.tile(a, b, 3)) == [(0, 4, 3), (6, 0, 4)]
    assert decontamination.tile(a[:2], b, 3) == []


def test_page_text(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article class='post'><h1>A &amp; B</h1><p>First  <b>bold</b> text of the page.<br>More of it is here.<p>Second paragraph, unclosed but long enough.</p><script>var a='</p>';</script><div class='comments'><p>Nice post, thanks for it.</p></div></article><footer>&copy; site</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<p"), (5, "u", "just < text & more")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].text == "A & B First bold text of the page. More of it is here. Second paragraph, unclosed but long enough."
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" == got[3].text
    assert html.extract(df.limit(0)).count() == 0


def test_text_of_held_out_layouts(spark):
    """Words of content that are found, and words found that are content, on pages that the model has not seen."""
    layouts = html.Layouts(1234)
    pages = [layouts.page() for _ in range(150)]
    want = []
    for source in pages:
        page = html.parse(source)
        want.append(" ".join(t for node, t in page.texts if page.labels[node]))
    bare = [re.sub(r' data-kept="[01]"', "", p) for p in pages]
    rows = [(n, f"u{n}", p, "t", 1) for n, p in enumerate(bare)] + [(7, "u7", bare[7], "t", 1), (None, None, bare[8], "t", 1), (900, "u", None, "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").repartition(2)
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    text = {r.page_id: r.text for r in found}
    assert sum(r.page_id == 7 and r.text == text[7] for r in found) == 2 and text[None] == text[8]
    shared = sum((Counter(text[n].split()) & Counter(w.split())).total() for n, w in enumerate(want))
    wanted, all_ = (sum(len(x.split()) for x in xs) for xs in (want, [text[n] for n in range(150)]))
    print("recall and precision of words:", shared / wanted, shared / all_)
    assert shared / wanted > 0.97 and shared / all_ > 0.97


def test_broken_pages_take_linear_time():
    model = html.default_model(60)
    for source in ("<a " * 350_000, "<form></section>" * 62_500, '<a "" ' * 160_000 + '">"', "<form>" * 50_000 + "<li></li>" * 60_000, "<head>" * 160_000, "<div>" * 200_000):
        began = time.process_time()
        page = html.parse(source)
        model.texts([page])
        assert time.process_time() - began < 15  # seconds for a megabyte, on a busy machine; quadratic would be minutes
    deep = html.parse("<div>" * 2000 + "<p>in the depth</p>")
    assert [t for _, t in deep.texts] == ["in the depth"] and len(deep.parent) == 2002


def test_messages_give_exact_marginals():
    layouts = html.Layouts(3)
    model = html.default_model(60)
    page = html.parse("<div><p>one two three.</p><ul><li><a href=x>a</a></li></ul></div><p>x</p>")
    forest = html.Forest.of([page], model.numbers)
    content, _ = forest.marginals(model.weights, model.pairs)
    n = len(page.tags)
    own = np.bincount(forest.node, model.weights[forest.feature], n)
    total = np.zeros(2**n)
    for k in range(2**n):
        y = [(k >> i) & 1 for i in range(n)]
        total[k] = sum(own[i] * y[i] for i in range(n)) + sum(model.pairs[forest.edge[i], y[page.parent[i]], y[i]] for i in range(1, n))
    p = np.exp(total - total.max())
    p /= p.sum()
    want = [sum(p[k] for k in range(2**n) if (k >> i) & 1) for i in range(n)]
    assert np.allclose(content, want)
    held = [html.parse(layouts.page()) for _ in range(60)]
    got, _ = html.Forest.of(held, model.numbers).marginals(model.weights, model.pairs)
    at, right, all_ = 0, 0, 0
    for q in held:
        for node, _ in q.texts:
            right += (got[at + node] >= 0.5) == q.labels[node]
            all_ += 1
        at += len(q.parent)
    assert right / all_ > 0.95


def test_text_of_pages_that_mark_it(spark, sf):
    """Every given page has one article: its text by the standard library's parser, block by block."""
    from html.parser import HTMLParser

    from tidelog.llm.queries import ORACLES, op7_html

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.parts = 0, []

        def handle_starttag(self, tag, attributes):
            self.inside += tag == "article"
            self.parts += [" "] * (tag != "b")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.parts += [" "] * (tag != "b")

        def handle_data(self, text):
            self.parts += [text] * (self.inside > 0)

    pages = f"{sf}/pages.parquet"
    got = {r.page_id: r.text for r in op7_html(spark, sf).collect()}
    for r in spark.read.parquet(pages).collect():
        plain = Article()
        plain.feed(r.html)
        plain.close()
        assert got[r.page_id] == " ".join("".join(plain.parts).split())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{pages}'")
    assert sorted(got.items()) == sorted((r[0], r[2]) for r in con.sql(f"select page_id, url, text from ({ORACLES['op7_html']})").fetchall())


def test_first_rows_by_hash(spark):
    df = spark.range(5000).union(spark.range(5000)).select(F.xxhash64("id").alias("k"), "id").repartition(5)
    keys = sorted({r.k for r in df.collect()})
    assert [r.k for r in common.first_by_hash(df, "k", 100, 10_000).collect()] == keys[:100]
    assert [r.k for r in common.first_by_hash(df, "k", 9000, 10_000).collect()] == keys and common.first_by_hash(df.limit(0), "k", 3, 0).count() == 0


def test_pages_label_themselves(spark):
    page = html.marked(html.parse("<div>x<article><h1>t</h1><aside><p>a</p></aside><p>b<form>f</form></article></div><p>c"))
    assert list(zip(page.tags, page.labels, strict=True)) == [("html", 0), ("div", 0), ("article", 1), ("h1", 1), ("aside", 0), ("p", 0), ("p", 1), ("form", 0), ("p", 0)]
    assert html.marked(html.parse("<article>a</article><article>b</article>")) is None and html.marked(html.parse("<p>")) is None
    # the model learns the words of a site's own boxes from pages that say where their text is
    body = "<p>One sentence follows another here. So does a third one.</p>"
    rows = [(n, f"u{n}", f'<div class="zork"><p>{n} people like this page. So do you, we hope.</p></div><article>{body * (1 + n % 5)}</article>') for n in range(60)]
    pages = spark.createDataFrame([*rows, (None, None, None), (99, "u", "")], "page_id long, url string, html string")
    plain = spark.createDataFrame([(0, "u", f'<div class="zork"><p>4 people like this page. So do you, we hope.</p></div><div>{body * 3}</div>')], "page_id long, url string, html string")
    assert "people like" not in html.extract(plain, html.fit(pages, layouts=100)).first().text
    assert html.fit(pages.limit(0), layouts=5).weights.shape == html.train([html.parse(q) for q in [html.Layouts(7)] for q in [q.page() for _ in range(5)]]).weights.shape


def test_language_model(documents, empty):
    params = lm.Params(head_rate=0, least_head=40, endings=8, sent=50)
    model = lm.fit(documents, params)
    got = lm.score(documents, params, model=model).collect()
    lists = [(i, lower(t).encode().split() + [b""]) for i, t, *_ in ROWS]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in lists if not out(i) for w in ws)
    total, v = sum(c.values()), len(c)
    want = Counter((i, out(i), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in lists)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert lm.score(empty).count() == 0

    # the model's own probability, token by token from its parameters
    units, net = model.units, model.network
    assert len(units.head) == 40 and units.head[b""] >= 0 and 1 < len(net.starts) <= 7
    unit = lambda w: units.head.get(w, units.endings.get(w[-2:], units.other))
    group = {}
    for w, n in c.items():
        if w not in units.head:
            a, b = group.get(unit(w), (0, 0))
            group[unit(w)] = (a + n, b + 1)

    def log10_of(ws):
        sum_, before = 0.0, [units.head[b""]] * params.context
        for w in ws:
            u, h = unit(w), sum(net.r[x].astype(float) * net.c[k] for k, x in enumerate(reversed(before[-params.context :])))
            k = net.of_class[u]
            classes, inner = net.p @ h + net.a, (net.q @ h + net.b)[net.starts[k] : net.ends[k]]
            sum_ += (classes[k] - np.logaddexp.reduce(classes) + inner[u - net.starts[k]] - np.logaddexp.reduce(inner)) / math.log(10)
            if w not in units.head:
                n, m = group.get(u, (0, 0))
                sum_ += math.log10((c[w] + 0.5) / (n + 0.5 * (m + 1)))
            before.append(u)
        return sum_

    texts = [(i, len(ws), log10_of(ws)) for i, ws in lists]
    assert sorted((r.doc_id or -1, r.n_tokens, r.score) for r in got) == [pytest.approx(x, rel=1e-4, abs=1e-3) for x in sorted((i or -1, n, s) for i, n, s in texts)]


def test_words_are_looked_up_once(spark):
    texts = [None, b"", b" \t ", b" A\x0bb\x0cB c\r\n", b"\xc3\x84 X\x1cY \x85q", b"abc", b"x\x00Y z"]
    for raw in (pa.array(texts, pa.binary()), pa.array(texts, pa.large_binary()).slice(2), pa.array([], pa.binary()), pa.array([b"b A", b"a"], pa.binary())):
        distinct, code, lengths = lm.tokens_of(raw)
        lists = [(t or b"").lower().split() + [b""] for t in raw.to_pylist()]
        assert [distinct[k].as_py() for k in code.tolist()] == [w for x in lists for w in x] and lengths.tolist() == [len(x) for x in lists]
    distinct, code, _ = lm.tokens_of(pa.array([b"one Two three " * 50_000] * 2, pa.binary()))
    assert len(distinct) == 4 and len(code) == 300_002
    # units come for whole arrays of distinct words
    units = lm.Units.of_counts({b"": 9, b"one": 5}, {b"wo": 3, b"x": 1}, 2)
    assert units.of(distinct).tolist() == [units.head[b"one"], units.endings[b"wo"], units.other, units.head[b""]]
    assert units.of(pa.array([b"x", b"ax"], pa.binary())).tolist() == [units.endings[b"x"], units.other]
    assert lm.spans(pa.array([b"a" * 9, None, b"b" * 25, b"", b"c"], pa.binary()), 10) == [(0, 2), (2, 5)] and lm.spans(pa.array([], pa.binary()), 10) == []


def test_scores_do_not_depend_on_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    params = lm.Params(part_root=50)
    one, many = ({r.doc_id: r.score for r in lm.score(d, params).collect()} for d in (docs.coalesce(1), docs.orderBy(F.desc("doc_id")).repartition(7)))
    assert one == pytest.approx(many, rel=1e-5)


def test_parts_are_averaged_level_by_level(spark):
    values = np.arange(9, dtype=np.float32)
    rows = [(t, p, (values + t + p).tobytes(), t + 1) for t in range(11) for p in range(2)]
    got = lm.averaged(spark.createDataFrame(rows, lm.PART).repartition(3), 11, 3).orderBy("part").collect()
    for p, r in enumerate(got):
        want = sum((values + t + p) * (t + 1) for t in range(11)) / 66
        assert r.part == p and r.n == 66 and np.frombuffer(r.part_values, np.float32) == pytest.approx(want, rel=1e-5)
    assert len(got) == 2


def test_long_words_stay_off_the_driver(spark):
    rows = [(n, "common words " * 5 + chr(97 + n % 7) * 200_000) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs)
    assert max(map(len, model.units.head)) <= 128 and sum(n for n, _ in model.groups.values()) + sum(r.c for r in model.counts.collect() if bytes(r.word) in model.units.head) == model.total
    assert max(len(r.word) for r in lm.most_frequent(model.counts, 1000, 128).collect()) <= 128
    out = {r.doc_id: r for r in lm.score(docs, model=model).collect()}
    assert len(out) == 40 and {r.n_tokens for r in out.values()} == {12} and all(math.isfinite(r.score) for r in out.values())
    train = [ws for n, ws in ((n, t.encode().split() + [b""]) for n, t in rows) if zlib.crc32(str(n).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    for n, t in rows:
        assert out[n].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (model.total + 0.5 * (len(c) + 1))) for w in t.encode().split() + [b""]))


def test_model_beats_the_base_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    r = lm.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    print("log10 a held-out token:", r.s / r.n, "base:", r.b / r.n)
    assert r.s > r.b


def test_model_probabilities_are_normalised():
    params = lm.Params(size=4, context=2)
    frequency = np.array([0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])
    net = lm.Network(frequency, np.array([0, 1, 3]), params)
    rng = np.random.default_rng(0)
    net.values[:] = rng.standard_normal(len(net.values))
    sequence = np.array([0, 0, 3, 1, 4, 0], np.int32)
    total = 0
    for u in range(7):
        s = sequence.copy()
        s[3] = u
        total += np.exp(net.scores(s, np.array([2, 3]))[1])
    assert total == pytest.approx(1, abs=1e-5)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    sequence = np.concatenate([[0, 0], np.tile([0, 1, 2, 3, 4, 5, 6], 600)]).astype(np.int32)
    net = lm.Network(np.full(7, 1 / 7), np.array([0, 1, 4]), lm.Params(size=8, context=2))
    at = np.arange(2, len(sequence))
    before = net.scores(sequence, at).mean()
    for _ in range(20):
        net.learn(sequence, at, rng, 256)
    assert net.scores(sequence, at).mean() > before / 4


def exact_recall(got, y, asked, k):
    """Share of the true k nearest that were found; ranks, order, scores and counts are checked on the way."""
    found, hit, all_ = {}, 0, 0
    for r in got:
        found.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(y[r.query_id] @ y[r.vec_id]), abs=1e-9)
    for q in asked:
        s = y @ y[q]
        order = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:k]
        mine = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(order) + 1))
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id)) and q not in {r.vec_id for r in mine}
        hit += len({r.vec_id for r in mine} & set(order))
        all_ += len(order)
    return hit / all_


VECTORS = "vec_id long, embedding array<float>, rank int, score double"


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 24)) * rng.uniform(0.5, 2, (900, 1))
    x[7] = x[8]
    rows = [(n, v.astype(np.float32).tolist(), 0, 0.0) for n, v in enumerate(x)] + [(900, None, 0, 0.0), (901, [0.0] * 24, 0, 0.0), (902, [float("nan")] + [1.0] * 23, 0, 0.0), (903, [1.0] * 5, 0, 0.0), (None, [1.0] * 24, 0, 0.0)]
    df = spark.createDataFrame(rows, VECTORS)
    y = np.array([r[1] for r in rows[:900]], np.float32).astype(float)
    assert ann.fit(ann.usable(df)).found > 0.5  # without structure no bucket index is selective
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 10, row_block=256, query_block=16).collect()
    assert exact_recall(got, y, range(0, 900, 20), 10) >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 8 or vec_id = 900")
    assert exact_recall(ann.nearest(few, few.where("vec_id % 4 = 0"), 10).collect(), y[:8], (0, 4), 10) == 1


def test_neighbours_by_probes(spark):
    """Vectors in tight groups: the fit finds the index selective, and probes in a join find what blocks find."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((60, 32)), 15, axis=0) + 0.02 * rng.standard_normal((900, 32))
    x[899] = rng.standard_normal(32)  # on its own: it has too few codes within the radius
    x[880] = x[881]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(n, v.astype(np.float32).tolist(), 0, 0.0) for n, v in enumerate(x)] + [(5, x[5].astype(np.float32).tolist(), 0, 0.0)], VECTORS)
    y = np.array(x, np.float32).astype(float)
    codes = ann.fit(ann.usable(df), neighbours=10)
    print("share that probes find", codes.found)
    assert codes.found <= 0.05
    asked = df.where("vec_id % 20 = 0 or vec_id = 899")
    got = ann.nearest(df.where("vec_id != 5"), asked, 10, codes=codes, selective=0.05).collect()
    want = ann.nearest(df.where("vec_id != 5"), asked, 10, codes=codes, selective=0.0).collect()
    key = lambda r: (r.query_id, r.rank, r.vec_id)
    assert sorted(map(key, got)) == sorted(map(key, want))
    twice = ann.nearest(df, df.where("vec_id = 0"), 14, codes=codes, selective=0.05).collect()
    assert [r.vec_id for r in twice].count(5) == 2


def test_recall_on_the_driver_tables(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    y = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    share = exact_recall(ann.nearest(df, df.where("vec_id % 20 = 0")).collect(), y, range(0, len(y), 20), 20)
    print("recall at sf0.1", share)
    assert share >= 0.9


def test_probes_find_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    codes = ann.Codes(np.zeros((64, 1)), 20, 1)
    rows, asked = rng.integers(0, 1 << 16, (700, 4), np.uint16), rng.integers(0, 1 << 16, (50, 4), np.uint16)
    near = ann.apart(asked, rows) <= 20
    assert near.any() and not (near & ~ann.probed(asked, rows, codes.reach())).any()


def test_grades_equal_plain_sums(spark):
    """Grades from the model's weights in loops, on awkward rows; the fit is blind to rows without a label."""
    random.seed(30)
    texts = [(n, " ".join(random.choices(VOCABULARY[:60], k=30)) + (" foul fouled vile" if n % 4 == 0 else "")) for n in range(200)]
    docs = spark.createDataFrame([(*t, "x", True) for t in texts] + [(4, "foul again", "x", True)], "doc_id long, text string, words string, toxic boolean")
    labels = spark.createDataFrame([(n, 1, int(n % 4 == 0)) for n in range(200)] + [(None, 1, 1), (5, 1, None), (6, 0, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.weights["foul"] > 0 and list(model.thresholds) == sorted(model.thresholds)
    rows = [*texts, (300, None), (301, ""), (302, "Foul, FOUL! vile1 x" + " w1" * 20000), texts[4], texts[4], (None, "so foul vile fouled")]
    df = spark.createDataFrame([(*r, 9, 9.0, "s", 1) for r in rows], "doc_id long, text string, toxicity_grade int, toxicity double, toxic string, _tidelog long").repartition(3)
    got = Counter((r.doc_id, round(r.toxicity, 6), r.toxicity_grade, r.toxic, r._tidelog) for r in toxicity.grade(df, model).collect())
    want = Counter()
    for i, t in rows:
        counts = Counter(f for w in set(re.findall(r"[^\W\d_]+", (t or "").lower())) for f in [w, *(w[:k] + "*" for k in (4, 5) if len(w) > k)])
        score = sum(model.weights.get(f, 0.0) * math.log1p(c) for f, c in counts.items())
        above = [1 / (1 + math.exp(k - score)) for k in model.thresholds]
        want[i, round(sum(above), 6), sum(p >= 0.5 for p in above), above[0] >= 0.5, 1] += 1
    assert got == want
    assert toxicity.grade(df.limit(0), model).count() == 0
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(n for k, n in want.items() if not k[3])
    nobody = toxicity.fit(docs.limit(0), labels)
    assert not nobody.weights and toxicity.without_toxic(df, nobody).count() == len(rows)


def test_toxicity(spark, sf):
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    big = sf.replace("0.001", "0.1")
    model = toxicity.fit(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"), 3000)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = toxicity.grade(texts, model).drop("quality").join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    wrong = sum(r.toxic != bool(r.label) for r in out)
    assert wrong <= 0.03 * len(out)
    awkward = spark.createDataFrame([(1, None, 9), (2, "", 9)], "doc_id long, text string, toxicity long")
    assert not any(r.toxic for r in toxicity.grade(awkward, model).collect())
    assert toxicity.without_toxic(awkward, model).where("toxicity = 9").count() == 2
    nothing = toxicity.fit(texts, labels.limit(0))
    assert toxicity.grade(texts, nothing).where("toxic").count() == 0


CLASHING = "toxicity string, kept string, component_id string, number string, spans string, row_key string, words string, code string"


def test_pipeline_stages_on_awkward_rows(spark, sf):
    """Each stage against a plain version, on null, empty, long and repeated rows, null ids and columns of the operators' own names."""
    import corpus_pipeline as pipeline

    stage = dict(pipeline.STAGES)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").orderBy("item_id").first().text
    rows = [*[r[:2] for r in ROWS], (1000, item), (1001, f"before. {item} after"), (1002, "long " * 20000 + "end"), (1002, "long " * 20000 + "end"), (None, "of no id"), (1003, "call bob.x@mail.example.com")]
    extra = tuple("x" * (CLASHING.count(",") + 1))
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3).cache()

    kept = stage["toxicity"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == len(rows)  # none is labelled, so none is rejected

    kept = stage["near duplicates"](spark, docs, sf)
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    groups = {}
    for part, (i, t), s in zip(components_of(sets), rows, sets, strict=True):
        groups.setdefault(("group", part) if s else ("row", i, t), []).append((i is None, i or 0, t or ""))
    want = Counter(min(g)[:2] for g in groups.values())
    assert kept.columns == docs.columns and Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want

    kept = stage["decontamination"](spark, docs, sf)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, *_ in plain_matches([r for r in rows if len(r[1] or "") < 5000], bench)}
    assert {1000, 1001} <= leaks
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in leaks)

    kept = stage["personal data"](spark, docs, sf)
    assert kept.columns == docs.columns
    want = Counter()
    for (i, t), spans in zip(rows, plain_bootstrap(rows, pii.Bootstrap()), strict=True):
        clean, end = "", 0
        for kind, a, b in (s.split(":") for s in spans.split(",") if s):
            if int(a) >= end:
                clean, end = clean + t[end : int(a)] + f"[{kind.upper()}]", int(b)
        clean = t if t is None else clean + t[end:]
        want[i, clean, len(clean or "")] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == want

    pieces = stage["packing"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in rows)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)

    none = docs.limit(0)
    for name, run in pipeline.STAGES:
        out = run(spark, none, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def test_rows_that_repeat_take_linear_time(spark):
    """op5 on one long row, repeated: all of its words go, and twice the rows take about twice the time."""
    text = " ".join(f"word{n}" for n in range(400))
    seconds = []
    for n in (500, 2000, 4000):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string").crossJoin(spark.range(n)).select("doc_id", "text").repartition(4)
        began = time.time()
        got = substrings.remove_repeats(df).groupBy("n_words", "n_removed", F.size("spans").alias("spans")).count().collect()
        seconds.append(time.time() - began)
        assert [tuple(r) for r in got] == [(400, 400, 1, n)]
    print("seconds for 500, 2000 and 4000 rows:", seconds)
    assert seconds[2] < 2 * seconds[1] + 5


def test_maximal_spans_end_at_branches():
    first, count, through = np.array([30, 0, 10, 22]), np.array([5, 10, 12, 8]), np.array([True, True, False, True])
    a, n = substrings.compacted(first, count, through)
    assert (a.tolist(), n.tolist()) == ([0, 22], [22, 13])


def test_stages_send_small_batches(spark, sf):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(n, "x" * 900_000) for n in range(12)], "doc_id long, text string").coalesce(1)
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, docs.limit(0), sf)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
        assert max(r.n for r in sizes) < 4_000_000
    spark.conf.unset(key)


def test_pieces_are_forgotten():
    own = packing.encoder(packing.vocabulary_path("byte_bpe_50k.json"))
    before = own.encode(["some words of a text", None])
    assert own.slots > 1
    own.forget()
    assert own.slots == 1 and len(own.known) == 1
    assert all(np.array_equal(x, y) for x, y in zip(before, own.encode(["some words of a text", None]), strict=True))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0.6 * n < out.count() <= n
    pieces = corpus_pipeline.run(spark, sf)
    whole = pieces.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert whole.where("n != doc_tokens").count() == 0
    assert whole.count() < n
