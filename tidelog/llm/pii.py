"""Personal data by fixed patterns, and by contexts that those patterns' finds induce. Native Spark only.

Base: four regular expressions, leftmost and non-overlapping by kind, then checked (ranges, Luhn,
digits). They are written with look-behinds and possessive parts, so that a long run of digits or
letters costs linear time; the matches are those of the plain forms in BASE.

Bootstrapping: instances are the blank-separated tokens with a digit or an @, and runs of numbers as
one. Patterns are the word before or the word after with a coarse shape, and the form alone. A round scores patterns by the
share of their distinct instances that are known to be of a kind (base finds at first; candidates that
failed the checks stay unknown for good, so they lower it), then instances by what the confident ones
among their patterns of one side say, over all patterns of that side. Confident instances become known,
until no more do. Instances known in the end that no base find covers are added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpointed, fresh

#: Kinds in their fixed order, with the plain patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in linear time; of card, those of 14 digits or more.
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A number's group ends before a blank or the end, punctuation aside.
GROUP = r"[0-9][0-9()/-]*+(?=[,.;:!?]*+(?![^\x20\x09-\x0D]))"
TOKEN = rf"(?<![^\x20\x09-\x0D])(?:[+(]*+{GROUP}(?:\x20[(]?+{GROUP})++[,.;:!?]*+|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: Code points of the blocks that redacted texts are cut from.
BLOCK = 4096
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


@dataclass(frozen=True)
class Bootstrap:
    least_known: int = 3
    pattern_score: float = 0.6
    instance_score: float = 0.6


def luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


#: Elements that folded() appends one by one.
CHUNK = 128


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(items: Column, state: Column, step, held: str, kind: str) -> Column:
    """array<kind> of what step(state, item) puts out, as it goes through items. step gives (next state, output).

    An array that grows by one element is copied each time. So items are gone through in chunks, first for the
    states (of type held) that the chunks begin with, then for what each chunk puts out.
    """
    last = lambda all_: F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / CHUNK).cast("int")
    cut = lambda all_: F.transform(F.sequence(F.lit(0), last(all_)), lambda n: F.slice(all_, n * CHUNK + 1, F.lit(CHUNK)))

    def one(acc: Column, item: Column) -> Column:
        after, out = step(acc["s"], item)
        return F.struct(after.alias("s"), F.concat(acc["out"], F.array(out)).alias("out"))

    def chunk(acc: Column, own: Column) -> Column:
        return F.struct(F.aggregate(own, acc["s"], lambda s, item: step(s, item)[0]).alias("s"), F.concat(acc["all"], F.array(acc["s"])).alias("all"))

    def outputs(own: Column, s: Column) -> Column:
        return F.aggregate(own, F.struct(s.alias("s"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda acc: acc["out"])

    def run(chunks: Column) -> Column:
        starts = F.aggregate(chunks, F.struct(state.alias("s"), F.array().cast(f"array<{held}>").alias("all")), chunk, lambda acc: acc["all"])
        return F.flatten(F.zip_with(chunks, starts, outputs))

    return let(let(items, cut), run)


def located(text: Column, pattern: str, keep, made) -> Column:
    """made(start, stop, match, gap before) of the matches that keep(match) holds for, in order.

    Positions are code points; they come from the lengths of the parts between matches.
    """
    m, g = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.transform(F.arrays_zip(m.alias("m"), g.alias("g")), lambda p: F.struct(F.length(p["g"]).alias("g"), F.coalesce(F.length(p["m"]), F.lit(0)).alias("m")))
    begins = folded(sizes, F.lit(0).cast("bigint"), lambda at, p: (at + p["g"] + p["m"], at + p["g"]), "bigint", "bigint")
    found = F.filter(F.arrays_zip(m.alias("m"), g.alias("g"), begins.alias("at")), lambda p: p["m"].isNotNull() & keep(p["m"]))
    return F.transform(found, lambda p: made(p["at"], p["at"] + F.length(p["m"]), p["m"], p["g"]))


def covered(found: Column, base: Column) -> Column:
    """The kind of the first base span that overlaps each of found, or null; both are in order of start.

    One pass forward over both holds the spans that are still open (of each kind one at most), one backward the next span.
    """
    spans = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("side"), s["rank"].alias("order"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    asked = F.transform(found, lambda f, n: F.struct(f["start"].alias("start"), F.lit(1).alias("side"), n.alias("order"), f["stop"].alias("stop"), F.lit(None).cast("string").alias("kind")))
    event = "struct<start:bigint,side:int,order:int,stop:bigint,kind:string>"
    events = F.array_sort(F.concat(spans, asked).cast(f"array<{event}>"))

    def forward(open_: Column, e: Column) -> tuple[Column, Column]:
        still = F.filter(open_, lambda s: s["stop"] > e["start"])
        return F.when(e["side"] == 0, F.concat(still, F.array(e))).otherwise(still), e.withField("kind", F.when(e["side"] == 0, e["kind"]).otherwise(F.get(still, F.lit(0))["kind"]))

    def backward(next_: Column, e: Column) -> tuple[Column, Column]:
        ahead = F.when(next_["start"] < e["stop"], next_["kind"])
        return F.when(e["side"] == 0, e).otherwise(next_), F.struct(e["side"].alias("side"), F.coalesce(e["kind"], ahead).alias("kind"))

    passed = F.reverse(folded(events, F.array().cast(f"array<{event}>"), forward, f"array<{event}>", event))
    both = F.reverse(folded(passed, F.lit(None).cast(event), backward, event, "struct<side:int,kind:string>"))
    return F.transform(F.filter(both, lambda e: e["side"] == 1), lambda e: e["kind"])


def base_spans(text: Column) -> Column:
    """All valid base matches as SPAN, by start and then kind."""
    each = []
    for rank, kind in enumerate(BASE):
        seen = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike(LINEAR[kind])

        def made(begin: Column, stop: Column, match: Column, gap: Column, rank: int = rank, kind: str = kind) -> Column:
            return F.struct(begin.cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.cast("bigint").alias("stop"))

        found = located(text, LINEAR[kind], lambda m, kind=kind: valid(kind, m), made)
        each.append(F.when(seen, found).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*each))


def short(text: Column, most: int) -> Column:
    """A key of the whole text: itself, or its digest where it is longer."""
    return F.when(F.length(text) <= most, text).otherwise(F.sha2(text, 256))


def shape(token: Column) -> Column:
    """@ where there is one; else the runs of letters (a) and digits (9), with short for up to 6 digits alone."""
    plain = F.regexp_replace(token, r"[^\p{L}0-9]++", "")
    runs = F.regexp_replace(F.regexp_replace(plain, r"\p{L}++", "a"), "[0-9]++", "9")
    return F.when(token.contains("@"), "@").when(F.length(plain) > 6, runs).otherwise(F.when(runs == "9", "short").otherwise(runs))


def form(token: Column) -> Column:
    """A token with each digit as 9 and runs of letters as a."""
    return short(F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), r"\p{L}+", "a"), 40)


def instances(text: Column) -> Column:
    """Tokens with a digit or @: position, token without outer punctuation, words before and after, shape, form, and
    whether it holds a candidate of a base pattern (which failed, where no base find covers it)."""

    def made(begin: Column, stop: Column, match: Column, gap: Column) -> Column:
        lead = F.length(match) - F.length(F.regexp_replace(match, r"^[^\p{L}0-9+(]++", ""))
        core = F.regexp_replace(F.regexp_replace(match, r"^[^\p{L}0-9+(]++", ""), r"(?<![^\p{L}0-9])[^\p{L}0-9]++$", "")
        before = F.lower(F.substring_index(F.regexp_replace(F.rtrim(gap), r"[\x09-\x0D]", " "), " ", -1))
        first = begin + lead
        failed = core.rlike(LINEAR["ip"]) | core.rlike(LINEAR["card"]) | core.rlike(LINEAR["phone"]) & ~valid("phone", core)
        return F.struct(first.cast("bigint").alias("start"), (first + F.length(core)).cast("bigint").alias("stop"), short(core, 120).alias("token"), before.alias("before"), shape(core).alias("shape"), form(core).alias("form"), failed.alias("failed"))

    whole = "array<struct<start:bigint,stop:bigint,token:string,before:string,shape:string,form:string,failed:boolean,after:string>>"
    found = located(text, TOKEN, lambda m: F.lit(True), made)
    gaps = F.split(text, TOKEN, -1)
    after = F.transform(F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g: F.lower(F.regexp_extract(g, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]*+)", 1)))
    both = F.zip_with(found, after, lambda f, a: f.withField("after", a))
    return F.when(text.rlike("[0-9@]"), both).otherwise(F.array().cast(whole))


def grown(found: DataFrame, boot: Bootstrap) -> DataFrame:
    """Instances (token, kind) that confident patterns discover.

    found: token, side and pattern (null where there is no word), kind (of the base find that covers it,
    else null), failed. Known ones only grow, so the rounds come to an end.
    """
    graph = checkpointed(found.groupBy("token", "side", "pattern").agg(F.max("kind").alias("kind"), F.max("failed").alias("failed")))
    each = graph.groupBy("token").agg(F.max("kind").alias("kind"), F.max("failed").alias("failed"))
    seeds = each.where("kind is not null").select("token", "kind")
    never = each.where("kind is null and failed").select("token")
    edges = graph.where("pattern is not null").select("token", "side", "pattern")
    total = checkpointed(edges.groupBy("side", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= boot.least_known))
    sides = edges.groupBy("token", "side").agg(F.count("*").alias("n_patterns"))
    known = checkpointed(seeds)
    while True:
        hits = edges.join(known, "token").groupBy("side", "pattern", "kind").agg(F.count("*").alias("hits")).where(F.col("hits") >= boot.least_known)
        scored = hits.join(total, ["side", "pattern"]).withColumn("score", F.col("hits") / F.col("n")).where(F.col("score") >= boot.pattern_score)
        votes = edges.join(known.select("token"), "token", "left_anti").join(never, "token", "left_anti").join(scored.select("side", "pattern", "kind", "score"), ["side", "pattern"]).groupBy("token", "side", "kind").agg(F.sum("score").alias("sum"))
        best = votes.join(sides, ["token", "side"]).withColumn("score", F.col("sum") / F.col("n_patterns")).where(F.col("score") >= boot.instance_score)
        more = checkpointed(best.groupBy("token").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")))
        if more.isEmpty():
            return known.join(seeds, "token", "left_anti")
        known = checkpointed(known.unionByName(more))


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def located_pii(documents: DataFrame, boot: Bootstrap = Bootstrap()) -> DataFrame:  # noqa: B008
    """doc_id, text_hash, base and spans (both SPAN) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = checkpointed(documents.select("doc_id", F.xxhash64(text).alias("text_hash"), base_spans(text).alias("base"), instances(text).alias("found")))
    told = F.zip_with("found", covered(F.col("found"), F.col("base")), lambda f, kind: f.withField("kind", kind))
    each = checkpointed(drawn.where(F.size("found") > 0).select("doc_id", "text_hash", F.explode(told).alias("f")).select("doc_id", "text_hash", "f.*"))
    beside = lambda side: F.struct(F.lit(side).alias("side"), F.when(F.col(side) != "", F.concat_ws(" ", side, "shape")).alias("pattern"))
    edges = each.select("token", "kind", "failed", F.explode(F.array(beside("before"), beside("after"), F.struct(F.lit("form").alias("side"), F.col("form").alias("pattern")))).alias("p")).select("token", "kind", "failed", "p.*")
    new = grown(edges, boot)
    rank = F.coalesce(*(F.when(F.col("kind") == k, n) for n, k in enumerate(BASE)))
    added = each.where("kind is null and stop > start").drop("kind").join(new, "token").select("doc_id", "text_hash", F.struct("start", rank.alias("rank"), "kind", "stop").alias("s"))
    added = added.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("s").alias("added"))
    both = drawn.join(added, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return both.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.coalesce(F.col("added").cast(SPAN), F.array().cast(SPAN)))).alias("spans"))


def find_pii(documents: DataFrame, boot: Bootstrap = Bootstrap()) -> DataFrame:  # noqa: B008
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row.

    Counts and the digest are of base spans; spans lists all as kind:start:end, by start and kind.
    Null and empty texts have none (the digest is that of ''). Repeated rows and null ids give a row
    each; texts count whole, however long; an empty table gives no rows. Other columns are not read.
    """
    found = located_pii(documents, boot)
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, boot: Bootstrap = Bootstrap()) -> DataFrame:  # noqa: B008
    """documents with every span in text replaced by its kind in brackets; of overlapping spans the first holds.

    n_chars, where there is one, is set anew. Null texts stay null; rows and other columns stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own_id, own_key, spans, hash_ = fresh(documents, "id", "key", "spans", "hash")
    found = located_pii(documents, boot).where(F.size("spans") > 0).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_key), F.col("spans").alias(spans)).dropDuplicates([own_id, own_key])
    keyed = documents.withColumn(hash_, F.xxhash64(text))
    both = keyed.join(found, (F.col(hash_) == F.col(own_key)) & F.col("doc_id").eqNullSafe(F.col(own_id)), "left")
    # parts of a text are cut from its blocks, so that a part does not cost the text before it
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(start: Column, stop: Column) -> Column:
        first, last = F.floor(start / BLOCK), F.floor(stop / BLOCK)
        head, tail = (start - first * BLOCK + 1).cast("int"), (stop - last * BLOCK).cast("int")
        block = lambda n: F.coalesce(F.get(blocks_, n.cast("int")), F.lit(""))
        whole = F.array_join(F.slice(blocks_, (first + 2).cast("int"), F.greatest(last - first - 1, F.lit(0)).cast("int")), "")
        return F.when(first == last, F.substring(block(first), head, (stop - start).cast("int"))).otherwise(F.concat(F.substring(block(first), head, F.lit(BLOCK)), whole, F.substring(block(last), F.lit(1), tail)))

    cuts, size = fresh(documents, "blocks", "size")
    both = both.withColumn(cuts, F.when(F.col(spans).isNotNull(), blocks)).withColumn(size, F.length(text).cast("bigint"))
    blocks_ = F.col(cuts)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        free = s["start"] >= at
        return F.when(free, s["stop"]).otherwise(at), F.when(free, F.struct(at.alias("start"), s["start"].alias("stop"), s["kind"].alias("kind")))

    end = F.struct(F.col(size).alias("start"), F.lit(len(BASE)).alias("rank"), F.lit(None).cast("string").alias("kind"), F.col(size).alias("stop"))
    parts = F.filter(folded(F.concat(F.col(spans), F.array(end).cast(SPAN)), F.lit(0).cast("bigint"), step, "bigint", "struct<start:bigint,stop:bigint,kind:string>"), lambda p: p.isNotNull())
    whole = F.array_join(F.transform(parts, lambda p: F.concat(cut(p["start"], p["stop"]), F.when(p["kind"].isNull(), "").otherwise(F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]"))))), "")
    out = both.withColumn("text", F.when(F.col(spans).isNotNull(), whole).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
