"""Chains of pages by their cursors: successors by a join, ends by tasks that follow whole crawls or stretches of them, loops and forks told from page rows alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidelog.session import checkpointed


def successors(pages: DataFrame) -> DataFrame:
    """crawl, page_id and next: the page of a crawl whose cursor is the one that a page names next (the least id, where pages share it)."""
    heads = pages.where("cursor is not null").groupBy("crawl", F.col("cursor").alias("next_cursor")).agg(F.min("page_id").alias("next"))
    return pages.join(heads, ["crawl", "next_cursor"], "left").select("crawl", "page_id", "next")


#: Pages that one task follows at a time (some 100 bytes each); a larger crawl is dealt into ranges of its pages.
AT_ONCE = 500_000


def followed(rows: pa.Table) -> pa.Table:
    """rows, of which each now points where its chain leaves them or ends. at is null for pages that lead into a loop inside.

    rows: crawl, page_id, at, steps to it, and done (at is the chain's end, or null).
    """
    n = rows.num_rows
    at, done = rows["at"].combine_chunks(), rows["done"].to_numpy()
    named = pa.chunked_array([*rows["page_id"].chunks, at]).combine_chunks().dictionary_encode(null_encoding="encode")
    code, crawl = named.indices.to_numpy().astype(np.int64), rows["crawl"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    of, to = crawl * len(named.dictionary) + code[:n], crawl * len(named.dictionary) + code[n:]
    order = np.argsort(of)
    there = order[np.minimum(np.searchsorted(of, to, sorter=order), n - 1)] if n else order
    stops = done | (of[there] != to)
    place, steps = np.where(stops, np.arange(n), there), np.where(stops, 0, rows["steps"].fill_null(0).to_numpy())
    # in round k a page knows the row 2^k rows on; after as many rounds as the rows have, those that stand at no stop go round
    for _ in range(n.bit_length()):
        if stops[place].all():
            break
        place, steps = place[place], steps + steps[place]
    round_ = pa.array(~stops[place])
    last, none = rows.take(pa.array(place)), pa.scalar(None)
    return pa.table({
        "crawl": rows["crawl"],
        "page_id": rows["page_id"],
        "at": pc.if_else(round_, none.cast(at.type), last["at"]),
        "steps": pc.if_else(round_, none.cast(pa.int64()), pc.add(pa.array(steps), last["steps"])),
        "done": pc.or_(round_, last["done"]),
    })


def _followed(state: DataFrame, at_once: int) -> DataFrame:
    """state after one round in tasks: crawls of up to at_once pages whole, larger ones in ranges of about as many."""
    columns = ["crawl", "page_id", "at", "steps", "done"]
    schema = StructType([StructField(f.name, f.dataType) for f in state.schema])

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield from followed(pa.Table.from_batches(held)).to_batches(max_chunksize=50_000)

    sizes = checkpointed(state.groupBy("crawl").agg(F.count("*").alias("n")))
    large = F.coalesce(F.col("n") > at_once, F.lit(False))
    told = sizes.agg(F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)).alias("small"), F.coalesce(F.sum(F.when(large, F.col("n"))), F.lit(0)).alias("large")).first()
    sized = state.join(sizes, "crawl", "left")
    # small crawls share bins, in which there are about as many other pages as a fifth of at_once
    bins = max(1, -(-5 * told.small // at_once))
    small = sized.where(~large).withColumn("bin", F.pmod(F.xxhash64("crawl"), F.lit(bins))).select("bin", *columns)
    out = small.groupBy("bin").applyInArrow(lambda rows: followed(rows.drop_columns("bin")), schema)
    if told.large:
        ranges = sized.where(large).select(*columns).repartitionByRange(max(2, -(-2 * told.large // at_once)), "crawl", "page_id")
        out = out.unionByName(ranges.mapInArrow(of_partition, schema))
    return checkpointed(out)


def _doubled(state: DataFrame) -> DataFrame:
    """state with all chains followed by joins: in round k every page knows the page 2^k steps on, from the page that it knew before.

    Pages that know no end when any chain without a loop would have ended lead into one.
    """
    longest = state.groupBy("crawl").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach < longest and not state.where("not done").isEmpty():
        on = state.select("crawl", F.col("page_id").alias("at"), F.col("at").alias("beyond"), F.col("steps").alias("more"), F.col("done").alias("ended"))
        moved = state.where("not done").join(on, ["crawl", "at"]).select("crawl", "page_id", F.col("beyond").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ended").alias("done"))
        state = checkpointed(state.where("done").unionByName(moved))
        reach *= 2
    return state.select("crawl", "page_id", F.when(F.col("done"), F.col("at")).alias("at"), F.when(F.col("done"), F.col("steps")).alias("steps"), F.lit(True).alias("done"))


def _solved(state: DataFrame, at_once: int) -> DataFrame:
    local = _followed(state, at_once)
    apart = local.where("not done")
    if apart.isEmpty():
        return local
    # pages that chains come to from another range: with their ends those of all others are known
    heads = checkpointed(local.join(apart.select("crawl", F.col("at").alias("page_id")).distinct(), ["crawl", "page_id"], "left_semi"))
    ends = _solved(heads, at_once) if 2 * heads.count() <= state.count() else _doubled(heads)
    ends = ends.select("crawl", F.col("page_id").alias("at"), F.col("at").alias("beyond"), F.col("steps").alias("more"))
    moved = apart.join(ends, ["crawl", "at"]).select("crawl", "page_id", F.col("beyond").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.lit(True).alias("done"))
    return checkpointed(local.where("done").unionByName(moved))


def chain_ends(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """crawl, page_id, last (the page where its chain ends) and steps to it; both null for pages that lead into a loop.

    Tasks follow the chains of whole crawls, or of ranges of large ones. Only the pages that a chain comes to from another
    range go on, to tasks again as long as they are at most half as many, else through log2(n) joins.
    """
    state = checkpointed(links.select("crawl", "page_id", F.coalesce("next", "page_id").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("next").isNull().alias("done")))
    return _solved(state, at_once).select("crawl", "page_id", F.col("at").alias("last"), "steps")


def chain_audit(pages: DataFrame, most_anchors: int = 5) -> DataFrame:
    """For each crawl, from cursors alone, in whatever order its pages came.

    pages, longest (pages of the longest chain without a loop), roots (pages that none leads to), ends, forks (cursors that
    several pages have), merges (pages that several lead to), broken (a next cursor that no page has, short of the end),
    looping (pages that lead into a loop), anchor_reached, beyond_anchor (pages of a chain after its first that holds
    an anchor), ended, and missing (ended without an anchor).

    pages: crawl, page_id (unique), cursor, next_cursor (null: none), rpids, anchors and is_end.
    """
    links = checkpointed(successors(pages))
    ends = chain_ends(links)
    known = F.slice(F.array_distinct("anchors"), 1, most_anchors)
    hit = F.coalesce(F.arrays_overlap("rpids", known), F.lit(False))
    lead = links.where("next is not null").groupBy("crawl", F.col("next").alias("page_id")).agg(F.count("*").alias("led"))
    each = pages.select("crawl", "page_id", "next_cursor", F.coalesce("is_end", F.lit(False)).alias("is_end"), hit.alias("hit")).join(links, ["crawl", "page_id"]).join(ends, ["crawl", "page_id"]).join(lead, ["crawl", "page_id"], "left")
    # of the pages that end at one page, those nearer to it than the farthest anchor come after that
    first = each.where("hit and steps is not null").groupBy("crawl", "last").agg(F.max("steps").alias("anchor_steps"))
    told = each.join(first, ["crawl", "last"], "left")
    broken = F.col("next_cursor").isNotNull() & F.col("next").isNull() & ~F.col("is_end")
    out = told.groupBy("crawl").agg(
        F.count("*").alias("pages"), F.coalesce(F.max("steps") + 1, F.lit(0)).alias("longest"), F.count_if(F.col("led").isNull()).alias("roots"), F.count_if(F.col("next").isNull()).alias("ends"),
        F.count_if(F.col("led") > 1).alias("merges"), F.count_if(broken).alias("broken"), F.count_if(F.col("steps").isNull()).alias("looping"),
        F.bool_or("hit").alias("anchor_reached"), F.count_if(F.col("steps") < F.col("anchor_steps")).alias("beyond_anchor"), F.bool_or("is_end").alias("ended"),
    )
    forks = pages.where("cursor is not null").groupBy("crawl", "cursor").agg(F.count("*").alias("n")).where("n > 1").groupBy("crawl").agg(F.count("*").alias("forks"))
    return out.join(forks, "crawl", "left").withColumns({"forks": F.coalesce("forks", F.lit(0)), "missing": F.col("ended") & ~F.col("anchor_reached")})
