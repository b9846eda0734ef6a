"""Ends of cursor chains against plain loops, and the number of Spark jobs that they take."""

import random

import pytest

from tidelog.operators import chains


def links_of(crawls: dict[int, int], seed: int) -> dict[tuple[int, int], int | None]:
    """Random successors: runs in order of the ids, jumps, ends and loops, on sparse ids."""
    r, out = random.Random(seed), {}
    for crawl, n in crawls.items():
        ids = [k * 7 - 20 for k in range(n)]
        for k, page in enumerate(ids):
            x = r.random()
            out[crawl, page] = None if x < 0.03 or k + 1 == n else r.choice(ids) if x < 0.1 else ids[k + 1]
    return out


def ends_of(links: dict) -> set[tuple]:
    out = set()
    for crawl, page in links:
        at, steps, seen = page, 0, {page}
        while (to := links[crawl, at]) is not None and to not in seen:
            at, steps = to, steps + 1
            seen.add(at)
        out.add((crawl, page, None, None) if to is not None else (crawl, page, at, steps))
    return out


@pytest.mark.parametrize("at_once", [1000, 40, 2])
def test_chain_ends(spark, at_once):
    links = links_of({1: 150, 2: 30, 3: 1, 4: 39, 5: 90}, at_once)
    frame = spark.createDataFrame([(c, p, n) for (c, p), n in links.items()] + [(None, 5, None)], "crawl long, page_id long, next long")
    found = {tuple(r) for r in chains.chain_ends(frame, at_once).select("crawl", "page_id", "last", "steps").collect()}
    assert found == ends_of(links) | {(None, 5, 5, 0)}


def test_chain_ends_takes_no_joins_where_tasks_hold_the_crawls(spark, monkeypatch):
    """A loop kept all of log2(n) rounds going."""
    n, cuts = 300, []
    cut = chains.checkpointed
    monkeypatch.setattr(chains, "checkpointed", lambda df: cuts.append(1) or cut(df))
    frame = spark.createDataFrame([(1, k, k + 1 if k < n - 1 else n - 2) for k in range(n)], "crawl long, page_id long, next long")
    assert {tuple(r) for r in chains.chain_ends(frame).collect()} == {(1, k, None, None) for k in range(n)}
    assert len(cuts) < 5


def test_chain_ends_of_no_rows(spark):
    assert chains.chain_ends(spark.createDataFrame([], "crawl long, page_id long, next long")).collect() == []
