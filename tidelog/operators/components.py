"""Connected components of an edge list: forests within partitions, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import checkpointed

#: Edges for which a partition is worth its files, and that one task holds at once.
PER_PART = 100_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges (a, b), and the least node that each is connected to."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(names))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        px, py = parent[x], parent[y]
        apart = px != py
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return names, names[parent]


def _forest(edges: DataFrame, per_part: int, roots: bool = False) -> DataFrame:
    """Edges (a > b) of the same components: in each partition, `per_part` at a time, nodes hang on the least one.

    roots: with an edge from each least node to itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def hung() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(n).to_numpy() for x in held]) for n in (0, 1))
            held.clear()
            node, least = least_labels(a, b)
            kept = (node != least) | roots
            return pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(least[kept])], names=["a", "b"])

        for batch in batches:
            if held and sum(x.num_rows for x in held) + batch.num_rows > per_part:
                yield hung()
            held.append(batch)
        if held:
            yield hung()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, small: bool, parts: int) -> DataFrame:
    """Edges re-hung on the least neighbour. edges: a > b.

    Large: each neighbour that is larger than the node hangs on the least of the node and its
    neighbours. Small: each neighbour that is smaller, and the node. The least is found by a partial
    aggregation and joined back, so a node of very many edges is never one task's group.
    """
    if small:
        near = edges
        least = near.groupBy("a").agg(F.min("b").alias("least")).coalesce(parts)
        moved = near.join(least, "a").select(F.col("b").alias("x"), "least").unionByName(least.select(F.col("a").alias("x"), "least"))
    else:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(parts)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least")).coalesce(parts)
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("x"), "least")
    return moved.where("x != least").select(F.col("x").alias("a"), F.col("least").alias("b")).coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40, per_part: int = PER_PART) -> DataFrame:
    """node and component (its least node, both long) of every node with an edge to another node.

    edges is read more than once, so it should be a stored one; its ends are whole numbers. Null ends
    and loops are left out; repeated edges count once; no edges give no rows. Raises RuntimeError rather
    than returning components that have not settled.

    First every task hangs the nodes of its edges on their least ones, which is the result where one task
    of `per_part` edges holds all. Beyond that, stars join what the tasks have found, until nothing moves.
    """
    kept = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    n = kept.count()
    if n <= per_part:
        return _forest(kept.coalesce(1), per_part, roots=True).select(F.col("a").alias("node"), F.col("b").alias("component"))
    parts = max(2, min(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // per_part)))
    now = checkpointed(_forest(kept.coalesce(parts), per_part))
    for _ in range(rounds):
        # settled: every b is a root and every a has one b, so nothing would move
        roots = now.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).coalesce(parts)
        moving = roots.where("low < high").select("a").unionByName(now.join(roots.select(F.col("a").alias("b")), "b", "left_semi").select("a"))
        if moving.isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        now = checkpointed(_forest(_star(_star(now, small=False, parts=parts), small=True, parts=parts), per_part))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
