"""Pairs and clusters of 64-bit signatures, and reuse of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.values import hamming
from tidelog.operators.components import components
from tidelog.session import checkpointed


def signature_links(signatures: DataFrame, threshold: int = 5) -> DataFrame:
    """All pairs (sa < sb) of different signatures at most `threshold` bits apart, without loss: sa, sb, distance.

    Of threshold + 1 bands of bits one is equal in both; a pair is taken at the first band that is. A
    signature takes part once, however many ids have it.
    """
    bands = threshold + 1
    cuts = [64 * n // bands for n in range(bands + 1)]
    part = lambda c, n: F.shiftrightunsigned(F.shiftleft(c, 64 - cuts[n + 1]), 64 - cuts[n + 1] + cuts[n])
    each = signatures.select("signature").distinct().select("signature", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), part(F.col("signature"), n).alias("value")) for n in range(bands)))).alias("band"))
    side = lambda s: each.select(F.col("signature").alias(f"s{s}"), "band")
    pairs = side("a").join(side("b"), "band").where("sa < sb")
    earlier = F.exists(F.array(*(F.struct(F.lit(n).alias("n"), (part(F.col("sa"), n) == part(F.col("sb"), n)).alias("same")) for n in range(bands))), lambda x: x["same"] & (x["n"] < F.col("band.n")))
    d = hamming(F.col("sa"), F.col("sb"))
    return pairs.where((d <= threshold) & ~earlier).select("sa", "sb", d.alias("distance"))


def confidence(distance: Column) -> Column:
    """Of a link by its distance; 1 where there is none."""
    return F.when(distance.isNull(), 1.0).otherwise(F.greatest(1 - distance / 64, F.lit(0.0)))


def signature_edges(signatures: DataFrame, threshold: int = 5) -> DataFrame:
    """All pairs (a < b) of ids whose signatures are at most `threshold` bits apart; as many rows as there are pairs."""
    links = signature_links(signatures, threshold)
    both = links.select("sa", "sb", "distance").unionByName(signatures.select(F.col("signature").alias("sa")).distinct().select("sa", F.col("sa").alias("sb"), F.lit(0).alias("distance")))
    side = lambda s: signatures.select(F.col("id").alias(f"id_{s}"), F.col("signature").alias(f"s{s}"))
    pairs = both.join(side("a"), "sa").join(side("b"), "sb").where((F.col("sa") != F.col("sb")) | (F.col("id_a") < F.col("id_b")))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "distance", confidence(F.col("distance")).alias("confidence"))


def signature_clusters(signatures: DataFrame, threshold: int = 5) -> DataFrame:
    """Members of groups that pairs connect, named by the least member; distance to that one, null (confidence 1) where it is too far.

    Links are between signatures, and ids are members of theirs, so no pair of copies is made. Ids that
    no other is near to are in no group.
    """
    least = signatures.groupBy("signature").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    parts = components(checkpointed(signature_links(signatures, threshold).select("sa", "sb")), "sa", "sb").withColumnsRenamed({"node": "signature"})
    named = least.join(parts, "signature", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "signature"))
    first = named.groupBy("component").agg(F.min(F.struct("least", "signature")).alias("f")).select("component", F.col("f.least").alias("cluster"), F.col("f.signature").alias("of_cluster"))
    members = signatures.join(named.join(first, "component").select("signature", "cluster", "of_cluster"), "signature")
    d = hamming(F.col("signature"), F.col("of_cluster"))
    near = F.when((d <= threshold) & (F.col("id") != F.col("cluster")), d)
    return members.select("cluster", F.col("id").alias("member"), near.alias("distance"), confidence(near).alias("confidence"))


def reuse_ranking(links: DataFrame, by: str) -> DataFrame:
    """Distinct comments and videos of each asset, most reused first."""
    return links.groupBy(by).agg(F.count_distinct("rpid").alias("comments"), F.count_distinct("bvid").alias("videos")).orderBy(F.desc("comments"), F.desc("videos"), by)
