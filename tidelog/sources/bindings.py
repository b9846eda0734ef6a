"""The driver's tables seen as the archive's tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SINCE, UNTIL = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC)
KEYWORDS = ("click", "error", "purchase")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(time) -> F.Column:
    """An instant from a time without zone (or with one), whatever the session's zone is."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz")))


def observations(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    e = read(spark, sf_dir, "events") if events is None else events
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("rpid"), F.concat(F.lit("v"), F.col("user_id") % 15).alias("bvid"), (F.col("user_id") % 40).alias("author_mid"),
        utc(F.col("ts")).alias("captured_at"), F.concat_ws(" ", "event_type", "props").alias("content"), F.floor("value").cast("long").alias("like_count"), k.alias("reply_count"),
        (k % 20 + 1).cast("int").alias("position"), F.when(F.col("event_type").isin("view", "click"), "hot").otherwise("latest").alias("sort_mode"),
        F.when(F.col("event_type") == "error", "folded").otherwise("visible").alias("visibility"), F.col("event_id").alias("raw_payload_id"), "event_type", F.when(F.col("user_id") % 4 == 0, F.col("user_id") - 1).alias("root_rpid"),
    )


def hot_pages(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page rows and their observations: a page a day and video, positions by likes."""
    from pyspark.sql import Window

    hot = obs.where("sort_mode = 'hot'").withColumn("day", F.floor(F.unix_seconds("captured_at") / 86400))
    hot = hot.withColumn("page_id", F.concat_ws("-", "bvid", "day"))
    w = Window.partitionBy("page_id").orderBy(F.desc("like_count"), "id")
    on_page = hot.select("page_id", "bvid", F.row_number().over(w).alias("position"), "rpid", F.col("id").alias("comment_observation_id"), "content", F.timestamp_seconds(F.col("day") * 86400).alias("captured_at"))
    return on_page.select("page_id", "bvid", "captured_at").distinct(), on_page.drop("captured_at", "bvid")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("v"), F.col("user_id") % 15).alias("bvid"), utc(F.col("ts")).alias("captured_at"), F.floor(F.col("value") * 100).cast("long").alias("view_count"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("like_count"), F.when(F.col("event_type") != "error", F.col("event_id") % 7).alias("coin_count"), F.col("user_id").alias("owner_mid"),
        F.when(F.col("event_type") == "error", "deleted").otherwise("visible").alias("status"), F.col("event_id").alias("raw_payload_id"),
    )


def event_videos(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    first = F.timestamp_seconds(F.lit(int(SINCE.timestamp())) + 3600 * n)
    reason = F.when(n % 2 == 0, "seed").otherwise("keyword")
    return spark.range(15).select(F.lit(1).cast("long").alias("event_id"), F.concat(F.lit("v"), n).alias("bvid"), (n % 5 != 0).alias("active"), reason.alias("association_reason"), ((n % 4) / 4).alias("confidence"), first.alias("first_seen_at"))


def infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video information: a third of the events."""
    e = read(spark, sf_dir, "events").where("event_id % 3 = 0")
    return e.select(F.concat(F.lit("v"), F.col("user_id") % 15).alias("bvid"), utc(F.col("ts")).alias("captured_at"), F.concat(F.lit("t"), "event_id").alias("title"), F.col("user_id").alias("owner_mid"), F.concat(F.lit("o"), "user_id").alias("owner_name"), F.col("event_id").alias("raw_payload_id"))


def event_keywords(spark: SparkSession) -> DataFrame:
    """The latest version of each keyword is active; an older one and one that is given up come with them."""
    rows = [(n, 1, k, k, 2, True) for n, k in enumerate(KEYWORDS)] + [(10 + n, 1, k.upper(), k, 1, True) for n, k in enumerate(KEYWORDS)] + [(20, 1, "view", "view", 3, False)]
    return spark.createDataFrame(rows, "id long, event_id long, keyword string, normalized_keyword string, version int, active boolean")


def event_targets(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, "uid", "3", 10, True, '{"role":"major_creator"}'), (2, 1, "uid", "4", 10, True, '{"role":"official"}')]
    return spark.createDataFrame(rows, "id long, event_id long, target_type string, normalized_value string, priority int, active boolean, extra string")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comment entities; first seen half a minute apart."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("rpid"), F.col("source").alias("bvid"), (F.col("doc_id") % 5).alias("author_mid"), F.timestamp_seconds(F.lit(1704067200) + 30 * F.col("doc_id")).alias("first_seen_at"), F.col("text").alias("first_content"), "n_chars", F.when(F.col("doc_id") % 5 != 2, F.concat(F.lit("a"), F.col("doc_id") % 5)).alias("author_name"), F.col("doc_id").alias("first_raw_payload_id"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("l_suppkey").alias("target_id"), F.to_date("o_orderdate").alias("started_at"), F.to_date("l_shipdate").alias("finished_at"), F.col("o_orderpriority").alias("task_kind"),
        F.when(F.col("l_returnflag") == "N", "succeeded").when(F.col("l_returnflag") == "R", "partial").otherwise("failed").alias("status"), F.floor("l_quantity").cast("long").alias("pages_requested"),
        F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).cast("long").alias("pages_succeeded"), F.col("l_linenumber").cast("long").alias("request_errors"), (F.col("l_linestatus") == "O").alias("truncated"),
        (F.col("l_partkey") % 30).alias("items_observed"), F.col("l_linenumber").cast("long").alias("raw_payloads_saved"), (F.col("l_suppkey") % 3).alias("parse_errors"), (F.col("l_partkey") % 17 == 0).alias("corrupted"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.to_date("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("kind"))


def parts_of(spark: SparkSession, sf_dir: str, name: str, rows: int = 500_000) -> int:
    """Partitions of at most about `rows` rows of a table (counted by its files' footers), at least one a core."""
    return max(-(-read(spark, sf_dir, name).count() // rows), spark.sparkContext.defaultParallelism)


def media_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables are dealt by the order, into parts that keep their size when the tables grow."""
    parts = parts_of(spark, sf_dir, "lineitem")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").repartition(parts, "l_orderkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("comment_observation_id"), F.col("l_linenumber").cast("int").alias("position"), (F.col("l_partkey") % 50).alias("media_source_id"), F.col("o_custkey").alias("rpid"), F.to_date("l_shipdate").alias("arrived"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 sign bits of embeddings, and two copies with a few low bits flipped."""
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(F.get("embedding", i) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    base = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bits.alias("signature"))
    j = (F.col("id") % 7).cast("int")
    low = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    one = base.select((F.col("id") + 100_000).alias("id"), F.col("signature").bitwiseXOR(low(j)).alias("signature"))
    two = base.select((F.col("id") + 200_000).alias("id"), F.col("signature").bitwiseXOR(low(2 * j)).alias("signature"))
    return base.unionByName(one).unionByName(two)


def reply_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A captured JSON page for each conversation."""
    reply = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("rpid"), F.struct(F.col("text").alias("message")).alias("content"), F.struct((F.col("turn") % 2).alias("mid"), F.col("role").alias("uname")).alias("member"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("root"))
    pages = read(spark, sf_dir, "conversations").where("turn is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", reply.alias("r")))).alias("rs"))
    body = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.transform("rs", lambda x: x["r"]).alias("replies")).alias("data")))
    return pages.select(F.col("conv_id").alias("raw_payload_id"), F.concat(F.lit("c"), F.col("conv_id")).alias("bvid"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")).alias("captured_at"), body.alias("body"))
