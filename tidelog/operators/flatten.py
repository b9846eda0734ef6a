"""Captured JSON pages to typed rows. Pages that don't parse keep their error and give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.values import blank_to_null, content_hash, epoch_time, safe_long, visibility

_PICTURE = "ARRAY<STRING>"
REPLY = f"STRUCT<rpid: STRING, root: STRING, parent: STRING, ctime: STRING, `like`: STRING, rcount: STRING, member: STRUCT<mid: STRING, uname: STRING>, content: STRUCT<message: STRING, pictures: {_PICTURE}, picture: {_PICTURE}>, folder: STRUCT<is_folded: BOOLEAN>>"
PAGE = "STRUCT<code: BIGINT, message: STRING, data: STRING>"
DATA = "STRUCT<replies: STRING, cursor: STRUCT<is_end: BOOLEAN, pagination_reply: STRUCT<next_offset: STRING>>, page: STRUCT<num: INT, size: INT, count: BIGINT>>"


def parsed_pages(pages: DataFrame, kind: str = "reply") -> DataFrame:
    """pages with error, replies (array of JSON texts), next_offset and is_end. kind: hot, latest or reply."""
    out = pages.withColumn("_p", F.from_json("body", PAGE)).withColumn("_d", F.from_json("_p.data", DATA))
    raw = F.get_json_object("body", "$.data.replies")
    no_list = raw.isNull() if kind == "hot" else F.lit(False)
    error = (
        F.when(F.col("_p").isNull() | F.col("_p.data").isNull() & ~F.col("body").rlike(r'"data"\s*:'), "not an object")
        .when(F.coalesce(F.col("_p.code"), F.lit(0)) != 0, F.concat(F.lit("code "), F.col("_p.code").cast("string")))
        .when(F.col("_d").isNull() | ~F.coalesce(F.ltrim("_p.data"), F.lit("")).startswith("{"), "data is not an object")
        .when(no_list | (raw.isNotNull() & ~F.ltrim(raw).startswith("[")), "replies is not a list")
    )
    replies = F.when(error.isNull(), F.coalesce(F.from_json(raw, "ARRAY<STRING>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    next_offset = F.col("_d.cursor.pagination_reply.next_offset")
    out = out.withColumn("error", error).withColumn("replies", replies).withColumn("next_offset", next_offset)
    ends = F.coalesce(F.col("_d.cursor.is_end"), F.lit(False)) | F.coalesce(next_offset == "", F.lit(False)) | (F.size("replies") == 0)
    return out.withColumn("is_end", ends).drop("_p", "_d")


def page_rows(parsed: DataFrame) -> DataFrame:
    """One row a page: item count, paging facts and status."""
    return parsed.select("raw_payload_id", "bvid", "captured_at", F.size("replies").alias("item_count"), "next_offset", "is_end", F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("status"), "error")


def comment_rows(parsed: DataFrame) -> DataFrame:
    """One row a comment; items that are no objects keep their place but give no row."""
    each = parsed.select("raw_payload_id", "bvid", "captured_at", F.posexplode("replies").alias("pos", "item")).where(F.ltrim("item").startswith("{"))
    r = each.withColumn("r", F.from_json("item", REPLY))
    return r.select(
        "raw_payload_id", "bvid", "captured_at", (F.col("pos") + 1).alias("position"), safe_long(F.col("r.rpid")).alias("rpid"), safe_long(F.col("r.root"), True).alias("root_rpid"), safe_long(F.col("r.parent"), True).alias("parent_rpid"),
        safe_long(F.col("r.member.mid")).alias("author_mid"), blank_to_null(F.col("r.member.uname")).alias("author_name"), F.col("r.content.message").alias("content"), content_hash(F.col("r.content.message")).alias("content_hash"),
        safe_long(F.col("r.like")).alias("like_count"), safe_long(F.col("r.rcount")).alias("reply_count"), epoch_time(safe_long(F.col("r.ctime"))).alias("platform_created_at"), visibility(F.col("r.folder.is_folded")).alias("visibility"), "item",
    ).where("rpid is not null")


def comment_media(comments: DataFrame) -> DataFrame:
    """url and 0-based position of each comment's pictures, over both lists; items are strings or objects."""
    lists = F.concat(*(F.coalesce(F.from_json(F.get_json_object("item", f"$.content.{name}"), "ARRAY<STRING>"), F.array().cast("array<string>")) for name in ("pictures", "picture")))
    field = lambda x, name: F.get_json_object(x, f"$.{name}")
    url = lambda x: F.when(F.ltrim(x).startswith("{"), F.coalesce(field(x, "img_src"), field(x, "url"), field(x, "src"))).otherwise(x)
    urls = F.filter(F.transform(lists, url), lambda u: u.isNotNull() & (F.trim(u) != ""))
    return comments.select("raw_payload_id", "rpid", F.posexplode(urls).alias("position", "url"))


COUNTERS = {"view": "view_count", "like": "like_count", "coin": "coin_count", "favorite": "favorite_count", "share": "share_count", "reply": "reply_count", "danmaku": "danmaku_count"}


def video_metrics(payloads: DataFrame) -> DataFrame:
    """Seven counters of data.stat, else of data."""
    value = lambda name: F.coalesce(safe_long(F.get_json_object("body", f"$.data.stat.{name}")), safe_long(F.get_json_object("body", f"$.data.{name}")))
    return payloads.select("bvid", "captured_at", *(value(name).alias(column) for name, column in COUNTERS.items()), "raw_payload_id")


def video_info(payloads: DataFrame) -> DataFrame:
    """Title, description, owner, and the ordered, distinct tag names with the fields that gave new ones."""
    text = lambda path: F.get_json_object("body", f"$.data.{path}")
    none = F.array().cast("array<string>")
    name = lambda x: F.coalesce(*(blank_to_null(F.get_json_object(x, f"$.{k}")) for k in ("tag_name", "name", "title")))

    def listed(field: str) -> Column:
        items = F.when(F.ltrim(text(field)).startswith("["), F.from_json(text(field), "ARRAY<STRING>"))
        names = F.transform(items, lambda x: F.trim(F.when(F.ltrim(x).startswith("{"), name(x)).otherwise(x)))
        return F.coalesce(F.array_distinct(F.filter(names, lambda x: x != "")), none)

    kind = F.trim(text("tname"))
    given = {"tag": listed("tag"), "tags": listed("tags"), "tname": F.when(kind != "", F.array(kind)).otherwise(none)}
    names, used = none, []
    for field, found in given.items():
        new = F.array_except(found, names)
        used.append(F.when(F.size(new) > 0, F.lit(field)))
        names = F.concat(names, new)
    fields = F.filter(F.array(*used), lambda x: x.isNotNull())
    return payloads.select("bvid", "captured_at", text("title").alias("title"), text("desc").alias("description"), safe_long(text("owner.mid")).alias("owner_mid"), text("owner.name").alias("owner_name"), F.struct(names.alias("names"), fields.alias("source_fields")).alias("tags"), "raw_payload_id")


#: Fixed words of messages, in order of precedence.
UNAVAILABLE = {"permission_denied": (-403, "权限|无权|forbid"), "deleted": (-404, "不存在|删除|not found"), "invisible": (None, "不可见|隐藏|审核|下架")}


def video_availability(payloads: DataFrame) -> DataFrame:
    """visible (code 0 or none, with a bvid in data), permission_denied, deleted, invisible or unknown_error."""
    code, message = safe_long(F.get_json_object("body", "$.code")), F.lower(F.coalesce(F.get_json_object("body", "$.message"), F.lit("")))
    status = F.when((F.coalesce(code, F.lit(0)) == 0) & (F.coalesce(F.get_json_object("body", "$.data.bvid"), F.lit("")) != ""), "visible")
    for name, (own, words) in UNAVAILABLE.items():
        status = status.when((F.lit(False) if own is None else F.coalesce(code == own, F.lit(False))) | message.rlike(words), name)
    return payloads.select("bvid", "captured_at", status.otherwise("unknown_error").alias("status"), code.alias("code"), "raw_payload_id")


def user_videos(payloads: DataFrame) -> DataFrame:
    """bvid and publish time of listed videos; rows without either are left out."""
    items = F.coalesce(F.from_json(F.get_json_object("body", "$.data.list.vlist"), "ARRAY<STRING>"), F.array().cast("array<string>"))
    each = payloads.select("source_mid", "captured_at", F.explode(items).alias("v"))
    out = each.select("source_mid", "captured_at", blank_to_null(F.get_json_object("v", "$.bvid")).alias("bvid"), F.timestamp_seconds(F.coalesce(safe_long(F.get_json_object("v", "$.created"), True), safe_long(F.get_json_object("v", "$.pubdate")))).alias("pubdate"))
    return out.where("bvid is not null and pubdate is not null")
