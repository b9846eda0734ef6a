"""Small column rules: parsing, buckets, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.text import fold_text


def safe_long(value: Column, zero_is_null: bool = False) -> Column:
    """A long from text that is one, else null."""
    number = value.try_cast("long")
    return F.nullif(number, F.lit(0)) if zero_is_null else number


def local_seconds(time: Column, zone: str) -> Column:
    """Seconds since 1970 on a zone's clocks at an instant, whatever the session's zone is."""
    return F.floor(F.unix_micros(F.from_utc_timestamp(time, zone)) / 1_000_000)


def iso_utc(seconds: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of epoch seconds, whatever the session's zone is."""
    rest = F.pmod(seconds, F.lit(86_400)).cast("int")
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600).cast("int"), F.floor(rest / 60).cast("int") % 60, rest % 60)
    return F.concat(F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string"), clock)


def iso_time(time: Column) -> Column:
    """The same of an instant, with microseconds where it has any."""
    micros = F.pmod(F.unix_micros(time), F.lit(1_000_000)).cast("int")
    whole = iso_utc(F.floor(F.unix_micros(time) / 1_000_000))
    return F.when(micros == 0, whole).otherwise(F.concat(F.substring(whole, 1, 19), F.format_string(".%06dZ", micros)))


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def epoch_time(seconds: Column) -> Column:
    """A timestamp of positive epoch seconds, else null."""
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def visibility(folded: Column) -> Column:
    return F.when(folded, "folded").otherwise("visible")


#: Fixed labels of like counts, each with its upper bound.
LIKE_BUCKETS = [("0-9", 10), ("10-99", 100), ("100-999", 1000), ("1k-9999", 10_000), ("10k-99999", 100_000)]


def like_bucket(likes: Column) -> Column:
    out = F.when(likes.isNull(), "unknown")
    for label, below in LIKE_BUCKETS:
        out = out.when(likes < below, label)
    return out.otherwise("100k+")


def url_base(url: Column) -> Column:
    """A URL without query and fragment; anything without scheme and host as it is."""
    bare = F.trim(url)
    return F.when(F.lower(bare).rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]+"), F.regexp_replace(bare, r"[?#].*$", "")).otherwise(url)


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(text), 256)


def stable_key(**fields: Column) -> Column:
    """SHA-256 of the fields as compact JSON with names in order and nulls kept."""
    parts = [F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null"))) for name, value in sorted(fields.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def quoted(text: Column) -> Column:
    return F.when(text.isNotNull(), F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"')))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, rounded; null where whole is 0 or null."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


#: Fixed forms of an event's slug and of a video's id.
SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
BVID = "^BV[0-9A-Za-z]{10}$"


def slug(text: Column) -> Column:
    """A slug in lower case with hyphens for blanks; null where that is none."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-")
    return F.when(bare.rlike(SLUG), bare)


def target_value(kind: Column, value: Column) -> Column:
    """An event target's value as it is compared: a positive number of a uid, a video's id, else folded text; null where it is none."""
    bare = F.trim(value)
    number = F.when(bare.rlike("^[0-9]+$"), F.regexp_replace(bare, "^0+", ""))
    text = fold_text(value, "trimmed")
    return F.when(kind == "uid", F.nullif(number, F.lit(""))).when(kind == "seed_bvid", F.when(bare.rlike(BVID), bare)).when(kind.isin("keyword", "game"), F.nullif(text, F.lit("")))


def error_class(status: Column, body: Column) -> Column:
    """captcha, forbidden, rate_limited or server_error of a failed request, else null."""
    return (
        F.when((status == 412) | F.lower(F.coalesce(body, F.lit(""))).rlike("captcha|验证码|风控"), "captcha")
        .when(status == 403, "forbidden").when(status == 429, "rate_limited").when(status.between(500, 599), "server_error")
    )


def retry_after(header: Column) -> Column:
    return F.when(header.rlike("^[0-9]+$"), header.try_cast("long"))
