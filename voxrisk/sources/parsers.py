"""Raw platform records to unified comments.

A parser maps the parsed record to an array of comment structs (the comment, then its
replies). All platforms share one read schema, so a mixed folder is read once. New
platforms are added with ``register_parser``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrisk.functions import text as tx
from voxrisk.schema import (
    BILIBILI_RAW, COMMENT_COLUMNS, DOUYIN_RAW, TIEBA_RAW, ZHIHU_RAW, struct,
)

# --- Fixed values: names for missing authors -------------------------------------
UNKNOWN_USER, ZHIHU_USER, DOUYIN_USER = "未知用户", "知乎用户", "抖音用户"
ZHIHU_NO_IP, TIEBA_NO_ID = "未知IP", "未知id"

FIELDS = (
    "comment_id STRING, platform STRING, raw STRING, user_name STRING, user_id STRING, "
    "user_level INT, like_count BIGINT, reply_count BIGINT, publish_time TIMESTAMP, ip_location STRING, "
    "is_reply BOOLEAN, parent_id STRING, source_url STRING"
)
# Low bits of ``ord`` that number the replies of one record.
REPLY_BITS = 20


# A parser maps (record, id of the main comment) to the comments of the record.
Parser = Callable[[Column, Column], Column]
# An id rule maps (record, cleaned main text) to the id of the main comment.
IdRule = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Platform:
    schema: str
    text: Callable[[Column], Column]
    main_id: IdRule
    parse: Parser


PLATFORMS: dict[str, Platform] = {}


def register_parser(name: str, schema: str, text: Callable[[Column], Column], main_id: IdRule) -> Callable[[Parser], Parser]:
    """Add a platform: its read schema, main text, id rule and parser."""
    def add(parser: Parser) -> Parser:
        PLATFORMS[name] = Platform(schema, text, main_id, parser)
        return parser
    return add


def read_schema() -> T.StructType:
    """The fields of all platforms together, plus the text of a line that fails."""
    fields: dict[str, T.StructField] = {}
    for platform in PLATFORMS.values():
        for field in struct(platform.schema).fields:
            if fields.setdefault(field.name, field).dataType != field.dataType:
                raise ValueError(f"field {field.name} has two types")
    return T.StructType([*fields.values(), T.StructField("_corrupt", T.StringType())])


def comment(platform: str, raw: Column, **given: Column) -> Column:
    """A comment struct; fields not given are null (counts 0, ``is_reply`` false)."""
    values = {
        "platform": F.lit(platform), "raw": tx.blank_if_null(raw), "like_count": F.lit(0), "reply_count": F.lit(0),
        "is_reply": F.lit(False), **given,
    }
    return F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(FIELDS).fields
    ])


def whole(value: Column) -> Column:
    """Whole number of a field given as number or text, fractions cut off; null where it is none."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))


def or_zero(count: Column) -> Column:
    return F.coalesce(whole(count), F.lit(0))


def seconds(value: Column) -> Column:
    return F.timestamp_seconds(F.nullif(whole(value), F.lit(0)))


def of_author(author: Column, field: str) -> Column:
    """Field of an author kept as JSON text; a plain text is the name."""
    is_object = F.startswith(F.ltrim(author), F.lit("{"))
    return F.when(is_object, F.get_json_object(author, f"$.{field}")).otherwise(author if field == "name" else F.lit(None).cast("string"))


def _given(value: Column) -> Column:
    """Null for the empty string and for 0."""
    return F.nullif(F.nullif(value, F.lit("")), F.lit("0"))


def _with_replies(main: Column, replies: Column, reply: Callable[[Column, Column], Column]) -> Column:
    none = F.array().cast(T.ArrayType(struct(FIELDS)))
    return F.concat(F.array(main), F.coalesce(F.transform(replies, reply), none))


def _minute(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-M-d H:m"))


@register_parser(
    "bilibili", BILIBILI_RAW, lambda r: r["comment"],
    lambda r, cleaned: F.coalesce(_given(r["rpid"]), tx.short_hash_id("bili_", cleaned)),
)
def bilibili(r: Column, main_id: Column) -> Column:
    main = comment(
        "bilibili", r["comment"], comment_id=main_id,
        user_name=F.coalesce(of_author(r["user"], "name"), F.lit(UNKNOWN_USER)), user_id=_given(of_author(r["user"], "mid")),
        user_level=whole(of_author(r["user"], "level")).try_cast("int"), like_count=or_zero(r["like"]), reply_count=or_zero(r["reply_count"]),
        publish_time=seconds(r["ctime"]), ip_location=tx.strip_ip_prefix(of_author(r["user"], "ip")),
    )

    def reply(x: Column, i: Column) -> Column:
        name = of_author(x["user"], "name")
        is_object = F.startswith(F.ltrim(x["user"]), F.lit("{"))
        level = whole(F.when(is_object, of_author(x["user"], "level")).otherwise(x["level"])).try_cast("int")
        return comment(
            "bilibili", x["comment"], comment_id=F.concat(main_id, F.lit("_reply_"), i.cast("string")),
            user_name=F.coalesce(name, F.lit(UNKNOWN_USER)), user_level=level, like_count=or_zero(x["like"]),
            ip_location=tx.strip_ip_prefix(x["ip"]), is_reply=F.lit(True), parent_id=main_id,
        )

    return _with_replies(main, r["replies"], reply)


@register_parser("tieba", TIEBA_RAW, lambda r: r["content"], lambda r, _: tx.blank_if_null(r["pid"]))
def tieba(r: Column, main_id: Column) -> Column:
    main = comment(
        "tieba", r["content"], comment_id=main_id, user_name=F.coalesce(r["author"], F.lit(UNKNOWN_USER)),
        user_id=tx.blank_if_null(F.nullif(r["user_id"], F.lit(TIEBA_NO_ID))), reply_count=or_zero(r["total_lzl"]),
        publish_time=_minute(r["time"]), ip_location=r["ip_location"],
    )

    def reply(x: Column, i: Column) -> Column:
        return comment(
            "tieba", F.coalesce(x["content"], x["text"]), comment_id=F.concat(main_id, F.lit("_sub_"), i.cast("string")),
            user_name=F.coalesce(x["author"], x["user"], F.lit(UNKNOWN_USER)), publish_time=_minute(x["time"]),
            ip_location=x["ip_location"], is_reply=F.lit(True), parent_id=main_id,
        )

    return _with_replies(main, r["sub_replies"], reply)


@register_parser(
    "zhihu", ZHIHU_RAW, lambda r: r["content"],
    lambda r, cleaned: tx.short_hash_id("zhihu_", F.substring(cleaned, 1, 100)),
)
def zhihu(r: Column, main_id: Column) -> Column:
    return F.array(comment(
        "zhihu", r["content"], comment_id=main_id,
        user_name=F.coalesce(r["author"], F.lit(ZHIHU_USER)), like_count=or_zero(r["vote"]),
        publish_time=F.try_to_timestamp(r["time"], F.lit("yyyy-MM-dd HH:mm:ss")),
        ip_location=F.nullif(r["ip"], F.lit(ZHIHU_NO_IP)), source_url=r["url"],
    ))


@register_parser(
    "douyin", DOUYIN_RAW, lambda r: F.coalesce(r["text"], r["content"]), lambda r, _: tx.blank_if_null(r["cid"])
)
def douyin(r: Column, main_id: Column) -> Column:
    reply = F.coalesce(r["is_reply"].try_cast("boolean"), F.lit(False))
    return F.array(comment(
        "douyin", F.coalesce(r["text"], r["content"]), comment_id=main_id,
        user_name=F.coalesce(r["nickname"], r["user_name"], F.lit(DOUYIN_USER)), user_id=tx.blank_if_null(r["user_id"]),
        like_count=F.coalesce(whole(r["digg_count"]), or_zero(r["like_count"])),
        reply_count=F.coalesce(whole(r["reply_total"]), or_zero(r["reply_comment_total"])),
        publish_time=seconds(r["create_time"]),
        ip_location=F.coalesce(r["ip_label"], r["ip_location"]), is_reply=reply,
        parent_id=F.when(reply, r["reply_id"]),
    ))


def _by_platform(pick: Callable[[Platform], Column], otherwise: Column) -> Column:
    out = otherwise
    for name, platform in PLATFORMS.items():
        out = F.when(F.col("platform") == name, pick(platform)).otherwise(out)
    return out


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines (line, source_file, ord, platform) with the record and ``parse_error``.

    Only a line that is no JSON object is an error. A field of an unexpected shape is null, the rest of its record stays."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = lines.withColumn("record", F.from_json("line", read_schema(), options))
    error = (
        F.when(~F.col("platform").isin(*PLATFORMS), F.concat(F.lit("unsupported platform: "), F.col("platform")))
        .when(F.col("record").isNull() | F.json_object_keys("line").isNull(), F.lit("malformed JSON"))
    )
    return read.withColumn("parse_error", error)


def comment_arrays(parsed: DataFrame, clean: bool = True) -> DataFrame:
    """Adds ``comments``, the array of comments each record yields (null on error)."""
    record, none = F.col("record"), F.lit(None)
    shown = tx.clean_content if clean else tx.blank_if_null
    main_id = _by_platform(lambda p: p.main_id(record, shown(p.text(record))), none.cast("string"))
    made = _by_platform(lambda p: p.parse(record, F.col("_id")), none.cast(T.ArrayType(struct(FIELDS))))
    return parsed.withColumn("_id", main_id).withColumn("comments", F.when(F.col("parse_error").isNull(), made)).drop("_id")


def flatten(arrays: DataFrame, clean: bool = True) -> DataFrame:
    """One row per comment or reply, in record order, its text cleaned.

    The outer explode keeps Spark from testing the whole array expression in a filter of
    its own; the rows of failed records are dropped after it.
    """
    rows = arrays.select("source_file", "ord", F.posexplode_outer("comments").alias("part", "c"))
    rows = rows.filter(F.col("part").isNotNull())
    raw = F.col("c.raw")
    place = F.col("ord") + F.least(F.col("part"), F.lit((1 << REPLY_BITS) - 1))
    return rows.select(
        "c.*", (tx.clean_content(raw) if clean else raw).alias("content"),
        tx.content_metadata(raw).alias("content_metadata"), "source_file", place.alias("ord"),
    ).select(*COMMENT_COLUMNS)


def parse_lines(lines: DataFrame, clean: bool = True) -> DataFrame:
    """Comments of all lines that parse."""
    return flatten(comment_arrays(parsed_lines(lines), clean), clean)


def bad_records(lines: DataFrame) -> DataFrame:
    """Lines that do not parse, with the reason."""
    bad = parsed_lines(lines).filter(F.col("parse_error").isNotNull())
    return bad.select("source_file", "ord", "parse_error", "line")


def raw_texts(lines: DataFrame) -> DataFrame:
    """Per line: ``parse_error`` and the raw ``texts`` of its comment and replies."""
    arrays = comment_arrays(parsed_lines(lines), clean=False)
    return arrays.select(
        "source_file", "ord", "platform", "parse_error", F.transform("comments", lambda c: c["raw"]).alias("texts")
    )


def reindex_columns(df: DataFrame, columns: list[str], fill: str = "") -> DataFrame:
    """Exactly these columns in this order, as text; missing ones and nulls become ``fill``."""
    return df.select(*[
        (F.coalesce(F.col(c).cast("string"), F.lit(fill)) if c in df.columns else F.lit(fill)).alias(c) for c in columns
    ])


def flatten_forecast(df: DataFrame) -> DataFrame:
    """Forecast records (parallel arrays and a date map) to one row per day."""
    days = F.arrays_zip(
        F.map_keys("temperatures").alias("date"), F.col("weather").alias("weather"),
        F.col("wind_position").alias("wind_position"), F.col("wind").alias("wind"),
    )
    rows = df.select("city", "update_time", "temperatures", F.posexplode(days).alias("day_no", "d"))
    temp = F.try_element_at("temperatures", F.col("d.date"))
    return rows.filter(F.col("d.date").isNotNull()).select(
        "city", "update_time", "day_no", "d.date", "d.weather", temp["low"].alias("low"), temp["high"].alias("high"),
        "d.wind_position", "d.wind",
    )


def join_list(items: Column, sep: str = ",") -> Column:
    return F.array_join(items, sep)


def export_projection(df: DataFrame, excerpt: int | None = None) -> DataFrame:
    """Comments as exported: ISO times, no raw record, content cut for display if asked."""
    content = F.col("content")
    if excerpt is not None:
        content = F.when(F.length(content) > excerpt, F.concat(F.substring(content, 1, excerpt), F.lit("..."))).otherwise(content)
    return df.select(
        "comment_id", "platform", content.alias("content"), "user_name", "user_id", "user_level", "like_count",
        "reply_count", F.date_format("publish_time", "yyyy-MM-dd'T'HH:mm:ss").alias("publish_time"), "ip_location",
        "is_reply", "parent_id",
    )


def derive_columns(df: DataFrame) -> DataFrame:
    """Length, emoji flag, hour, weekday (Monday 0) and date of each comment."""
    return df.withColumns({
        "content_length": F.length("content"), "has_emoji": F.col("content").rlike(tx.WIDE_EMOJI),
        "hour": F.hour("publish_time"), "weekday": F.weekday("publish_time"), "date": F.to_date("publish_time"),
    })


def numeric_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))
