"""Cleaning and completeness figures, basic statistics, time density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrisk.functions import text as tx


def cleaning_report(raw: DataFrame, scope: Sequence[str] = ("source_file",)) -> DataFrame:
    """Per scope: records read, parse errors, cleaned rows and what cleaning touched.

    ``raw`` has one row per input line with ``parse_error`` (null when parsed) and
    ``texts`` (the raw contents of its comment and replies). One pass over the lines.
    """
    rows = raw.select(*scope, "parse_error", F.posexplode_outer("texts").alias("_pos", "_raw"))
    known = F.coalesce(F.col("_raw"), F.lit(""))
    rows = rows.withColumns({"_bare": tx.strip_html(known), "_size": F.length(known)})
    bare = F.col("_bare")
    return rows.groupBy(*scope).agg(
        F.count_if(F.col("_pos") == 0).alias("total_raw"),
        F.count("parse_error").alias("errors"),
        F.count("_pos").alias("total_cleaned"),
        F.sum(F.col("_size") - F.length(bare)).alias("html_removed"),
        F.sum(tx.count_urls(bare)).alias("url_marked"),
        F.sum(tx.count_mentions(bare)).alias("mention_marked"),
        F.sum(tx.count_bracket_emoji(bare)).alias("emoji_normalized"),
        F.count_if(F.col("_size") > 0).alias("whitespace_normalized"),
    )


def platform_stats(cleaned: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return cleaned.groupBy(*scope, "platform").agg(F.count("*").alias("n"))


def quality_stats(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """How many rows carry region, time and level (level 0 counts as missing)."""
    named = F.nullif(F.col("ip_location"), F.lit(""))
    out = df.groupBy(*scope).agg(
        F.count("*").alias("total"),
        F.count(named).alias("with_ip"),
        F.count("publish_time").alias("with_time"),
        F.count_if(F.col("user_level") != 0).alias("with_user_level"),
        F.count_if("is_reply").alias("replies"),
    )
    ratios = ("with_ip", "with_time", "with_user_level", "replies")
    return out.withColumns({f"{name}_ratio": F.try_divide(name, "total") for name in ratios})


def basic_stats(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*scope).agg(
        F.count("*").alias("total_comments"), F.avg("like_count").alias("avg_like"), F.avg("reply_count").alias("avg_reply")
    )


def time_range(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*scope).agg(
        F.min("publish_time").alias("start"), F.max("publish_time").alias("end"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),  # a handful of names
    )


WITHIN_DAY = ("second", "minute", "hour")


def time_density(df: DataFrame, scope: Sequence[str] = (), unit: str = "hour") -> DataFrame:
    """Rows per time step from the first to the last one, empty steps as 0."""
    step = F.date_trunc(unit, "publish_time")
    counts = (
        df.filter(F.col("publish_time").isNotNull()).groupBy(*scope, step.alias("bucket")).agg(F.count("*").alias("n"))
    )
    span = counts.groupBy(*scope).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    every = F.expr(f"interval 1 {unit}")
    if unit in WITHIN_DAY:  # day by day, so that one far-off time doesn't make an array of all steps up to it
        day = F.date_trunc("day", "_lo")
        days = span.select(*scope, "_lo", "_hi", F.explode(F.sequence(day, F.col("_hi"), F.expr("interval 1 day"))).alias("_day"))
        until = F.least("_hi", F.col("_day") + F.expr("interval 1 day") - every)
        span = days.select(*scope, F.greatest("_lo", "_day").alias("_lo"), until.alias("_hi"))
    spine = span.select(*scope, F.explode(F.sequence("_lo", "_hi", every)).alias("bucket"))
    joined = spine.join(counts, [*scope, "bucket"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))
