"""Raw platform feeds built from the comment view, for the parse and scan queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrisk import views


def _epoch() -> Column:
    return F.floor(F.unix_micros("publish_time") / 1000000).cast("bigint")


def _marked(text: Column) -> Column:
    return F.concat(F.lit("<b>"), text, F.lit("</b> [doge]\t @reader ")).alias("marked")


def records(spark: SparkSession, sf_dir: str, platform: str, comments: DataFrame | None = None) -> DataFrame:
    """(ord, line): one JSON record per comment of the platform's crawler shape. ``comments`` are those of the view, if already made."""
    rows = (views.comments(spark, sf_dir) if comments is None else comments).withColumn("marked", _marked(F.col("content")))
    ip = F.concat(F.lit("IP属地："), F.col("ip_location"))
    if platform == "bilibili":
        def reply(user: Column) -> Column:
            return F.struct(
                F.col("content").alias("comment"), (F.col("like_count") % 3).alias("like"), user.alias("user"),
                F.lit(2).alias("level"), ip.alias("ip"),
            )
        named = F.struct(F.concat(F.lit("r_"), "user_name").alias("name"), F.lit(5).alias("level"))
        replies = {True: reply(named), False: reply(F.col("user_name"))}
        lines = []
        for as_object, one in replies.items():
            lines.append(F.to_json(F.struct(
                F.col("marked").alias("comment"), F.col("like_count").alias("like"), "reply_count",
                _epoch().alias("ctime"), F.when(F.col("ord") % 2 == 0, F.col("comment_id")).alias("rpid"),
                F.struct(F.col("user_name").alias("name"), F.col("user_level").alias("level"), ip.alias("ip"),
                         F.col("user_id").cast("bigint").alias("mid")).alias("user"),
                F.when(F.col("ord") % 3 == 0, F.array(one)).alias("replies"),
            )))
        line = F.when(F.col("ord") % 2 == 0, lines[0]).otherwise(lines[1])
    elif platform == "tieba":
        sub = F.struct(F.col("user_name").alias("user"), F.col("content").alias("text"), F.lit("未知").alias("ip_location"), F.lit("未知").alias("time"))
        line = F.to_json(F.struct(
            F.col("ord").alias("pid"), F.lit(1).alias("floor"), F.col("user_id").cast("bigint").alias("user_id"),
            F.col("user_name").alias("author"), "ip_location", F.col("marked").alias("content"),
            F.array(sub).alias("sub_replies"), F.lit(1).alias("total_lzl"),
            F.date_format("publish_time", "yyyy-MM-dd HH:mm").alias("time"),
        ))
    elif platform == "zhihu":
        line = F.to_json(F.struct(
            F.lit("comment").alias("type"), F.col("marked").alias("content"), F.col("user_name").alias("author"),
            F.lit("未知IP").alias("ip"), F.col("like_count").alias("vote"),
            F.date_format("publish_time", "yyyy-MM-dd HH:mm:ss").alias("time"),
        ))
    else:
        line = F.to_json(F.struct(
            F.col("comment_id").alias("cid"), F.col("marked").alias("text"), F.col("user_name").alias("nickname"),
            F.col("like_count").alias("digg_count"), _epoch().alias("create_time"), F.col("ip_location").alias("ip_label"),
            F.col("reply_count").alias("reply_total"), "is_reply", F.col("parent_id").alias("reply_id"),
        ))
    return rows.select("ord", line.alias("line"))


def lines(spark: SparkSession, sf_dir: str, platform: str) -> DataFrame:
    """The records as the readers hand them to the parsers (16 low bits of ``ord`` free)."""
    return records(spark, sf_dir, platform).select(
        "line", F.lit(f"{platform}.jsonl").alias("source_file"), F.shiftleft("ord", 16).alias("ord"),
        F.lit(platform).alias("platform"),
    )
