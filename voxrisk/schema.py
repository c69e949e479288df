"""Row shapes: the unified comment and the raw feed of each platform."""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T

_METADATA = (
    "length: INT, has_emoji: BOOLEAN, has_url: BOOLEAN, has_mention: BOOLEAN, "
    "emoji_count: INT, url_count: INT, mention_count: INT"
)

COMMENT_DDL = (
    "comment_id STRING, platform STRING, content STRING, user_name STRING, "
    "user_id STRING, user_level INT, like_count BIGINT, reply_count BIGINT, "
    "publish_time TIMESTAMP, ip_location STRING, is_reply BOOLEAN, parent_id STRING, "
    f"source_url STRING, content_metadata STRUCT<{_METADATA}>, "
    "source_file STRING, ord BIGINT"
)

COMMENT_COLUMNS = (
    "comment_id", "platform", "content", "user_name", "user_id", "user_level", "like_count", "reply_count",
    "publish_time", "ip_location", "is_reply", "parent_id", "source_url", "content_metadata", "source_file", "ord",
)


@cache
def struct(ddl: str) -> T.StructType:
    """Parsed DDL; needs a running session."""
    return T.StructType.fromDDL(ddl)


# Feeds disagree on the types of one field (5, "5", 5.0, null), so every scalar is read as STRING and converted field
# by field. An author arrives as an object or as a plain name: from_json keeps the raw text of an object in a STRING.
BILIBILI_RAW = (
    "comment STRING, `like` STRING, reply_count STRING, ctime STRING, rpid STRING, id STRING, user STRING, "
    "replies ARRAY<STRUCT<comment: STRING, `like`: STRING, user: STRING, level: STRING, ip: STRING, id: STRING>>"
)

TIEBA_RAW = (
    "pid STRING, floor STRING, user_id STRING, author STRING, ip_location STRING, content STRING, total_lzl STRING, "
    "has_more_lzl STRING, images STRING, time STRING, "
    "sub_replies ARRAY<STRUCT<user: STRING, text: STRING, author: STRING, content: STRING, "
    "ip_location: STRING, time: STRING>>"
)

ZHIHU_RAW = "type STRING, content STRING, author STRING, ip STRING, vote STRING, time STRING, url STRING"

DOUYIN_RAW = (
    "cid STRING, reply_id STRING, text STRING, content STRING, nickname STRING, user_name STRING, "
    "user_id STRING, digg_count STRING, like_count STRING, reply_total STRING, "
    "reply_comment_total STRING, create_time STRING, ip_label STRING, ip_location STRING, is_reply STRING"
)
