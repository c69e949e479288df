"""Queries for text measures, identifiers and platform parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxrisk import views
from voxrisk.catalog import raw
from voxrisk.catalog import sqltext as st
from voxrisk.catalog.registry import long, q, query, sql_stamp, stamp
from voxrisk.functions import text as tx
from voxrisk.operators import prep, users
from voxrisk.sources import parsers, readers

PAGES = f"WITH {views.RAW_PAGES_SQL}"

_bare = st.strip_html("raw")


@query("clean_content", f"""{PAGES}
SELECT page_id, {st.clean('raw')} AS content, CAST(length({st.clean('raw')}) AS BIGINT) AS length,
  CAST({st.n_matches(_bare, tx.URL)} AS BIGINT) AS url_count, CAST({st.n_matches(_bare, tx.MENTION)} AS BIGINT) AS mention_count,
  CAST({st.n_matches(_bare, tx.BRACKET_EMOJI)} AS BIGINT) AS emoji_count,
  {st.n_matches(_bare, tx.URL)} > 0 AS has_url, {st.n_matches(_bare, tx.MENTION)} > 0 AS has_mention,
  {st.n_matches(_bare, tx.BRACKET_EMOJI)} > 0 AS has_emoji
FROM raw_pages""")
def clean_content(spark, sf_dir):
    pages = views.raw_pages(spark, sf_dir)
    rows = pages.select("page_id", tx.clean_content(F.col("raw")).alias("content"), tx.content_metadata(F.col("raw")).alias("m"))
    counts = [F.col(f"m.{c}").cast("bigint").alias(c) for c in ("length", "url_count", "mention_count", "emoji_count")]
    return rows.select("page_id", "content", *counts, "m.has_url", "m.has_mention", "m.has_emoji")


@query("strip_html", f"""{PAGES}
SELECT page_id, {_bare} AS bare, CAST(length(raw) - length({_bare}) AS BIGINT) AS removed FROM raw_pages""")
def strip_html(spark, sf_dir):
    return views.raw_pages(spark, sf_dir).select(
        "page_id", tx.strip_html(F.col("raw")).alias("bare"), tx.html_chars_removed(F.col("raw")).cast("bigint").alias("removed"))


def _counter(name, measure, pattern):
    @query(name, f"{PAGES} SELECT page_id, CAST({st.n_matches('raw', pattern)} AS BIGINT) AS n FROM raw_pages")
    def run(spark, sf_dir):
        return views.raw_pages(spark, sf_dir).select("page_id", measure(F.col("raw")).cast("bigint").alias("n"))
    return run


_counter("count_urls", tx.count_urls, tx.URL)
_counter("count_mentions", tx.count_mentions, tx.MENTION)
_counter("count_bracket_emoji", tx.count_bracket_emoji, tx.BRACKET_EMOJI)
_counter("count_unicode_emoji", tx.count_unicode_emoji, tx.UNICODE_EMOJI)


@query("normalize_whitespace", f"{PAGES} SELECT page_id, {st.collapse('raw')} AS content FROM raw_pages")
def normalize_whitespace(spark, sf_dir):
    return views.raw_pages(spark, sf_dir).select("page_id", tx.normalize_whitespace(F.col("raw")).alias("content"))


@query("repeated_punct", f"{PAGES} SELECT page_id, regexp_matches(raw, {q(tx.REPEATED_PUNCT)}) AS hit FROM raw_pages")
def repeated_punct(spark, sf_dir):
    return views.raw_pages(spark, sf_dir).select("page_id", tx.repeated_punct(F.col("raw")).alias("hit"))


@query("repeated_emoji", f"""{PAGES}
SELECT page_id, regexp_matches(raw, {q(tx.REPEATED_BRACKET_EMOJI)}) AS v2, regexp_matches(raw, {q(tx.REPEATED_UNICODE_EMOJI)}) AS v1
FROM raw_pages""")
def repeated_emoji(spark, sf_dir):
    return views.raw_pages(spark, sf_dir).select(
        "page_id", tx.repeated_emoji(F.col("raw"), "v2").alias("v2"), tx.repeated_emoji(F.col("raw"), "v1").alias("v1"))


@query("all_upper", r"""
SELECT doc_id, shouted, regexp_matches(t, '\p{Lu}') AND NOT regexp_matches(t, '[\p{Ll}\p{Lt}]') AND length(t) > 10 AS hit
FROM (SELECT doc_id, doc_id % 3 = 0 AS shouted, CASE WHEN doc_id % 3 = 0 THEN upper(text) ELSE text END AS t FROM documents)""")
def all_upper(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    shouted = F.col("doc_id") % 3 == 0
    text = F.when(shouted, F.upper("text")).otherwise(F.col("text"))
    return docs.select("doc_id", shouted.alias("shouted"), tx.all_upper(text).alias("hit"))


@query("name_pattern", f"""{st.ACTIVITY}
SELECT ord, user_name, CASE WHEN regexp_matches(user_name, {q(users.TIEBA_GUEST_NAME)}) THEN 'guest'
  WHEN regexp_matches(lower(user_name), '^(user_|bot_|auto_|test_|demo_)') THEN 'bot_prefix'
  WHEN regexp_matches(user_name, '^[0-9]+$') THEN 'digits'
  WHEN regexp_matches(user_name, '^[a-zA-Z0-9_]{{8,}}$') THEN 'long_alnum'
  WHEN regexp_matches(user_name, '^[a-zA-Z0-9]+$') THEN 'alnum' ELSE 'other' END AS pattern
FROM activity""")
def name_pattern(spark, sf_dir):
    return views.activity(spark, sf_dir).select("ord", "user_name", users.name_pattern(F.col("user_name")).alias("pattern"))


@query("parse_human_count", r"""
SELECT event_id, t AS shown, CAST(coalesce(trunc(TRY_CAST(nullif(regexp_extract(t, '(\d+\.?\d*)([wm]?)', 1), '') AS DOUBLE)
  * CASE regexp_extract(t, '(\d+\.?\d*)([wm]?)', 2) WHEN 'w' THEN 10000 WHEN 'm' THEN 1000000 ELSE 1 END), 0) AS BIGINT) AS n
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'likes ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
    WHEN 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.5w'
    WHEN 2 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'm' ELSE 'none' END AS t FROM events)""")
def parse_human_count(spark, sf_dir):
    whole = F.floor("value").cast("bigint").cast("string")
    kind = F.col("event_id") % 4
    shown = (
        F.when(kind == 0, F.concat(F.lit("likes "), whole)).when(kind == 1, F.concat(whole, F.lit(".5w")))
        .when(kind == 2, F.concat(whole, F.lit("m"))).otherwise("none")
    )
    rows = views.table(spark, sf_dir, "events").select("event_id", shown.alias("shown"))
    return rows.withColumn("n", tx.parse_human_count(F.col("shown")))


_URL_SQL = """CASE page_id % 4 WHEN 0 THEN 'https://www.bilibili.com/video/BV1x' || page_id || 'Z?p=1'
    WHEN 1 THEN 'https://tieba.baidu.com/p/' || page_id || '?pn=2'
    WHEN 2 THEN 'https://www.douyin.com/user/x?modal_id=' || page_id
    ELSE '看看 https://v.douyin.com/a_' || page_id || '-b/ ' || url END"""


@query("extract_ids", rf"""
SELECT page_id, nullif(regexp_extract(u, 'BV[a-zA-Z0-9]+'), '') AS bv, nullif(regexp_extract(u, '/p/(\d+)', 1), '') AS post,
  nullif(regexp_extract(u, '(?:video/|modal_id=)(\d+)', 1), '') AS video,
  coalesce(regexp_replace(nullif(regexp_extract(u, 'https?://v\.douyin\.com/[\p{{L}}\p{{N}}_-]+/?'), ''), '/+$', ''),
    'https://www.douyin.com/video/' || nullif(regexp_extract(u, '(?:video/|modal_id=)(\d+)', 1), ''), u) AS canonical
FROM (SELECT page_id, {_URL_SQL} AS u FROM pages)""")
def extract_ids(spark, sf_dir):
    n, text = F.col("page_id") % 4, F.col("page_id").cast("string")
    shown = (
        F.when(n == 0, F.concat(F.lit("https://www.bilibili.com/video/BV1x"), text, F.lit("Z?p=1")))
        .when(n == 1, F.concat(F.lit("https://tieba.baidu.com/p/"), text, F.lit("?pn=2")))
        .when(n == 2, F.concat(F.lit("https://www.douyin.com/user/x?modal_id="), text))
        .otherwise(F.concat(F.lit("看看 https://v.douyin.com/a_"), text, F.lit("-b/ "), F.col("url")))
    )
    u = F.col("u")
    return views.table(spark, sf_dir, "pages").withColumn("u", shown).select(
        "page_id", tx.bv_id(u).alias("bv"), tx.post_id(u).alias("post"), tx.video_id(u).alias("video"),
        tx.canonical_video_url(u).alias("canonical"))


@query("extract_time_parts", """
SELECT event_id, strftime(ts, '%H:%M') AS hm, strftime(ts, '%Y-%m-%d') AS ymd, strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d') AS later
FROM events""")
def extract_time_parts(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(
        "event_id", F.date_format("ts", "HH:mm:ss").alias("t"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("d"))
    return rows.select("event_id", tx.time_prefix(F.col("t")).alias("hm"), tx.date_prefix(F.col("d")).alias("ymd"),
                       tx.shift_date(F.col("d"), 7).alias("later"))


_VISIBLE = st.collapse(
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), "
    "'(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')")


@query("extract_html_fields", rf"""
SELECT page_id, {_VISIBLE} AS visible,
  array_to_string(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), '|') AS links,
  array_to_string(regexp_extract_all(html, '(?i)<img\s[^>]*src="([^"]*)"', 1), '|') AS images
FROM pages""")
def extract_html_fields(spark, sf_dir):
    html = F.col("html")
    return views.table(spark, sf_dir, "pages").select(
        "page_id", tx.html_text(html).alias("visible"), F.array_join(tx.html_links(html), "|").alias("links"),
        F.array_join(tx.html_images(html), "|").alias("images"))


# --- parsers -------------------------------------------------------------------

_MARKED = "'<b>' || content || '</b> [doge]' || chr(9) || ' @reader '"
_FIELDS = ("comment_id", "platform", "content", "user_name", "user_id", "ip_location", "is_reply", "parent_id", "source_url")


def _shown(comments):
    return comments.select(*_FIELDS, stamp("publish_time"), *long("ord", "user_level", "like_count", "reply_count"))


def _parsed(spark, sf_dir, platform):
    return _shown(parsers.parse_lines(raw.lines(spark, sf_dir, platform)))


def _expected(platform: str, main: str, reply: str | None) -> str:
    columns = ("comment_id, platform, content, user_name, user_id, ip_location, is_reply, parent_id, source_url, "
               "publish_time, ord, user_level, like_count, reply_count")
    union = f" UNION ALL SELECT {columns} FROM ({reply})" if reply else ""
    return f"""{st.COMMENTS},
src AS (SELECT *, {st.clean(_MARKED)} AS cleaned FROM comments)
SELECT {columns} FROM ({main}){union}"""


_BILI_ID = "CASE WHEN ord % 2 = 0 AND ord > 0 THEN comment_id ELSE 'bili_' || substr(md5(cleaned), 1, 12) END"


@query("parse_bilibili", _expected("bilibili", f"""
  SELECT {_BILI_ID} AS comment_id, 'bilibili' AS platform, cleaned AS content, user_name, nullif(user_id, '0') AS user_id,
    ip_location, false AS is_reply, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS source_url, {sql_stamp("publish_time")} AS publish_time,
    ord * 65536 AS ord, CAST(user_level AS BIGINT) AS user_level, like_count, reply_count FROM src""", f"""
  SELECT {_BILI_ID} || '_reply_0' AS comment_id, 'bilibili' AS platform, {st.clean('content')} AS content,
    CASE WHEN ord % 2 = 0 THEN 'r_' || user_name ELSE user_name END AS user_name, CAST(NULL AS VARCHAR) AS user_id, ip_location,
    true AS is_reply, {_BILI_ID} AS parent_id, CAST(NULL AS VARCHAR) AS source_url, CAST(NULL AS VARCHAR) AS publish_time, ord * 65536 AS ord,
    CASE WHEN ord % 2 = 0 THEN 5 ELSE 2 END AS user_level, like_count % 3 AS like_count, 0 AS reply_count
  FROM src WHERE ord % 3 = 0"""))
def parse_bilibili(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, "bilibili")
    return parsed.withColumn("ord", (F.shiftright("ord", 16) * 65536))


@query("parse_tieba", _expected("tieba", f"""
  SELECT comment_id, 'tieba' AS platform, cleaned AS content, user_name, user_id, ip_location, false AS is_reply,
    CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS source_url, strftime(date_trunc('minute', publish_time), '%Y-%m-%d %H:%M:%S') AS publish_time,
    ord * 65536 AS ord, CAST(NULL AS BIGINT) AS user_level, CAST(0 AS BIGINT) AS like_count, CAST(1 AS BIGINT) AS reply_count FROM src""", f"""
  SELECT comment_id || '_sub_0' AS comment_id, 'tieba' AS platform, {st.clean('content')} AS content, user_name, CAST(NULL AS VARCHAR) AS user_id,
    '未知' AS ip_location, true AS is_reply, comment_id AS parent_id, CAST(NULL AS VARCHAR) AS source_url, CAST(NULL AS VARCHAR) AS publish_time,
    ord * 65536 + 1 AS ord, CAST(NULL AS BIGINT) AS user_level, 0 AS like_count, 0 AS reply_count FROM src"""))
def parse_tieba(spark, sf_dir):
    return _parsed(spark, sf_dir, "tieba")


@query("parse_zhihu", _expected("zhihu", f"""
  SELECT 'zhihu_' || substr(md5(substr(cleaned, 1, 100)), 1, 12) AS comment_id, 'zhihu' AS platform, cleaned AS content, user_name,
    CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS ip_location, false AS is_reply, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS source_url,
    {sql_stamp("publish_time")} AS publish_time, ord * 65536 AS ord, CAST(NULL AS BIGINT) AS user_level, like_count,
    CAST(0 AS BIGINT) AS reply_count FROM src""", None))
def parse_zhihu(spark, sf_dir):
    return _parsed(spark, sf_dir, "zhihu")


@query("parse_douyin", _expected("douyin", f"""
  SELECT comment_id, 'douyin' AS platform, cleaned AS content, user_name, '' AS user_id, ip_location, is_reply, parent_id,
    CAST(NULL AS VARCHAR) AS source_url, {sql_stamp("publish_time")} AS publish_time, ord * 65536 AS ord, CAST(NULL AS BIGINT) AS user_level,
    like_count, reply_count FROM src""", None))
def parse_douyin(spark, sf_dir):
    return _parsed(spark, sf_dir, "douyin")


@query("flatten_replies", f"""{st.COMMENTS}
SELECT comment_id AS parent_id, comment_id || '_sub_0' AS comment_id, user_name, content AS raw_content FROM comments""")
def flatten_replies(spark, sf_dir):
    arrays = parsers.comment_arrays(parsers.parsed_lines(raw.lines(spark, sf_dir, "tieba")), clean=False)
    rows = parsers.flatten(arrays, clean=False).filter("is_reply")
    return rows.select("parent_id", "comment_id", "user_name", F.col("content").alias("raw_content"))


@query("strip_ip_prefix", f"""{st.COMMENTS}
SELECT ord, CASE WHEN ord % 10 = 0 THEN NULL ELSE ip_location END AS bare,
  CASE WHEN ord % 10 = 0 THEN '未知' ELSE coalesce(ip_location, '未知') END AS filled FROM comments""")
def strip_ip_prefix(spark, sf_dir):
    ip = F.when(F.col("ord") % 10 != 0, F.concat(F.lit(tx.IP_PREFIX), "ip_location"))
    return views.comments(spark, sf_dir).select(
        "ord", tx.strip_ip_prefix(ip).alias("bare"), tx.strip_ip_prefix(ip, "未知").alias("filled"))


@query("generate_comment_id", """
SELECT doc_id, 'bili_' || substr(md5(text), 1, 12) AS bili_id, 'zhihu_' || substr(md5(substr(text, 1, 100)), 1, 12) AS zhihu_id
FROM documents""")
def generate_comment_id(spark, sf_dir):
    text = F.col("text")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", tx.short_hash_id("bili_", text).alias("bili_id"),
        tx.short_hash_id("zhihu_", F.substring(text, 1, 100)).alias("zhihu_id"))


@query("derive_columns", f"""{st.COMMENTS}
SELECT ord, CAST(length(content) AS BIGINT) AS content_length, regexp_matches(content, {q(tx.WIDE_EMOJI)}) AS has_emoji,
  hour(publish_time) AS hour, isodow(publish_time) - 1 AS weekday, strftime(publish_time, '%Y-%m-%d') AS date FROM comments""")
def derive_columns(spark, sf_dir):
    rows = parsers.derive_columns(views.comments(spark, sf_dir))
    return rows.select(*long("ord", "content_length"), "has_emoji", *long("hour", "weekday"), F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("flatten_json_normalize", f"""{st.COMMENTS}
SELECT user_name, CAST(user_level AS BIGINT) AS user_level, coalesce(ip_location, '未知') AS user_ip, like_count, {sql_stamp('publish_time')} AS ctime, ord FROM comments""")
def flatten_json_normalize(spark, sf_dir):
    parsed = parsers.parsed_lines(raw.lines(spark, sf_dir, "bilibili"))
    record, author = F.col("record"), F.col("record.user")
    return parsed.select(
        parsers.of_author(author, "name").alias("user_name"), parsers.whole(parsers.of_author(author, "level")).alias("user_level"),
        tx.strip_ip_prefix(parsers.of_author(author, "ip"), "未知").alias("user_ip"), parsers.or_zero(record["like"]).alias("like_count"),
        F.date_format(parsers.seconds(record["ctime"]), "yyyy-MM-dd HH:mm:ss").alias("ctime"), F.shiftright("ord", 16).alias("ord"))


@query("numeric_coerce", r"""
SELECT event_id, coalesce(TRY_CAST(t AS DOUBLE), 0) AS number, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at
FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS t FROM events)""")
def numeric_coerce(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.floor("value").cast("bigint").cast("string"))
    epoch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return views.table(spark, sf_dir, "events").select(
        "event_id", parsers.numeric_or_zero(text).alias("number"),
        F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("export_projection", f"""{st.COMMENTS}
SELECT comment_id, platform, CASE WHEN length(content) > 50 THEN substr(content, 1, 50) || '...' ELSE content END AS content,
  user_name, user_id, CAST(user_level AS BIGINT) AS user_level, like_count, reply_count, strftime(publish_time, '%Y-%m-%dT%H:%M:%S') AS publish_time, ip_location,
  is_reply, parent_id FROM comments""")
def export_projection(spark, sf_dir):
    rows = parsers.export_projection(views.comments(spark, sf_dir), excerpt=50)
    return rows.withColumn("user_level", F.col("user_level").cast("bigint"))


@query("merge_dedupe_replies", """
SELECT parent_id, ord, content FROM (
  SELECT conv_id AS parent_id, turn AS ord, role AS content, row_number() OVER (PARTITION BY conv_id, role ORDER BY page, turn) AS rn
  FROM (SELECT *, 0 AS page FROM conversations WHERE turn < 4 UNION ALL SELECT *, 1 AS page FROM conversations WHERE turn >= 2)) WHERE rn = 1""")
def merge_dedupe_replies(spark, sf_dir):
    talk = views.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("parent_id"), F.col("turn").alias("ord"), F.col("role").alias("content"))
    merged = prep.merge_dedupe_replies(talk.filter("ord < 4"), talk.filter("ord >= 2"))
    return merged.select("parent_id", "ord", "content")


@query("detect_platform_path", """
SELECT page_id, CASE WHEN contains(lower(p), 'bili') THEN 'bilibili' WHEN contains(lower(p), 'tieba') OR contains(lower(p), 'tid_') THEN 'tieba'
  WHEN contains(lower(p), 'zhihu') THEN 'zhihu' WHEN contains(lower(p), 'douyin') OR contains(lower(p), 'tiktok') THEN 'douyin' END AS platform
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/data/Bili_' WHEN 1 THEN '/data/TID_' WHEN 2 THEN '/data/Zhihu/' WHEN 3 THEN '/data/tiktok/'
  ELSE '/data/x' END || url AS p FROM pages)""")
def detect_platform_path(spark, sf_dir):
    n = F.col("page_id") % 5
    head = F.when(n == 0, "/data/Bili_").when(n == 1, "/data/TID_").when(n == 2, "/data/Zhihu/").when(n == 3, "/data/tiktok/").otherwise("/data/x")
    return views.table(spark, sf_dir, "pages").select("page_id", readers.platform_of_path(F.concat(head, "url")).alias("platform"))


@query("detect_platform_content", f"""{st.COMMENTS}
SELECT p.platform AS told, CAST(count(*) AS BIGINT) AS n FROM comments
CROSS JOIN (VALUES ('bilibili'), ('tieba'), ('zhihu'), ('unknown')) p(platform) GROUP BY 1""")
def detect_platform_content(spark, sf_dir):
    feeds = [raw.lines(spark, sf_dir, name) for name in ("bilibili", "tieba", "zhihu", "douyin")]
    lines = feeds[0].unionByName(feeds[1]).unionByName(feeds[2]).unionByName(feeds[3])
    return lines.groupBy(readers.platform_of_record(F.col("line")).alias("told")).agg(F.count("*").alias("n"))


@query("reindex_columns", f"""{st.COMMENTS}
SELECT comment_id, '' AS rating, coalesce(parent_id, '') AS parent_id, CAST(like_count AS VARCHAR) AS like_count FROM comments""")
def reindex_columns(spark, sf_dir):
    return parsers.reindex_columns(views.comments(spark, sf_dir), ["comment_id", "rating", "parent_id", "like_count"])


@query("flatten_forecast", """
SELECT 'city' || c_custkey AS city, CAST(d AS BIGINT) AS day_no, '2024-01-0' || (d + 1) AS date, c_mktsegment || d AS weather,
  c_custkey % 30 + d AS low, c_custkey % 30 + d + 8 AS high, 'wind' || (c_custkey + d) % 4 AS wind
FROM customer CROSS JOIN (VALUES (0), (1), (2)) t(d)""")
def flatten_forecast(spark, sf_dir):
    key = F.col("c_custkey")
    days = [F.lit(f"2024-01-0{d + 1}") for d in range(3)]
    temps = F.create_map(*[x for d, day in enumerate(days) for x in (
        day, F.struct((key % 30 + d).alias("low"), (key % 30 + d + 8).alias("high")))])
    records = views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("city"), key.cast("string")).alias("city"), F.lit("08:00").alias("update_time"),
        temps.alias("temperatures"),
        F.array(*[F.concat("c_mktsegment", F.lit(str(d))) for d in range(3)]).alias("weather"),
        F.array(*[F.concat(F.lit("wind"), ((key + d) % 4).cast("string")) for d in range(3)]).alias("wind"),
        F.array(*[F.lit("N") for _ in range(3)]).alias("wind_position"),
    )
    rows = parsers.flatten_forecast(records)
    return rows.select("city", *long("day_no"), "date", "weather", "low", "high", "wind")


@query("join_list_column", r"""
SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), ',') AS images FROM pages""")
def join_list_column(spark, sf_dir):
    links = tx.html_links(F.col("html"))
    return views.table(spark, sf_dir, "pages").select("page_id", parsers.join_list(links).alias("images"))
