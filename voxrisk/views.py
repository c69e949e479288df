"""The given tables seen as comment data.

``comments``: documents carry the text, events the author, time and likes,
customer and nation the name and region. ``activity``: events alone, a longer and
denser time line. ``raw_pages``: page markup with its address, as raw content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrisk.functions.lexicon import Profile


# Latin word lists for the given texts; the defaults are Chinese.
LATIN_POSITIVE = (
    " was ", " with ", " from ", " pour ", " avec ", " für ", " auf ", " para ", " las ", "thble", "erin",
)
LATIN_NEGATIVE = (
    " are ", " that ", " dans ", " sur ", " nicht ", " mit ", " los ", " por ", "rewh", "thsh", "erhe",
)
LATIN_SENSITIVE = (
    ("orre", "rumor"), ("thatin", "rumor"), ("ononst", "rumor"),
    ("hehely", "attack"), ("inoran", "attack"), ("password", "attack"),
    ("orantion", "incitement"), ("thth", "incitement"),
    ("eeux", "extreme"), ("ichaul", "extreme"), ("ciónción", "extreme"),
)
LATIN_STOPWORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "be", "as", "by",
    "de", "la", "der", "en", "die", "que", "le", "et", "les", "un", "el", "und", "des",
)

LATIN_V2 = Profile("v2", LATIN_POSITIVE, LATIN_NEGATIVE, LATIN_SENSITIVE, LATIN_STOPWORDS,
                   topic_sensitive=("orre", "thatin", "hehely", "thth", "eeux"),
                   concentration=("orre", "thatin", "ononst", "hehely", "inoran"),
                   overseas=("NATION_1", "NATION_2", "NATION_3"))
LATIN_V1 = Profile("v1", LATIN_POSITIVE[:8], LATIN_NEGATIVE[:8],
                   tuple((w, "") for w, _ in LATIN_SENSITIVE[:7]), LATIN_STOPWORDS,
                   topic_sensitive=LATIN_V2.topic_sensitive,
                   concentration=LATIN_V2.concentration, overseas=LATIN_V2.overseas)


# Read schemas of the given tables; naming them saves a look into every file.
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _platform(lang: Column) -> Column:
    return (
        F.when(lang == "en", "bilibili").when(lang == "de", "tieba").when(lang == "fr", "zhihu").otherwise("douyin")
    )


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").drop("n_nationkey", "c_nationkey")


def _user_name() -> Column:
    uid = F.col("e_user")
    kind = uid % 4
    return (
        F.when(kind == 0, F.concat(F.lit("user_"), uid.cast("string")))
        .when(kind == 1, F.lpad(uid.cast("string"), 10, "0"))
        .when(kind == 2, F.col("c_name"))
        .otherwise(F.concat(F.col("c_mktsegment"), uid.cast("string")))
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("e_user"), "ts", "value"
    )
    people = _people(spark, sf_dir)
    # authors are joined to the narrow side, so the text is moved by document only and
    # never by author, of whom one may have written much of the table
    authored = events.join(people, F.col("e_user") == people.c_custkey, "left").drop("c_custkey")
    reply = F.col("doc_id") % 5 == 4
    # a merge join deals the text out by document, as it must be when both sides are large,
    # and keeps the costly work parallel also where the file is a single piece
    return (
        docs.join(authored.hint("merge"), docs.doc_id == authored.event_id)
        .select(
            F.col("doc_id").cast("string").alias("comment_id"),
            _platform(F.col("lang")).alias("platform"),
            F.col("text").alias("content"),
            _user_name().alias("user_name"),
            F.col("e_user").cast("string").alias("user_id"),
            (F.col("e_user") % 7).cast("int").alias("user_level"),
            F.floor("value").cast("bigint").alias("like_count"),
            (F.col("n_chars") % 5).cast("bigint").alias("reply_count"),
            F.col("ts").cast("timestamp").alias("publish_time"),
            F.col("n_name").alias("ip_location"),
            reply.alias("is_reply"),
            F.when(reply, (F.col("doc_id") - 4).cast("string")).alias("parent_id"),
            F.lit(None).cast("string").alias("source_url"),
            F.col("source").alias("source_file"),
            F.col("doc_id").alias("ord"),
        )
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "e_user")
    people = _people(spark, sf_dir)
    return events.join(people, F.col("e_user") == people.c_custkey, "left").select(
        F.col("event_id").cast("string").alias("comment_id"),
        F.lit("bilibili").alias("platform"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        _user_name().alias("user_name"),
        F.col("e_user").cast("string").alias("user_id"),
        (F.col("e_user") % 7).cast("int").alias("user_level"),
        F.floor("value").cast("bigint").alias("like_count"),
        F.lit(0).cast("bigint").alias("reply_count"),
        F.col("ts").cast("timestamp").alias("publish_time"),
        F.col("n_name").alias("ip_location"),
        F.lit(False).alias("is_reply"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("string").alias("source_url"),
        F.col("event_type").alias("source_file"),
        F.col("event_id").alias("ord"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page markup followed by its address, a mention, bracket emoji and marks."""
    pages = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    raw = F.concat(
        F.col("html"), F.lit(" "), F.col("url"), F.lit(" @reader"), n.cast("string"), F.lit("é张 "),
        F.repeat(F.lit("[doge]"), (n % 4).cast("int")), F.lit("　\n"),
        F.repeat(F.lit("\U0001F600"), (n % 5).cast("int")), F.lit(" "),
        F.repeat(F.lit("！"), (n % 4).cast("int")),
    )
    return pages.select("page_id", "url", "html", raw.alias("raw"))


# --- The same views for the DuckDB comparison ----------------------------------

PEOPLE_SQL = """
people AS (
  SELECT c.c_custkey, c.c_name, c.c_mktsegment, n.n_name
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

_NAME_SQL = """CASE e.user_id % 4
      WHEN 0 THEN 'user_' || e.user_id
      WHEN 1 THEN lpad(CAST(e.user_id AS VARCHAR), 10, '0')
      WHEN 2 THEN p.c_name ELSE p.c_mktsegment || e.user_id END"""

COMMENTS_SQL = PEOPLE_SQL + f""",
comments AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS comment_id,
    CASE d.lang WHEN 'en' THEN 'bilibili' WHEN 'de' THEN 'tieba' WHEN 'fr' THEN 'zhihu' ELSE 'douyin' END AS platform,
    d.text AS content, {_NAME_SQL} AS user_name,
    CAST(e.user_id AS VARCHAR) AS user_id, CAST(e.user_id % 7 AS INTEGER) AS user_level,
    CAST(floor(e.value) AS BIGINT) AS like_count, d.n_chars % 5 AS reply_count,
    e.ts AS publish_time, p.n_name AS ip_location, d.doc_id % 5 = 4 AS is_reply,
    CASE WHEN d.doc_id % 5 = 4 THEN CAST(d.doc_id - 4 AS VARCHAR) END AS parent_id,
    d.source AS source_file, d.doc_id AS ord
  FROM documents d JOIN events e ON d.doc_id = e.event_id
  LEFT JOIN people p ON e.user_id = p.c_custkey)"""

ACTIVITY_SQL = PEOPLE_SQL + f""",
activity AS (
  SELECT CAST(e.event_id AS VARCHAR) AS comment_id, 'bilibili' AS platform,
    e.event_type || ' ' || e.props AS content, {_NAME_SQL} AS user_name,
    CAST(e.user_id AS VARCHAR) AS user_id, CAST(e.user_id % 7 AS INTEGER) AS user_level,
    CAST(floor(e.value) AS BIGINT) AS like_count, e.ts AS publish_time,
    p.n_name AS ip_location, e.event_type AS source_file, e.event_id AS ord
  FROM events e LEFT JOIN people p ON e.user_id = p.c_custkey)"""

RAW_PAGES_SQL = """
raw_pages AS (
  SELECT page_id, url, html, html || ' ' || url || ' @reader' || page_id || 'é张 ' ||
    repeat('[doge]', CAST(page_id % 4 AS INTEGER)) || chr(12288) || chr(10) ||
    repeat(chr(128512), CAST(page_id % 5 AS INTEGER)) || ' ' || repeat('！', CAST(page_id % 4 AS INTEGER)) AS raw
  FROM pages)"""
