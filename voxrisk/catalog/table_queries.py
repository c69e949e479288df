"""Queries for sources and sinks, table preparation, models and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxrisk import views
from voxrisk.catalog import raw
from voxrisk.catalog import sqltext as st
from voxrisk.catalog.comment_queries import scored
from voxrisk.catalog.registry import long, query, r6, stamp
from voxrisk.catalog.report_queries import STAMP, report_two
from voxrisk.functions import text as tx
from voxrisk.operators import distinct, forest, models, prep, quality
from voxrisk.plans import reports
from voxrisk.session import scratch_path, settle
from voxrisk.sources import parsers, readers, writers
from voxrisk.streaming import spikes, streams

# --- sources and sinks -----------------------------------------------------------


def _feed(spark, sf_dir, *platforms, broken: bool = False) -> str:
    """Raw JSONL folders of some platforms below a new path. Texts and authors are joined once for all of them, and files are packed."""
    path = scratch_path(spark, "feed")
    comments = settle(views.comments(spark, sf_dir), "feed-comments") if len(platforms) > 1 else None
    for name in platforms:
        lines = raw.records(spark, sf_dir, name, comments)
        if broken:
            bad = F.when(F.col("ord") % 10 == 0, F.lit('{"comment": "cut off')).when(F.col("ord") % 10 == 1, F.lit("  "))
            lines = lines.withColumn("line", F.coalesce(bad, "line"))
        lines.select("line").write.mode("overwrite").option("compression", "gzip").text(f"{path}/{name}.jsonl")
    return path


_CLEANED = st.clean("'<b>' || content || '</b> [doge]' || chr(9) || ' @reader '")


@query("scan_jsonl", f"""{st.COMMENTS}
SELECT comment_id, 'tieba' AS platform, {_CLEANED} AS content, user_name, ip_location, false AS is_reply FROM comments
UNION ALL SELECT comment_id || '_sub_0', 'tieba', {st.clean('content')}, user_name, '未知', true FROM comments""")
def scan_jsonl(spark, sf_dir):
    path = _feed(spark, sf_dir, "tieba")
    rows = readers.scan_jsonl(spark, f"{path}/tieba.jsonl")
    return rows.select("comment_id", "platform", "content", "user_name", "ip_location", "is_reply")


@query("scan_dir", f"""{st.COMMENTS}
SELECT platform, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars FROM (
  SELECT 'douyin' AS platform, {_CLEANED} AS c FROM comments UNION ALL SELECT 'zhihu', {_CLEANED} FROM comments
  UNION ALL SELECT 'tieba', {_CLEANED} FROM comments UNION ALL SELECT 'tieba', {st.clean('content')} FROM comments
  UNION ALL SELECT 'bilibili', {_CLEANED} FROM comments UNION ALL SELECT 'bilibili', {st.clean('content')} FROM comments WHERE ord % 3 = 0)
GROUP BY 1""")
def scan_dir(spark, sf_dir):
    path = _feed(spark, sf_dir, "bilibili", "tieba", "zhihu", "douyin")
    rows = readers.scan_dir(spark, path, pattern="*.txt.gz")
    return rows.groupBy("platform").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("scan_csv", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.sink_csv(views.table(spark, sf_dir, "customer"), path)
    return readers.scan_csv(spark, path, views.SCHEMAS["customer"])


@query("scan_json_array", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_json_array(spark, sf_dir):
    path = scratch_path(spark, "array")
    rows = views.table(spark, sf_dir, "nation")
    # one array per region, so that no array grows with the table
    groups = rows.groupBy("n_regionkey", "n_nationkey").agg(F.first("n_name").alias("n_name"))
    arrays = groups.select(F.to_json(F.array(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"), "n_nationkey")
    arrays.repartition("n_nationkey").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.scan_json_array(spark, path, views.SCHEMAS["nation"])


@query("bad_records", f"""{st.COMMENTS}
SELECT 'malformed JSON' AS parse_error, '{{"comment": "cut off' AS line, count(*) AS n FROM comments WHERE ord % 10 = 0 GROUP BY 1, 2""")
def bad_records(spark, sf_dir):
    path = _feed(spark, sf_dir, "douyin", broken=True)
    lines = readers.with_platform(readers.read_lines(spark, f"{path}/douyin.jsonl"))
    return parsers.bad_records(lines).groupBy("parse_error", "line").agg(F.count("*").alias("n"))


@query("sink_jsonl", f"{st.COMMENTS} SELECT comment_id, like_count, count(*) AS n FROM (SELECT * FROM comments UNION ALL SELECT * FROM comments) GROUP BY 1, 2")
def sink_jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    rows = views.comments(spark, sf_dir).select("comment_id", "like_count")
    writers.sink_jsonl(rows, path)
    writers.sink_jsonl(rows, path)
    back = spark.read.schema("comment_id STRING, like_count BIGINT").json(path)
    return back.groupBy("comment_id", "like_count").agg(F.count("*").alias("n"))


@query("sink_csv", f"""{st.SCORED_V2}
SELECT comment_id, CAST(risk_score AS BIGINT) AS risk_score, risk_level FROM scored2 WHERE risk_score >= 40""")
def sink_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    rows = scored(spark, sf_dir).filter("risk_score >= 40").select("comment_id", "risk_score", "risk_level", "sensitive_words")
    writers.sink_csv(rows, path)
    back = readers.scan_csv(spark, path, "comment_id STRING, risk_score BIGINT, risk_level STRING, sensitive_words STRING")
    return back.select("comment_id", "risk_score", "risk_level")


@query("sink_json", f"""{st.COMMENTS} SELECT comment_id, parent_id, strftime(publish_time, '%Y-%m-%dT%H:%M:%S') AS publish_time FROM comments""")
def sink_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    writers.sink_json(parsers.export_projection(views.comments(spark, sf_dir)), path)
    return spark.read.schema("comment_id STRING, parent_id STRING, publish_time STRING").json(path)


@query("sink_report")
def sink_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    rows = reports.with_report_fields(report_two(spark, sf_dir), generated_at=STAMP)
    writers.sink_report(rows, path, ["source_file"], ["md", "json", "html", "txt"])
    saved = spark.read.schema("source_file STRING, report STRING, format STRING").json(path)
    return saved.select("source_file", "format", F.length("report").alias("length"))


@query("cleaning_report", f"""{st.COMMENTS},
t AS (SELECT ord % 10 = 0 AS bad, '<b>' || content || '</b> [doge]' || chr(9) || ' @reader ' AS x FROM comments WHERE ord % 10 <> 1),
u AS (SELECT x FROM t WHERE NOT bad UNION ALL SELECT content FROM comments WHERE ord % 10 > 1)
SELECT (SELECT count(*) FROM t WHERE NOT bad) AS total_raw, (SELECT count(*) FROM t WHERE bad) AS errors, (SELECT count(*) FROM u) AS total_cleaned,
  CAST(sum(length(x) - length({st.strip_html('x')})) AS BIGINT) AS html_removed, CAST(sum({st.n_matches(st.strip_html('x'), tx.URL)}) AS BIGINT) AS url_marked,
  CAST(sum({st.n_matches(st.strip_html('x'), tx.MENTION)}) AS BIGINT) AS mention_marked, CAST(sum({st.n_matches(st.strip_html('x'), tx.BRACKET_EMOJI)}) AS BIGINT) AS emoji_normalized
FROM u""")
def cleaning_report(spark, sf_dir):
    path = _feed(spark, sf_dir, "tieba", broken=True)
    lines = readers.with_platform(readers.read_lines(spark, f"{path}/tieba.jsonl")).withColumn("source_file", F.lit("tieba"))
    out = quality.cleaning_report(parsers.raw_texts(lines))
    return out.select("total_raw", "errors", "total_cleaned", "html_removed", "url_marked", "mention_marked", "emoji_normalized")


# --- table preparation -----------------------------------------------------------

_GAPPY_SQL = """gappy AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, 'x' AS constant, CAST(NULL AS VARCHAR) AS nothing FROM orders)"""


def _gappy(spark, sf_dir):
    o = F.col("o_orderkey")
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(o % 11 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(o % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(o % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.lit("x").alias("constant"),
        F.lit(None).cast("string").alias("nothing"))


@query("dedupe_rows", "SELECT DISTINCT event_type, user_id % 10 AS u FROM events")
def dedupe_rows(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("u"))
    return prep.dedupe_rows(rows)


@query("cast_dates", f"WITH {_GAPPY_SQL} SELECT o_orderkey, o_orderdate || ' 00:00:00' AS o_orderdate, o_orderpriority FROM gappy")
def cast_dates(spark, sf_dir):
    return prep.cast_dates(_gappy(spark, sf_dir)).select("o_orderkey", stamp("o_orderdate"), "o_orderpriority")


@query("fill_mean_mode", f"""WITH {_GAPPY_SQL}
SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM gappy)), 4) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM gappy WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority,
  coalesce(o_orderstatus, (SELECT o_orderstatus FROM gappy WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus FROM gappy""")
def fill_mean_mode(spark, sf_dir):
    rows = prep.fill_mean_mode(_gappy(spark, sf_dir))
    return rows.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), "o_orderpriority", "o_orderstatus")


@query("drop_useless_columns", f"WITH {_GAPPY_SQL} SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderdate FROM gappy")
def drop_useless_columns(spark, sf_dir):
    return prep.drop_useless_columns(_gappy(spark, sf_dir))


@query("clean_table", f"""WITH {_GAPPY_SQL}
SELECT o_orderkey, o_orderdate || ' 00:00:00' AS o_orderdate, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM gappy)), 4) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM gappy WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority,
  coalesce(o_orderstatus, (SELECT o_orderstatus FROM gappy WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus FROM gappy""")
def clean_table(spark, sf_dir):
    out = prep.clean_table(_gappy(spark, sf_dir))
    shaped = {"o_orderdate": stamp("o_orderdate"), "o_totalprice": F.round("o_totalprice", 4).alias("o_totalprice")}
    return out.select(*[shaped.get(c, F.col(c)) for c in out.columns])


def _missing_sql(columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, round((count(*) - count({c}))::DOUBLE / count(*), 4) AS missing_ratio FROM gappy" for c in columns)


_GAPPY_COLUMNS = ("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate", "constant", "nothing")


@query("missing_report", f"WITH {_GAPPY_SQL} {_missing_sql(_GAPPY_COLUMNS)}")
def missing_report(spark, sf_dir):
    return prep.missing_report(_gappy(spark, sf_dir))


def _outlier_sql(columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (abs(({c} - a) / nullif(s, 0)) > 3) AS outlier_count,
  round(count(*) FILTER (abs(({c} - a) / nullif(s, 0)) > 3)::DOUBLE / count(*), 4) AS outlier_ratio FROM ev, (SELECT avg({c}) AS a, stddev_pop({c}) AS s FROM ev)""" for c in columns)


@query("outlier_report", f"WITH ev AS (SELECT event_id, user_id, value FROM events) {_outlier_sql(('event_id', 'user_id', 'value'))}")
def outlier_report(spark, sf_dir):
    return prep.outlier_report(views.table(spark, sf_dir, "events").select("event_id", "user_id", "value"))


@query("content_hash_dedupe", """
SELECT doc_id, md5(text) AS content_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""")
def content_hash_dedupe(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    return prep.content_hash_dedupe(rows).select(F.col("ord").alias("doc_id"), "content_md5")


_SERIES = "SELECT l_suppkey % 20 AS series, CAST(l_partkey AS DOUBLE) AS x, avg(l_extendedprice) AS y, count(*) AS c FROM lineitem GROUP BY 1, 2"


@query("interpolate_linear", f"""WITH p AS ({_SERIES}),
e AS (SELECT series, min(x) AS lo, max(x) AS hi, CAST(sum(c) * 2 AS BIGINT) AS n FROM p GROUP BY 1 HAVING max(x) > min(x)),
g AS (SELECT series, i, lo + i * ((hi - lo) / (n - 1)) AS gx FROM (SELECT *, unnest(range(n)) AS i FROM e)),
b AS (SELECT series, x AS x0, y AS y0, lead(x) OVER (PARTITION BY series ORDER BY x) AS x1, lead(y) OVER (PARTITION BY series ORDER BY x) AS y1 FROM p)
SELECT g.series AS series, i, round(gx, 4) AS x, round(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (gx - x0) END, 6) AS y
FROM g ASOF JOIN b ON g.series = b.series AND g.gx >= b.x0""")
def interpolate_linear(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("series"), "l_partkey", "l_extendedprice")
    out = prep.interpolate_linear(rows, ["series"], "l_partkey", "l_extendedprice")
    return out.select("series", "i", F.round("x", 4).alias("x"), F.round("y", 6).alias("y"))


# --- models ----------------------------------------------------------------------


def _pairs(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return models.numeric_pair(rows, "l_quantity", "l_extendedprice", "key")


@query("regress_line", """
SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def regress_line(spark, sf_dir):
    out = models.line_fit(views.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), *r6("r2"))


_PAIRS_SQL = """pairs AS (
  SELECT l_orderkey || '-' || l_linenumber AS key, l_quantity AS x, l_extendedprice AS y,
    CAST('0x' || substr(md5(l_orderkey || '-' || l_linenumber), 1, 8) AS BIGINT) % 10 < 2 AS is_test FROM lineitem)"""
_METRICS_SQL = """e AS (SELECT *, y - prediction AS e FROM predicted),
metrics AS (
  SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(avg(e * e), 2) AS mse,
    round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae FROM e GROUP BY is_test)"""
_LINE_SQL = "line AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS base FROM pairs WHERE NOT is_test)"


def _metrics(predicted):
    found = models.regression_metrics(predicted)
    return found.select("part", "n", *r6("r2"), F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("regress_poly", f"""
WITH {_PAIRS_SQL},
m AS (
  SELECT avg(x) AS mx, avg(x * x) AS mv, avg(y) AS my, var_pop(x) AS xx, var_pop(x * x) AS vv, covar_pop(x, x * x) AS xv, covar_pop(x, y) AS xy, covar_pop(x * x, y) AS vy
  FROM pairs WHERE NOT is_test),
w AS (SELECT *, (xy * vv - vy * xv) / (xx * vv - xv * xv) AS b, (vy * xx - xy * xv) / (xx * vv - xv * xv) AS c FROM m),
predicted AS (SELECT p.*, my + b * (x - mx) + c * (x * x - mv) AS prediction FROM pairs p, w),
{_METRICS_SQL}
SELECT metrics.*, printf('y=%.4f%+.4f*x%+.4f*x^2', my - b * mx - c * mv, b, c) AS expression FROM metrics, w""")
def regress_poly(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    model = models.fit_polynomial(pairs, degree=2)
    shown = models.expression(*models.coefficients(model))
    return _metrics(models.predict(model, pairs)).withColumn("expression", F.lit(shown))


_WEIGHT_SQL = " + ".join(f"CAST(u >= {bound} AS INT)" for bound in forest.POISSON_BOUNDS)


@query("regress_forest", f"""
WITH {_PAIRS_SQL},
drawn AS (
  SELECT t, x, y, CAST('0x' || substr(md5(key || ':' || (t // 4)), CAST(t % 4 * 8 + 1 AS INT), 8) AS BIGINT) AS u FROM pairs, range({forest.TREES}) r(t) WHERE NOT is_test),
leaves AS (SELECT t, x, sum(w * y) / sum(w) AS mean FROM (SELECT t, x, y, {_WEIGHT_SQL} AS w FROM drawn) WHERE w > 0 GROUP BY t, x),
places AS (SELECT t, x FROM (SELECT DISTINCT x FROM pairs), range({forest.TREES}) r(t)),
near AS (
  SELECT p.t, p.x, l.mean FROM places p JOIN leaves l USING (t)
  QUALIFY row_number() OVER (PARTITION BY p.t, p.x ORDER BY abs(l.x - p.x), l.x) = 1),
told AS (SELECT x, avg(mean) AS prediction FROM near GROUP BY x),
predicted AS (SELECT pairs.*, prediction FROM pairs JOIN told USING (x)),
{_METRICS_SQL}
SELECT *, CAST(1 AS DOUBLE) AS importance FROM metrics""")
def regress_forest(spark, sf_dir):
    return _metrics(forest.predict_forest(_pairs(spark, sf_dir))).withColumn("importance", F.lit(1.0))  # of the only column


@query("regress_forest_shallow")
def regress_forest_shallow(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    model = models.fit_forest(pairs)
    importance = float(model.stages[-1].featureImportances[0])
    return models.regression_metrics(models.predict(model, pairs)).withColumn("importance", F.lit(importance))


@query("predict_value", f"""
WITH {_PAIRS_SQL}, {_LINE_SQL}
SELECT DISTINCT x, round(base + slope * x, 4) AS prediction FROM pairs, line""")
def predict_value(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    model = models.fit_polynomial(pairs, degree=1)
    wanted = pairs.select("x").distinct()
    return models.predict(model, wanted).select("x", F.round("prediction", 4).alias("prediction"))


@query("residuals", f"""
WITH {_PAIRS_SQL}, {_LINE_SQL}
SELECT key, x, y, round(base + slope * x, 4) AS prediction, round(y - base - slope * x, 4) AS residual FROM pairs, line""")
def residuals(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    model = models.fit_polynomial(pairs, degree=1)
    out = models.residuals(models.predict(model, pairs))
    return out.select("key", "x", "y", F.round("prediction", 4).alias("prediction"), F.round("residual", 4).alias("residual"))


@query("sentiment_model")
def sentiment_model(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").repartition("doc_id").select("doc_id", F.col("text").alias("content"))
    labels = views.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    model = models.fit_sentiment(docs.join(labels, "doc_id"))
    scored_docs = models.score_sentiment(model, docs)
    score = F.col("model_score")
    return scored_docs.select("doc_id", *r6("model_score"), F.when(score < 0.35, "negative").when(score > 0.65, "positive").otherwise("neutral").alias("sentiment"))


# --- streaming -------------------------------------------------------------------


@query("stream_clean", f"""{st.COMMENTS}
SELECT comment_id, {_CLEANED} AS content, like_count FROM comments WHERE ord % 10 > 1""")
def stream_clean(spark, sf_dir):
    path = _feed(spark, sf_dir, "douyin", broken=True)
    stream = streams.stream_clean(spark, f"{path}/douyin.jsonl")
    target = scratch_path(spark, "cleaned")
    streams.append_to(stream, target, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).select("comment_id", "content", "like_count")


@query("stream_hourly_volume", f"""{st.COMMENTS},
c AS (SELECT date_trunc('hour', date_trunc('second', publish_time)) AS h, count(*) AS n, 1 AS one FROM comments GROUP BY 1)
SELECT 'douyin' AS platform, strftime(h, '%Y-%m-%d %H:%M:%S') AS hour_start, n FROM c
WHERE h + INTERVAL 1 HOUR <= (SELECT date_trunc('second', max(publish_time)) - INTERVAL 2 HOUR FROM comments)""")
def stream_hourly_volume(spark, sf_dir):
    path = _feed(spark, sf_dir, "douyin")
    hourly = streams.stream_hourly_volume(streams.stream_clean(spark, f"{path}/douyin.jsonl"))
    target = scratch_path(spark, "hours")
    streams.append_to(hourly, target, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(target).select("platform", stamp("hour_start"), *long("n"))


@query("stream_spikes", """
WITH h AS (SELECT event_type AS scope, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT *, avg(n) OVER p AS mean, count(*) OVER p AS hours FROM h WINDOW p AS (PARTITION BY scope ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT scope, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, n, round(mean, 6) AS mean, hours, hours >= 3 AND n > 1.2 * mean AS is_spike FROM w""")
def stream_spikes(spark, sf_dir):
    """Hours of a feed whose end is marked, judged as they close; the last ones come out too."""
    feed, hours, out = (scratch_path(spark, name) for name in ("feed", "hours", "spikes"))
    events = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("ts").cast("timestamp").alias("at"))
    end = events.agg(F.max("at") + F.expr("INTERVAL 1 DAY")).first()[0]
    spikes.closing_row(events, "at", end).write.parquet(feed)
    counted = spikes.hours_with_close(spark.readStream.schema("scope string, at timestamp").parquet(feed), end, ["scope"], "at")
    spikes.keep(counted, hours, scratch_path(spark, "progress")).awaitTermination()
    closed = spark.readStream.schema("scope string, hour_start timestamp, n long").parquet(hours)
    spikes.watch(closed, out, scratch_path(spark, "progress"), scope=["scope"], factor=1.2).awaitTermination()
    return spark.read.parquet(out).select("scope", stamp("hour"), "n", *r6("mean"), "hours", "is_spike")


@query("distinct_users_daily", f"""
SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS rows, count(DISTINCT user_id) AS exact, true AS within FROM events GROUP BY event_type""")
def distinct_users_daily(spark, sf_dir):
    """Sketches per day, merged over all days, beside the exact count: ``within`` says that they agree up to the stated error."""
    events = views.table(spark, sf_dir, "events")
    merged = distinct.distinct_over(distinct.daily_sketches(events, ["event_type"], "ts", "user_id"), ["event_type"])
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    off = F.abs(F.col("distinct") - F.col("exact")) <= distinct.error_bound() * F.col("exact")
    return merged.join(exact, "event_type").select("event_type", "days", "rows", "exact", off.alias("within"))
