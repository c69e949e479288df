"""Queries for anomalies, overall scores and complete reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxrisk import views
from voxrisk.catalog import comment_queries as cq
from voxrisk.catalog import people_queries as pq
from voxrisk.catalog import sqltext as st
from voxrisk.catalog.comment_queries import DISTRIBUTION_V2, scored
from voxrisk.catalog.registry import joined, long, q, query, r6, stamp
from voxrisk.operators import anomalies as an
from voxrisk.operators import quality, risk
from voxrisk.plans import render, reports
from voxrisk.views import LATIN_V1, LATIN_V2

BY_SOURCE = ["source_file"]
STAMP = "2026-01-01 00:00:00"

# Limits low enough that the given data shows every kind of anomaly.
SPIKE, NIGHT, LOCATION, NEGATIVE, DUPLICATE, SHORT = 1.8, 0.2, 0.12, 0.15, 0.05, 0.01

# --- anomalies -----------------------------------------------------------------

_HOURS = """hc AS (SELECT source_file, date_trunc('hour', publish_time) AS h, count(*) AS n FROM {t} WHERE publish_time IS NOT NULL GROUP BY 1, 2),
ha AS (SELECT *, avg(n) OVER (PARTITION BY source_file) AS a, count(*) OVER (PARTITION BY source_file) AS k FROM hc)"""


def _anomaly(kind: str, severity: str, score: str, affected: str, source: str, where: str, window: str = "CAST(NULL AS VARCHAR)", text: str = "''") -> str:
    return f"""SELECT source_file, '{kind}' AS anomaly_type, {severity} AS severity, CAST(trunc({score}) AS BIGINT) AS score,
  CAST({affected} AS BIGINT) AS affected_count, {window} AS time_window, {text} AS description FROM {source} WHERE {where}"""


def _spike(factor: float) -> str:
    return _anomaly("volume_spike", "CASE WHEN n > a * 5 THEN 'high' ELSE 'medium' END", "least(trunc((n / a - 1) * 20), 100)", "n", "ha",
                    f"k >= 3 AND n > a * {factor}", "strftime(h, '%Y-%m-%d %H:00')",
                    f"'评论量突增: ' || n || ' 条 (平均 ' || {st.fixed('a', 1)} || ' 条)'")


_HITS = ", ".join(f"count(*) FILTER (contains(content, {q(w)})) AS w{i}" for i, w in enumerate(LATIN_V1.concentration))
_BEST = "[" + ", ".join(f"{{'n': w{i}, 'p': {-i}, 'w': {q(w)}}}" for i, w in enumerate(LATIN_V1.concentration)) + "]"
_OVERSEAS = ", ".join(q(x) for x in LATIN_V1.overseas)
_MEASURES = f"""
sm AS (SELECT *, list_max({_BEST}) AS best, 1 - CAST(uniq AS DOUBLE) / total AS dup FROM (
  SELECT source_file, count(*) AS total, count(*) FILTER (hour(publish_time) < 6) AS night, count(DISTINCT content) AS uniq,
    count(*) FILTER (length(content) < 10) AS short, count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (risk_score >= 60) AS risky, {_HITS}
  FROM scored1 GROUP BY 1)),
lc AS (SELECT source_file, ip_location AS region, count(*) AS n, min(ord) AS f FROM comments WHERE nullif(ip_location, '') IS NOT NULL GROUP BY 1, 2),
lm AS (SELECT source_file, count(*) AS k, sum(n) AS located, max({{'n': n, 'p': -f, 'region': region}}) AS top,
  coalesce(sum(n) FILTER (region IN ({_OVERSEAS})), 0) AS overseas FROM lc GROUP BY 1),
nh AS (SELECT source_file FROM hc GROUP BY 1 HAVING count(*) >= 3)"""
_NIGHT = _anomaly("night_activity", "'medium'", "night::DOUBLE / total * 100", "night", "sm JOIN nh USING (source_file)", f"night::DOUBLE / total > {NIGHT}",
                  text=f"'深夜异常活动: ' || night || ' 条评论 (' || {st.percent('night::DOUBLE / total')} || ')'")
_LOCATION = _anomaly("location_concentration", "'medium'", "top.n::DOUBLE / located * 100", "top.n", "lm", f"k >= 2 AND top.n::DOUBLE / located > {LOCATION} AND located > 20",
                     text=f"'地域集中异常: ' || top.region || ' 占比 ' || {st.percent('top.n::DOUBLE / located')}")
_ABROAD = _anomaly("overseas_activity", "'low'", "overseas::DOUBLE / located * 100", "overseas", "lm", "k >= 2 AND overseas > 10 AND overseas::DOUBLE / located > 0.1",
                   text=f"'海外异常活动: ' || overseas || ' 条评论 (' || {st.percent('overseas::DOUBLE / located')} || ')'")
_NEGATIVE = _anomaly("negative_sentiment_spike", "CASE WHEN negative::DOUBLE / total > 0.8 THEN 'critical' ELSE 'high' END", "negative::DOUBLE / total * 100", "negative", "sm",
                     f"negative::DOUBLE / total > {NEGATIVE}", text=f"'负面情感异常: ' || negative || ' 条 (' || {st.percent('negative::DOUBLE / total')} || ')'")
_RISKY = _anomaly("high_risk_content", "'high'", "least(risky * 2, 100)", "risky", "sm", "risky > 10", text="'高风险评论: ' || risky || ' 条'")
_DUP = _anomaly("content_duplication", "CASE WHEN dup > 0.5 THEN 'high' ELSE 'medium' END", "dup * 100", "trunc(total * dup)", "sm", f"dup > {DUPLICATE}",
                text=f"'内容重复异常: 重复率 ' || {st.percent('dup')}")
_SHORT = _anomaly("spam_short_content", "'medium'", "short::DOUBLE / total * 100", "short", "sm", f"short::DOUBLE / total > {SHORT}", text="'短评论刷屏: ' || short || ' 条 (< 10字)'")
_WORD = _anomaly("sensitive_keyword_concentration", "'medium'", "least(best.n * 5, 100)", "best.n", "sm", "best.n > 10",
                 text="'敏感词集中: ''' || best.w || ''' 出现 ' || best.n || ' 次'")
_PARTS = {
    "volume_spike": _spike(SPIKE), "night_activity": _NIGHT, "location_concentration": _LOCATION, "overseas_activity": _ABROAD,
    "negative_spike": _NEGATIVE, "high_risk_content": _RISKY, "content_duplication": _DUP, "spam_short": _SHORT, "keyword_concentration": _WORD,
}
_BASE = f"{st.SCORED_V1}, {_HOURS.format(t='comments')}, {_MEASURES}"
_FOUND = "found AS (" + " UNION ALL ".join(_PARTS.values()) + ")"


def _shown(found):
    return found.select("source_file", "anomaly_type", "severity", *long("score", "affected_count"), "time_window", "description")


def _scored(spark, sf_dir):
    return scored(spark, sf_dir, LATIN_V1)


@query("volume_spike", f"{st.ACTIVITY}, {_HOURS.format(t='activity')} {_spike(SPIKE)}")
def volume_spike(spark, sf_dir):
    return _shown(an.volume_spike(an.hourly_counts(views.activity(spark, sf_dir), BY_SOURCE), BY_SOURCE, SPIKE))


def _features(spark, sf_dir):
    return an.anomaly_features(_scored(spark, sf_dir), BY_SOURCE, LATIN_V1.concentration)


def _detector(name, detector):
    @query(name, f"{_BASE} {_PARTS[name]}")
    def detect(spark, sf_dir):
        features = _features(spark, sf_dir)
        hourly = an.hourly_counts(features, BY_SOURCE)
        summary = an.scope_summary(features, hourly, BY_SOURCE, LATIN_V1.concentration, LATIN_V1.overseas)
        return _shown(an.found(summary, BY_SOURCE, detector()))
    return detect


_detector("night_activity", lambda: an.night_activity(NIGHT))
_detector("location_concentration", lambda: an.location_concentration(LOCATION))
_detector("overseas_activity", an.overseas_activity)
_detector("negative_spike", lambda: an.negative_spike(NEGATIVE))
_detector("spam_short", lambda: an.spam_short(SHORT))
_detector("keyword_concentration", an.keyword_concentration)


@query("content_duplication", f"""{st.COMMENTS},
sm AS (SELECT platform AS source_file, count(*) AS total, 1 - CAST(count(DISTINCT content) AS DOUBLE) / count(*) AS dup FROM comments GROUP BY 1)
{_DUP}""")
def content_duplication(spark, sf_dir):
    rows = views.comments(spark, sf_dir).withColumn("source_file", F.col("platform"))
    measures = an.scope_measures(an.anomaly_features(rows, BY_SOURCE), BY_SOURCE)
    return _shown(an.found(measures, BY_SOURCE, an.content_duplication(DUPLICATE)))


@query("high_risk_content", f"{_BASE.replace('risk_score >= 60', 'risk_score >= 15')} {_RISKY}")
def high_risk_content(spark, sf_dir):
    measures = an.scope_measures(_features(spark, sf_dir), BY_SOURCE, LATIN_V1.concentration, high_risk=15)
    return _shown(an.found(measures, BY_SOURCE, an.high_risk_content()))


def _anomalies(spark, sf_dir):
    return an.anomalies(
        _features(spark, sf_dir), BY_SOURCE, words=LATIN_V1.concentration, overseas=LATIN_V1.overseas, volume_factor=SPIKE, night_limit=NIGHT,
        location_limit=LOCATION, negative_limit=NEGATIVE, duplicate_limit=DUPLICATE, short_limit=SHORT)


@query("anomalies", f"{_BASE}, {_FOUND} SELECT * FROM found")
def anomalies(spark, sf_dir):
    return _shown(an.in_report_order(_anomalies(spark, sf_dir), BY_SOURCE))


_ASUM = """asum AS (SELECT source_file, count(*) AS total_anomalies, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, list_sort(list(DISTINCT anomaly_type)) AS kinds FROM found GROUP BY 1)"""


@query("anomaly_summary", f"""{_BASE}, {_FOUND}, {_ASUM}
SELECT source_file, total_anomalies, critical, high, medium, low, array_to_string(kinds, '|') AS anomaly_types, critical > 0 AS has_critical, high > 0 AS has_high FROM asum""")
def anomaly_summary(spark, sf_dir):
    out = an.anomaly_summary(_anomalies(spark, sf_dir), BY_SOURCE)
    return out.withColumn("anomaly_types", joined("anomaly_types"))


# --- v1 assessment -------------------------------------------------------------

_ASSESS = f"""{_BASE}, {_FOUND}, {_ASUM}, {pq.BOT_SQL.replace('@T@', 'comments')},
bsum AS (SELECT source_file, count(*) AS bot_users, count(*) FILTER (level = 'high') AS bot_high, CAST(count(*) FILTER (level = 'high') AS DOUBLE) / count(*) AS hr,
  avg(score) AS bavg FROM bot GROUP BY 1),
mood AS (SELECT source_file, count(*) AS total, CAST(count(*) FILTER (sentiment = 'negative') AS DOUBLE) / count(*) AS neg, avg(risk_score) AS ravg FROM scored1 GROUP BY 1),
sub AS (SELECT source_file, neg, bot_high, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(kinds, []) AS kinds,
  least(CASE WHEN neg > 0.7 THEN 40 WHEN neg > 0.5 THEN 30 WHEN neg > 0.3 THEN 20 ELSE 0 END + trunc(ravg * 0.6::DOUBLE), 100) AS sr,
  coalesce(CASE WHEN hr > 0.1 THEN 50 WHEN hr > 0.05 THEN 30 WHEN hr > 0.01 THEN 15 WHEN hr IS NOT NULL THEN 0 END + trunc(bavg * 0.5::DOUBLE), 0) AS ar0,
  CASE WHEN coalesce(critical, 0) > 0 THEN 50 ELSE 0 END + CASE WHEN high > 2 THEN 30 WHEN high > 0 THEN 20 ELSE 0 END + least(len(coalesce(kinds, [])) * 10, 30) AS br,
  CASE WHEN list_contains(kinds, 'content_duplication') THEN 30 ELSE 0 END + CASE WHEN list_contains(kinds, 'sensitive_keyword_concentration') THEN 25 ELSE 0 END
    + CASE WHEN list_contains(kinds, 'spam_short_content') THEN 20 ELSE 0 END AS cr
  FROM mood LEFT JOIN bsum USING (source_file) LEFT JOIN asum USING (source_file)),
ass AS (SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM (
  SELECT *, least(ar0, 100) AS ar, trunc(sr * 0.3::DOUBLE + least(ar0, 100) * 0.25::DOUBLE + br * 0.25::DOUBLE + cr * 0.2::DOUBLE) AS score FROM sub)),
warn AS (SELECT *, list_filter([
  CASE WHEN sr > 60 THEN '负面情绪占比过高 (' || {st.percent('neg')} || ')' END, CASE WHEN ar > 50 THEN '检测到 ' || bot_high || ' 个高风险账号' END,
  CASE WHEN br > 50 AND critical > 0 THEN '发现 ' || critical || ' 个严重异常' END, CASE WHEN br > 50 AND high > 0 THEN '发现 ' || high || ' 个高危异常' END,
  CASE WHEN cr > 40 AND list_contains(kinds, 'content_duplication') THEN '存在内容重复刷屏行为' END,
  CASE WHEN cr > 40 AND list_contains(kinds, 'sensitive_keyword_concentration') THEN '敏感词出现频率异常' END], lambda x: x IS NOT NULL) AS warnings FROM ass)"""


def report_one(spark, sf_dir):
    return reports.report_v1(
        views.comments(spark, sf_dir), BY_SOURCE, LATIN_V1, volume_factor=SPIKE, night_limit=NIGHT, location_limit=LOCATION,
        negative_limit=NEGATIVE, duplicate_limit=DUPLICATE, short_limit=SHORT)


def _assessment(spark, sf_dir):
    """The inputs of the v1 assessment only, without topics."""
    features = reports.row_features_v1(views.comments(spark, sf_dir), BY_SOURCE, LATIN_V1)
    return reports.assessment_v1(
        features, BY_SOURCE, LATIN_V1, volume_factor=SPIKE, night_limit=NIGHT, location_limit=LOCATION, negative_limit=NEGATIVE,
        duplicate_limit=DUPLICATE, short_limit=SHORT)


@query("risk_assessment_v1", f"""{_ASSESS}
SELECT source_file, CAST(sr AS BIGINT) AS sentiment_risk, CAST(ar AS BIGINT) AS account_risk, CAST(br AS BIGINT) AS behavior_risk, CAST(cr AS BIGINT) AS content_risk,
  CAST(score AS BIGINT) AS overall_score, level AS risk_level, 'stable' AS trend FROM ass""")
def risk_assessment_v1(spark, sf_dir):
    return _assessment(spark, sf_dir).select(
        "source_file", *long("sentiment_risk", "account_risk", "behavior_risk", "content_risk", "overall_score"), "risk_level", "trend")


@query("warnings_v1", f"{_ASSESS} SELECT source_file, array_to_string(warnings, '|') AS warnings FROM warn")
def warnings_v1(spark, sf_dir):
    return _assessment(spark, sf_dir).select("source_file", joined("warnings"))


_ADVICE = "CASE level " + " ".join(f"WHEN '{k}' THEN {q('|'.join(v))}" for k, v in risk.ADVICE_V1.items()) + " END"


_ADVICE_SQL = f"""{_ADVICE} || CASE WHEN len(list_filter(warnings, lambda w: starts_with(w, '负面情绪占比过高'))) > 0 THEN '|分析负面情绪来源,考虑正面引导' ELSE '' END
  || CASE WHEN len(list_filter(warnings, lambda w: contains(w, '高风险账号'))) > 0 THEN '|核查高风险账号的真实性' ELSE '' END"""


@query("recommendations_v1", f"{_ASSESS} SELECT source_file, {_ADVICE_SQL} AS recommendations FROM warn")
def recommendations_v1(spark, sf_dir):
    return _assessment(spark, sf_dir).select("source_file", joined("recommendations"))


@query("full_report_v1", f"""{_ASSESS}, {cq.TOPIC_CTES}
SELECT source_file, plat AS platform, n AS total_comments, s AS start, e AS "end", CAST(sr AS BIGINT) AS sentiment_risk, CAST(ar AS BIGINT) AS account_risk,
  CAST(br AS BIGINT) AS behavior_risk, CAST(cr AS BIGINT) AS content_risk, CAST(warn.score AS BIGINT) AS overall_score, level AS risk_level, 'stable' AS trend,
  round(tr.score, 6) AS trending_score, {cq.TREND_LEVEL.replace('score', 'tr.score')} AS trending_level,
  CASE orientation WHEN 'strongly_positive' THEN '强烈支持' WHEN 'positive' THEN '偏向支持' WHEN 'strongly_negative' THEN '强烈反对' WHEN 'negative' THEN '偏向反对' ELSE '中立' END AS orientation_label,
  (SELECT string_agg(token, '|' ORDER BY rank) FROM kw WHERE kw.source_file = warn.source_file AND rank <= 5) AS top_5_keywords,
  CASE WHEN len(kinds) > 0 THEN array_to_string(kinds, '|') END AS anomaly_types, array_to_string(warnings, '|') AS warnings, {{ADVICE}} AS recommendations
FROM warn JOIN tr USING (source_file) JOIN (SELECT source_file, count(*) AS n, array_to_string(list_sort(list(DISTINCT platform)), ', ') AS plat,
  strftime(min(publish_time), '%Y-%m-%d %H:%M:%S') AS s, strftime(max(publish_time), '%Y-%m-%d %H:%M:%S') AS e FROM comments GROUP BY 1) USING (source_file)""".replace("{ADVICE}", _ADVICE_SQL))
def full_report_v1(spark, sf_dir):
    out = report_one(spark, sf_dir)
    return out.select(
        "source_file", "platform", "total_comments", stamp("start"), stamp("end"),
        *long("sentiment_risk", "account_risk", "behavior_risk", "content_risk", "overall_score"), "risk_level", "trend",
        *r6("trending_score"), "trending_level", "orientation_label", joined("top_5_keywords"), joined("anomaly_types"),
        joined("warnings"), joined("recommendations"))


# --- v2 report -----------------------------------------------------------------

V2_SQL = f"""{st.SCORED_V2}, {pq.region_sql('comments')}, {pq.PROFILE_SQL.replace('@T@', 'comments')}, {pq._SUMMARY_SQL.replace('@T@', 'comments')},
mood2 AS ({DISTRIBUTION_V2.format(high=40)}),
ppl AS (SELECT source_file, avg(avg_suspicion_score) FILTER (analyzed_users > 0) AS user_score, CAST(sum(suspicious_count) AS BIGINT) AS suspicious_users,
  flatten(list(findings ORDER BY platform)) AS user_findings FROM found GROUP BY 1),
plat AS (SELECT source_file, arg_min(platform, ord) AS platform FROM comments GROUP BY 1),
parts AS (SELECT r.source_file, r.total AS total_comments, r.wave, r.ok, r.ip_findings, m.positive, m.negative, m.neutral, m.high_risk, p.suspicious_users, p.user_findings, t.platform,
    CAST(m.negative AS DOUBLE) / m.total AS neg, CAST(m.high_risk AS DOUBLE) / m.total AS hr,
    least(trunc(CAST(m.negative AS DOUBLE) / m.total * 40 + CAST(m.high_risk AS DOUBLE) / m.total * 40 + m.avg_risk_score * 0.2::DOUBLE), 100) AS sp,
    CASE WHEN ok THEN points ELSE 0 END AS ip, coalesce(trunc(p.user_score), 0) AS up
  FROM reg_out r LEFT JOIN mood2 m USING (source_file) LEFT JOIN ppl p USING (source_file) LEFT JOIN plat t USING (source_file)),
rep AS (SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS level FROM (
  SELECT *, CASE WHEN ok THEN trunc(sp * 0.4::DOUBLE + ip * 0.3::DOUBLE + up * 0.3::DOUBLE) ELSE trunc(sp * 0.5::DOUBLE + up * 0.5::DOUBLE) END AS score FROM parts)),
texts AS (SELECT *, (list_concat(list_filter([CASE WHEN neg > 0.5 THEN '负面情感占比 ' || {st.percent('neg')} || '，舆论氛围偏负面' END,
    CASE WHEN hr > 0.1 THEN '高风险评论占比 ' || {st.percent('hr')} || '，含敏感内容' END], lambda x: x IS NOT NULL), ip_findings, user_findings))[1:15] AS findings,
  list_filter([CASE WHEN level IN ('high', 'critical') THEN '建议人工复核高风险评论，评估是否需要上报' END,
    CASE WHEN suspicious_users > 0 THEN '建议关注 ' || suspicious_users || ' 个可疑账号，追踪其后续行为' END,
    CASE WHEN wave THEN '检测到波浪式传播，建议追踪源头省份的账号' END,
    CASE WHEN high_risk > 10 THEN '高风险评论数量较多，建议扩大敏感词库覆盖范围' END], lambda x: x IS NOT NULL) AS recs FROM rep)"""
_RECS = "CASE WHEN len(recs) = 0 THEN '当前数据风险较低，保持常规监测即可' ELSE array_to_string(recs, '|') END"


def report_two(spark, sf_dir):
    return reports.report_v2(views.comments(spark, sf_dir), BY_SOURCE, LATIN_V2, risk_threshold=40)


@query("full_report_v2", f"""{V2_SQL}
SELECT source_file, platform, total_comments, positive, negative, neutral, high_risk AS high_risk_comments, suspicious_users,
  CAST(sp AS BIGINT) AS sentiment_part, CAST(ip AS BIGINT) AS ip_part, CAST(up AS BIGINT) AS user_part, CAST(score AS BIGINT) AS overall_score,
  level AS overall_level, array_to_string(findings, '|') AS key_findings, {_RECS} AS recommendations FROM texts""")
def full_report_v2(spark, sf_dir):
    return report_two(spark, sf_dir).select(
        "source_file", "platform", "total_comments", "positive", "negative", "neutral", "high_risk_comments", "suspicious_users",
        *long("sentiment_part", "ip_part", "user_part", "overall_score"), "overall_level", joined("key_findings"), joined("recommendations"))


@query("overall_score_v2", f"""{V2_SQL}
SELECT source_file, CAST(sp AS BIGINT) AS sentiment_part, CAST(ip AS BIGINT) AS ip_part, CAST(up AS BIGINT) AS user_part, CAST(score AS BIGINT) AS overall_score,
  level AS overall_level FROM rep""")
def overall_score_v2(spark, sf_dir):
    return report_two(spark, sf_dir).select("source_file", *long("sentiment_part", "ip_part", "user_part", "overall_score"), "overall_level")


@query("findings_v2", f"{V2_SQL} SELECT source_file, array_to_string(findings, '|') AS key_findings FROM texts")
def findings_v2(spark, sf_dir):
    return report_two(spark, sf_dir).select("source_file", joined("key_findings"))


@query("recommendations_v2", f"{V2_SQL} SELECT source_file, {_RECS} AS recommendations FROM texts")
def recommendations_v2(spark, sf_dir):
    return report_two(spark, sf_dir).select("source_file", joined("recommendations"))


@query("report_row")
def report_row(spark, sf_dir):
    rows = reports.with_report_fields(report_two(spark, sf_dir), generated_at=STAMP)
    return rows.select("source_file", render.report_record().alias("report"))


@query("report_row_v1")
def report_row_v1(spark, sf_dir):
    return reports.report_row_v1(report_one(spark, sf_dir), BY_SOURCE, generated_at=STAMP)


@query("render_report")
def render_report(spark, sf_dir):
    rows = reports.with_report_fields(report_two(spark, sf_dir), generated_at=STAMP)
    kinds = ("md", "html", "txt", "dashboard")
    return rows.select("source_file", *[render.FORMATS[k]().alias(k) for k in kinds])


@query("render_report_v1")
def render_report_v1(spark, sf_dir):
    rows = reports.with_report_fields_v1(report_one(spark, sf_dir), generated_at=STAMP)
    return rows.select("source_file", render.markdown_v1().alias("md"))


# --- quality and basic figures ---------------------------------------------------


@query("quality_stats", f"""{st.COMMENTS}
SELECT source_file, total, with_ip, with_time, with_user_level, replies, round(with_ip::DOUBLE / total, 6) AS with_ip_ratio, round(with_time::DOUBLE / total, 6) AS with_time_ratio,
  round(with_user_level::DOUBLE / total, 6) AS with_user_level_ratio, round(replies::DOUBLE / total, 6) AS replies_ratio
FROM (SELECT source_file, count(*) AS total, count(nullif(ip_location, '')) AS with_ip, count(publish_time) AS with_time, count(*) FILTER (user_level <> 0) AS with_user_level,
  count(*) FILTER (is_reply) AS replies FROM comments GROUP BY 1)""")
def quality_stats(spark, sf_dir):
    names = ("with_ip", "with_time", "with_user_level", "replies")
    out = quality.quality_stats(views.comments(spark, sf_dir), BY_SOURCE)
    return out.select("source_file", "total", *names, *r6(*[f"{n}_ratio" for n in names]))


@query("basic_stats", f"""{st.COMMENTS}
SELECT platform, count(*) AS total_comments, round(avg(like_count), 6) AS avg_like, round(avg(reply_count), 6) AS avg_reply FROM comments GROUP BY 1""")
def basic_stats(spark, sf_dir):
    out = quality.basic_stats(views.comments(spark, sf_dir), ["platform"])
    return out.select("platform", "total_comments", *r6("avg_like", "avg_reply"))


@query("time_range", f"""{st.COMMENTS}
SELECT source_file, strftime(min(publish_time), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(publish_time), '%Y-%m-%d %H:%M:%S') AS "end",
  array_to_string(list_sort(list(DISTINCT platform)), '|') AS platforms FROM comments GROUP BY 1""")
def time_range(spark, sf_dir):
    out = quality.time_range(views.comments(spark, sf_dir), BY_SOURCE)
    return out.select("source_file", stamp("start"), stamp("end"), joined("platforms"))


@query("time_density", f"""{st.COMMENTS},
c AS (SELECT source_file, date_trunc('hour', publish_time) AS h, count(*) AS n FROM comments GROUP BY 1, 2),
spine AS (SELECT source_file, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM c GROUP BY 1)
SELECT source_file, strftime(h, '%Y-%m-%d %H:%M:%S') AS bucket, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (source_file, h)""")
def time_density(spark, sf_dir):
    out = quality.time_density(views.comments(spark, sf_dir), BY_SOURCE)
    return out.select("source_file", stamp("bucket"), "n")
