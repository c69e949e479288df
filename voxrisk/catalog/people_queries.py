"""Queries for user profiles, bots and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxrisk import views
from voxrisk.catalog import sqltext as st
from voxrisk.catalog.registry import joined, long, q, query, r6, sql_stamp, stamp
from voxrisk.functions import text as tx
from voxrisk.operators import bots, regions, users

BY_SOURCE = ["source_file"]
KEY = st.USER_KEY

# --- user profiles -------------------------------------------------------------


@query("user_key", f'{st.COMMENTS} SELECT ord, {KEY} AS "user" FROM comments')
def user_key(spark, sf_dir):
    return views.comments(spark, sf_dir).select("ord", users.user_key().alias("user"))


_BARE = st.strip("content")
PROFILE_SQL = f"""
prof AS (
  SELECT source_file, platform, {KEY} AS "user", count(*) AS n, arg_min(user_name, ord) AS user_name,
    CAST(sum(CASE WHEN is_reply THEN 1 ELSE 0 END) AS BIGINT) AS replies, CAST(sum(like_count) AS BIGINT) AS total_likes,
    avg(like_count) AS avg_likes, avg(length(content)) AS avg_len,
    CASE WHEN platform = 'bilibili' THEN CAST(floor(avg(user_level)) AS BIGINT) END AS user_level,
    CAST(count(DISTINCT nullif({_BARE}, '')) AS DOUBLE) / count(*) AS uniq,
    CAST(count(*) FILTER (length({_BARE}) < 5) AS DOUBLE) / count(*) AS short,
    CAST(count(*) FILTER (regexp_matches(content, {q(tx.AT_ANY)})) AS DOUBLE) / count(*) AS at_ratio,
    CAST(sum({st.n_matches('content', tx.BRACKET_EMOJI)} + {st.n_matches('content', tx.UNICODE_EMOJI)}) AS DOUBLE) / count(*) > 3 AS heavy
  FROM @T@ GROUP BY source_file, platform, 3 HAVING count(*) >= 2),
gaps AS (
  SELECT source_file, platform, "user", count(*) + 1 AS n_times, avg(g) AS m, stddev_pop(g) AS s FROM (
    SELECT source_file, platform, {KEY} AS "user",
      (epoch_us(publish_time) - lag(epoch_us(publish_time)) OVER (PARTITION BY source_file, platform, {KEY} ORDER BY publish_time)) / 1e6 AS g
    FROM @T@ WHERE publish_time IS NOT NULL) WHERE g IS NOT NULL GROUP BY 1, 2, 3),
reg AS (
  SELECT source_file, platform, "user", n_times, CASE WHEN n_times < 3 THEN 0.0 WHEN m = 0 THEN 1.0
    ELSE round(greatest(0.0, 1 - least(s / m, 2.0) / 2), 3) END AS regularity FROM gaps),
susp AS (
  SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM (
    SELECT p.*, r.regularity, least(
      CASE WHEN uniq < 0.3 THEN 40 WHEN uniq < 0.6 THEN 20 ELSE 0 END + CASE WHEN short > 0.8 THEN 25 WHEN short > 0.5 THEN 10 ELSE 0 END
      + CASE WHEN regularity > 0.85 THEN 25 WHEN regularity > 0.65 THEN 10 ELSE 0 END
      + CASE WHEN user_level <= 1 AND n >= 5 THEN 20 WHEN user_level <= 2 AND n >= 10 THEN 10 ELSE 0 END
      + CASE WHEN regexp_matches(user_name, {q(users.TIEBA_GUEST_NAME)}) THEN 15
             WHEN regexp_matches(user_name, {q(users.LONG_ALNUM_NAME)}) THEN 10 ELSE 0 END, 100) AS score
    FROM prof p LEFT JOIN reg r USING (source_file, platform, "user")))"""
ON_ACTIVITY = f"{st.ACTIVITY}, act AS (SELECT *, false AS is_reply FROM activity), {PROFILE_SQL.replace('@T@', 'act')}"
ON_COMMENTS = f"{st.COMMENTS}, {PROFILE_SQL.replace('@T@', 'comments')}"


def _features(spark, sf_dir, view=views.comments):
    return users.profile_features(view(spark, sf_dir), BY_SOURCE)


def _scored(spark, sf_dir, view=views.activity):
    features = _features(spark, sf_dir, view)
    return users.suspicion(users.user_profile(features, BY_SOURCE), users.time_regularity(features, BY_SOURCE), BY_SOURCE)


@query("user_profile", f"""{ON_COMMENTS}
SELECT source_file, platform, "user", user_name, n AS total_comments, replies, total_likes, user_level, round(avg_likes, 6) AS avg_likes,
  round(avg_len, 6) AS avg_content_length, round(uniq, 6) AS unique_content_ratio, round(short, 6) AS short_content_ratio,
  round(at_ratio, 6) AS mention_ratio, heavy AS emoji_heavy FROM prof""")
def user_profile(spark, sf_dir):
    rows = users.user_profile(_features(spark, sf_dir), BY_SOURCE)
    return rows.select(
        "source_file", "platform", "user", "user_name", "total_comments", "replies", "total_likes", *long("user_level"),
        *r6("avg_likes", "avg_content_length", "unique_content_ratio", "short_content_ratio", "mention_ratio"), "emoji_heavy")


def _ratio(name, column, sql_name, view, sql):
    @query(name, f'{sql} SELECT source_file, platform, "user", {sql_name} AS {column} FROM prof')
    def run(spark, sf_dir):
        rows = users.user_profile(_features(spark, sf_dir, view), BY_SOURCE)
        value = F.col(column) if column == "emoji_heavy" else F.round(column, 6)
        return rows.select("source_file", "platform", "user", value.alias(column))
    return run


_ratio("unique_content_ratio", "unique_content_ratio", "round(uniq, 6)", views.activity, ON_ACTIVITY)
_ratio("short_content_ratio", "short_content_ratio", "round(short, 6)", views.comments, ON_COMMENTS)
_ratio("mention_ratio", "mention_ratio", "round(at_ratio, 6)", views.comments, ON_COMMENTS)
_ratio("emoji_heavy", "emoji_heavy", "heavy", views.comments, ON_COMMENTS)


@query("active_hours", f"""{st.ACTIVITY}
SELECT source_file, {KEY} AS "user", {sql_stamp("date_trunc('hour', publish_time)")} AS hour_start, hour(date_trunc('hour', publish_time)) AS hour, count(*) AS n
FROM activity GROUP BY 1, 2, 3, 4
QUALIFY sum(count(*)) OVER (PARTITION BY source_file, "user") >= 2""")
def active_hours(spark, sf_dir):
    rows = users.active_hours(_features(spark, sf_dir, views.activity), BY_SOURCE)
    return rows.select("source_file", "user", stamp("hour_start"), *long("hour"), "n")


@query("time_regularity", f'{ON_ACTIVITY} SELECT source_file, "user", n_times, CAST(regularity AS DOUBLE) AS time_regularity FROM reg')
def time_regularity(spark, sf_dir):
    rows = users.time_regularity(_features(spark, sf_dir, views.activity), BY_SOURCE)
    return rows.select("source_file", "user", "n_times", "time_regularity")


_REASONS = f"""CASE WHEN len(reasons) = 0 THEN '未发现明显异常行为' ELSE array_to_string(reasons, '|') END"""
_REASON_LIST = f"""list_filter([
    CASE WHEN uniq < 0.3 THEN '内容高度重复（唯一率 ' || {st.percent('uniq')} || '）' WHEN uniq < 0.6 THEN '内容存在重复（唯一率 ' || {st.percent('uniq')} || '）' END,
    CASE WHEN short > 0.8 THEN '大量极短评论（' || {st.percent('short')} || ' 少于5字）' END,
    CASE WHEN regularity > 0.85 THEN '发言时间高度规律（规律性 ' || {st.fixed('CAST(regularity AS DOUBLE)', 2)} || '）' END,
    CASE WHEN user_level <= 1 AND n >= 5 THEN '低等级账号（Lv' || user_level || '）高频发言（' || n || '条）' END,
    CASE WHEN regexp_matches(user_name, {q(users.TIEBA_GUEST_NAME)}) THEN '用户名为系统生成格式（贴吧匿名用户）'
         WHEN regexp_matches(user_name, {q(users.LONG_ALNUM_NAME)}) THEN '用户名为纯字母数字（疑似自动注册）' END], lambda x: x IS NOT NULL)"""


@query("user_suspicion", f"""{ON_ACTIVITY}
SELECT source_file, platform, "user", CAST(score AS BIGINT) AS suspicion_score, level AS suspicion_level, {_REASONS} AS suspicion_reasons
FROM (SELECT *, {_REASON_LIST} AS reasons FROM susp)""")
def user_suspicion(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "source_file", "platform", "user", *long("suspicion_score"), "suspicion_level", joined("suspicion_reasons"))


@query("suspicious_users", f"""{ON_ACTIVITY}
SELECT source_file, platform, "user", CAST(score AS BIGINT) AS suspicion_score FROM susp WHERE score >= 20""")
def suspicious_users(spark, sf_dir):
    return users.suspicious_users(_scored(spark, sf_dir), 20).select("source_file", "platform", "user", *long("suspicion_score"))


@query("level_distribution", f"""{st.COMMENTS}
SELECT source_file, CAST(user_level AS BIGINT) AS user_level, count(*) AS n FROM comments
WHERE platform = 'bilibili' AND user_level IS NOT NULL GROUP BY 1, 2""")
def level_distribution(spark, sf_dir):
    rows = users.level_distribution(views.comments(spark, sf_dir), BY_SOURCE)
    return rows.select("source_file", *long("user_level"), "n")


_SUMMARY_SQL = f"""
tot AS (SELECT source_file, platform, count(DISTINCT {KEY}) AS total_users, count(user_level) FILTER (platform = 'bilibili') AS leveled,
  count(*) FILTER (platform = 'bilibili' AND user_level <= 2) AS low FROM @T@ GROUP BY 1, 2),
agg AS (SELECT source_file, platform, count(*) AS analyzed, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium,
  count(*) FILTER (score >= 40) AS suspicious, avg(score) AS avg_score FROM susp GROUP BY 1, 2),
summ AS (SELECT t.*, coalesce(analyzed, 0) AS analyzed_users, coalesce(high, 0) AS high_risk_count, coalesce(medium, 0) AS medium_risk_count,
  coalesce(suspicious, 0) AS suspicious_count, coalesce(avg_score, 0.0) AS avg_suspicion_score, CAST(low AS DOUBLE) / nullif(leveled, 0) AS low_ratio
  FROM tot t LEFT JOIN agg a USING (source_file, platform)),
found AS (SELECT *, CASE WHEN analyzed_users = 0 THEN [platform || ': 无用户满足最少评论数（2条）要求'] WHEN len(f) = 0 THEN ['用户行为整体正常，未发现明显可疑账号'] ELSE f END AS findings
  FROM (SELECT *, list_filter([
    CASE WHEN high_risk_count > 0 THEN '发现 ' || high_risk_count || ' 个高风险账号（占分析用户 ' || {st.percent('high_risk_count::DOUBLE / analyzed_users')} || '）' END,
    CASE WHEN medium_risk_count > 0 THEN '发现 ' || medium_risk_count || ' 个中风险账号' END,
    CASE WHEN avg_suspicion_score > 50 THEN '整体账号可疑度偏高（均分 ' || {st.fixed('avg_suspicion_score', 1)} || '/100）' END,
    CASE WHEN platform = 'bilibili' AND low_ratio > 0.5 THEN '低等级用户（Lv0-2）占比 ' || {st.percent('low_ratio')} || '，账号质量偏低' END],
    lambda x: x IS NOT NULL) AS f FROM summ))"""


def _summary(spark, sf_dir):
    features = _features(spark, sf_dir)
    scored = users.suspicion(users.user_profile(features, BY_SOURCE), users.time_regularity(features, BY_SOURCE), BY_SOURCE)
    return users.profiling_summary(features, scored, BY_SOURCE)


@query("profiling_summary", f"""{ON_COMMENTS}, {_SUMMARY_SQL.replace('@T@', 'comments')}
SELECT source_file, platform, total_users, analyzed_users, high_risk_count, medium_risk_count, suspicious_count,
  round(avg_suspicion_score, 6) AS avg_suspicion_score, round(low_ratio, 6) AS low_level_ratio FROM summ""")
def profiling_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select(
        "source_file", "platform", "total_users", "analyzed_users", "high_risk_count", "medium_risk_count", "suspicious_count",
        *r6("avg_suspicion_score", "low_level_ratio"))


@query("profiling_findings", f"""{ON_COMMENTS}, {_SUMMARY_SQL.replace('@T@', 'comments')}
SELECT source_file, platform, array_to_string(findings, '|') AS findings FROM found""")
def profiling_findings(spark, sf_dir):
    return _summary(spark, sf_dir).select("source_file", "platform", joined("findings"))


# --- bots ----------------------------------------------------------------------

BOT_SQL = f"""
bh AS (SELECT source_file, "user", max(c) AS busiest FROM (
  SELECT source_file, {KEY} AS "user", hour(publish_time) AS h, count(*) AS c FROM @T@ WHERE publish_time IS NOT NULL
  GROUP BY 1, 2, 3) GROUP BY 1, 2),
bm AS (
  SELECT source_file, {KEY} AS "user", count(*) AS n, arg_max(user_name, ord) AS user_name, arg_max(platform, ord) AS platform,
    count(publish_time) AS timed, (epoch_us(max(publish_time)) - epoch_us(min(publish_time))) / 3.6e9 AS span,
    count(DISTINCT content) AS uniq, avg(nullif(user_level, 0)) AS lvl, count(nullif(ip_location, '')) AS n_ip,
    count(DISTINCT nullif(ip_location, '')) AS d_ip, avg({st.n_matches('content', tx.UNICODE_EMOJI)}) AS emo, avg({st.n_matches('content', tx.AT_ANY)}) AS ats
  FROM @T@ GROUP BY 1, 2 HAVING count(*) >= 3),
bs AS (
  SELECT *, CASE WHEN timed < 2 THEN 0 WHEN span = 0 THEN 100 WHEN rate > 20 THEN 100 WHEN rate > 10 THEN 80 WHEN rate > 5 THEN 60 WHEN rate > 2 THEN 30 ELSE 0 END AS f,
    CASE WHEN sim > 0.8 THEN 100 WHEN sim > 0.6 THEN 80 WHEN sim > 0.4 THEN 50 ELSE CAST(trunc(sim * 50) AS INTEGER) END AS r,
    CASE WHEN regexp_matches(user_name, '^[0-9]+$') THEN 30 WHEN regexp_matches(user_name, '^[a-zA-Z0-9]+$') THEN 20 ELSE 0 END
      + CASE WHEN regexp_matches(lower(user_name), '^(user_|bot_|auto_|test_|demo_)') THEN 30 ELSE 0 END
      + CASE WHEN lvl < 2 THEN 20 ELSE 0 END + CASE WHEN d_ip = 1 AND n_ip > 5 THEN 10 ELSE 0 END AS a,
    CASE WHEN CAST(busiest AS DOUBLE) / timed > 0.8 THEN 30 ELSE 0 END + CASE WHEN emo > 5 THEN 20 ELSE 0 END + CASE WHEN ats > 2 THEN 20 ELSE 0 END AS b
  FROM (SELECT *, 1 - CAST(uniq AS DOUBLE) / n AS sim, CASE WHEN timed < 2 THEN 0.0 WHEN span = 0 THEN n ELSE n / span END AS rate
    FROM bm LEFT JOIN bh USING (source_file, "user"))),
bot AS (
  SELECT *, CASE WHEN score < 30 THEN 'low' WHEN score < 60 THEN 'medium' ELSE 'high' END AS level FROM (
    SELECT *, CAST(trunc(f * 0.3::DOUBLE + r * 0.3::DOUBLE + a * 0.2::DOUBLE + b * 0.2::DOUBLE) AS INTEGER) AS score FROM bs))"""
BOTS = f"{st.ACTIVITY}, {BOT_SQL.replace('@T@', 'activity')}"
BOTS_C = f"{st.COMMENTS}, {BOT_SQL.replace('@T@', 'comments')}"


def _measures(spark, sf_dir, view=views.activity):
    return bots.bot_measures(bots.bot_features(view(spark, sf_dir), BY_SOURCE), BY_SOURCE)


def _bots(spark, sf_dir, view=views.activity):
    return bots.bot_scores(bots.bot_features(view(spark, sf_dir), BY_SOURCE), BY_SOURCE)


@query("bot_frequency", f"""{BOTS} SELECT source_file, "user", CAST(f AS BIGINT) AS frequency_score, round(CAST(rate AS DOUBLE), 6) AS avg_comments_per_hour FROM bs""")
def bot_frequency(spark, sf_dir):
    return bots.frequency(_measures(spark, sf_dir)).select("source_file", "user", *long("frequency_score"), *r6("avg_comments_per_hour"))


@query("bot_repetition", f"""{BOTS} SELECT source_file, "user", uniq AS unique_contents, round(sim, 6) AS content_similarity, CAST(r AS BIGINT) AS repetition_score FROM bs""")
def bot_repetition(spark, sf_dir):
    return bots.repetition(_measures(spark, sf_dir)).select(
        "source_file", "user", "unique_contents", *r6("content_similarity"), *long("repetition_score"))


@query("bot_account", f'{BOTS} SELECT source_file, "user", user_name, CAST(a AS BIGINT) AS account_score FROM bs')
def bot_account(spark, sf_dir):
    return bots.account(_measures(spark, sf_dir)).select("source_file", "user", "user_name", *long("account_score"))


@query("bot_behavior", f"""{BOTS} SELECT source_file, "user", round(CAST(busiest AS DOUBLE) / timed, 6) AS max_hour_share, CAST(b AS BIGINT) AS behavior_score FROM bs""")
def bot_behavior(spark, sf_dir):
    return bots.behavior(_measures(spark, sf_dir)).select("source_file", "user", *r6("max_hour_share"), *long("behavior_score"))


@query("bot_score", f"""{BOTS_C}
SELECT source_file, "user", user_name, platform, n AS total_comments, CAST(score AS BIGINT) AS overall_score, level AS risk_level,
  CASE WHEN len(w) = 0 THEN '未发现明显异常' ELSE array_to_string(w, '|') END AS reasons FROM (SELECT *, list_filter([
    CASE WHEN f >= 60 THEN '发言频率异常: 平均 ' || {st.fixed('CAST(rate AS DOUBLE)', 1)} || ' 条/小时' END,
    CASE WHEN r >= 60 THEN '内容重复度高: ' || {st.percent('sim')} END, CASE WHEN a >= 50 THEN '账号特征异常' END,
    CASE WHEN b >= 50 THEN '行为模式异常' END], lambda x: x IS NOT NULL) AS w FROM bot)""")
def bot_score(spark, sf_dir):
    return _bots(spark, sf_dir, views.comments).select(
        "source_file", "user", "user_name", "platform", "total_comments", *long("overall_score"), "risk_level", joined("reasons"))


@query("bot_summary", f"""{BOTS_C}
SELECT source_file, total_users, high_risk, medium_risk, low_risk, round(CAST(high_risk AS DOUBLE) / total_users, 6) AS high_risk_ratio,
  round(CAST(medium_risk AS DOUBLE) / total_users, 6) AS medium_risk_ratio, round(CAST(low_risk AS DOUBLE) / total_users, 6) AS low_risk_ratio,
  round(avg_risk, 6) AS avg_risk_score FROM (SELECT source_file, count(*) AS total_users, count(*) FILTER (level = 'high') AS high_risk,
    count(*) FILTER (level = 'medium') AS medium_risk, count(*) FILTER (level = 'low') AS low_risk, avg(score) AS avg_risk FROM bot GROUP BY 1)""")
def bot_summary(spark, sf_dir):
    out = bots.bot_summary(_bots(spark, sf_dir, views.comments), BY_SOURCE)
    return out.select("source_file", "total_users", "high_risk", "medium_risk", "low_risk",
                      *r6("high_risk_ratio", "medium_risk_ratio", "low_risk_ratio", "avg_risk_score"))


@query("high_risk_accounts", f"""{BOTS}
SELECT source_file, "user", CAST(score AS BIGINT) AS overall_score, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, "user") AS rank
FROM bot WHERE level = 'low' QUALIFY rank <= 20""")
def high_risk_accounts(spark, sf_dir):
    top = bots.high_risk_accounts(_bots(spark, sf_dir), BY_SOURCE, level="low")
    return top.select("source_file", "user", *long("overall_score", "rank"))


# --- regions -------------------------------------------------------------------

REGION_SQL = f"""
loc AS (SELECT source_file, {st.REGION} AS region, publish_time, ord FROM @T@),
cov AS (SELECT source_file, count(*) AS total, count(region) AS with_ip, CAST(count(region) AS DOUBLE) / count(*) AS coverage FROM loc GROUP BY 1),
cnt AS (SELECT source_file, region, count(*) AS n, min(ord) AS first FROM loc WHERE region IS NOT NULL GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, first, region) AS r,
  row_number() OVER (PARTITION BY source_file ORDER BY n) AS i FROM cnt),
con AS (SELECT source_file, count(*) AS regions, sum(n) AS located, arg_min(region, r) AS top_region, max(n) AS top_count,
  CASE WHEN count(*) = 1 THEN 1.0 ELSE CAST(2 * sum(n * i) - (count(*) + 1) * sum(n) AS DOUBLE) / (count(*) * sum(n)) END AS gini,
  CAST(sum(n) FILTER (r <= 3) AS DOUBLE) / sum(n) AS top3 FROM rk GROUP BY 1),
tl AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY publish_time, ord) - 1 AS rn, count(*) OVER (PARTITION BY source_file) AS tn
  FROM loc WHERE region IS NOT NULL AND publish_time IS NOT NULL),
dv AS (SELECT source_file, tn, count(DISTINCT region) FILTER (rn < tn // 3) AS d0, count(DISTINCT region) FILTER (rn >= tn // 3 AND rn < 2 * tn // 3) AS d1,
  count(DISTINCT region) FILTER (rn >= 2 * tn // 3) AS d2 FROM tl GROUP BY 1, 2),
wv AS (SELECT *, tn >= 10 AND d0 <= 2 AND d2 >= 2 * d0 AS wave, CASE WHEN tn < 10 THEN 'unknown' WHEN d0 <= 2 AND d2 >= 2 * d0 THEN 'wave_spread'
  WHEN greatest(d0, d1, d2) <= 3 THEN 'concentrated' ELSE 'normal' END AS pattern FROM dv),
rs AS (SELECT *, least(CASE WHEN focus >= 80 THEN 40 WHEN focus >= 50 THEN 20 ELSE 0 END + CASE WHEN top3 >= 0.85 THEN 25 WHEN top3 >= 0.70 THEN 10 ELSE 0 END
    + CASE WHEN wave THEN 25 ELSE 0 END + CASE WHEN regions = 1 THEN 20 WHEN regions <= 3 THEN 10 ELSE 0 END, 100) AS points
  FROM (SELECT source_file, total, with_ip, coverage, coverage >= @GATE@ AS ok, CASE WHEN ok THEN regions END AS regions, CASE WHEN ok THEN gini END AS gini,
      CASE WHEN ok THEN top3 END AS top3, CASE WHEN ok THEN CAST(trunc(gini * 100) AS INTEGER) END AS focus, top_region, top_count,
      coalesce(ok AND wave, false) AS wave, CASE WHEN ok THEN coalesce(pattern, 'unknown') ELSE 'unknown' END AS pattern
    FROM cov LEFT JOIN con USING (source_file) LEFT JOIN wv USING (source_file))),
reg_out AS (SELECT *, CASE WHEN NOT ok THEN 'low' WHEN points >= 70 THEN 'high' WHEN points >= 40 THEN 'medium' ELSE 'low' END AS ip_level,
  CASE WHEN NOT ok THEN ['IP 属地覆盖率仅 ' || {st.percent('coverage')} || '（' || with_ip || '/' || total || ' 条），低于分析阈值 @GATE_TEXT@，跳过地域分析']
    WHEN len(w) = 0 THEN ['地域分布正常，未发现明显集中传播特征'] ELSE w END AS ip_findings
  FROM (SELECT *, list_filter([
    CASE WHEN focus >= 80 THEN '地域高度集中：' || top_region || ' 占 ' || {st.percent('top_count::DOUBLE / with_ip')} || '，基尼系数 ' || {st.fixed('gini', 2)}
         WHEN focus >= 50 THEN '地域较集中（基尼系数 ' || {st.fixed('gini', 2)} || '）' END,
    CASE WHEN top3 >= 0.85 THEN '前3省份占比 ' || {st.percent('top3')} || '，疑似区域性集中操作' END,
    CASE WHEN wave THEN '检测到波浪式扩散模式：评论从少数省份向外扩散，疑似有组织传播' END,
    CASE WHEN regions = 1 THEN '所有评论仅来自 1 个省份（' || top_region || '）' WHEN regions <= 3 THEN '评论仅来自 ' || regions || ' 个省份，地域多样性极低' END],
    lambda x: x IS NOT NULL) AS w FROM rs))"""


def region_sql(table: str, gate: float = 0.3) -> str:
    return REGION_SQL.replace("@T@", table).replace("@GATE@", str(gate)).replace("@GATE_TEXT@", f"{gate:.0%}")


REGIONS = f"{st.COMMENTS}, {region_sql('comments')}"
# sources 'srcN' see fewer regions, so that every pattern occurs
_NARROW = """narrow AS (SELECT * REPLACE (CASE WHEN ord % 7 < k % 8 THEN 'R' || (CAST(regexp_extract(ip_location, '[0-9]+') AS BIGINT) % (1 + k % 4 + CASE WHEN k % 3 = 0 THEN ord // 100 ELSE 0 END)) END AS ip_location)
  FROM (SELECT *, CAST(regexp_extract(source_file, '[0-9]+') AS BIGINT) AS k FROM comments))"""
NARROW = f"{st.COMMENTS}, {_NARROW}, {region_sql('narrow')}"


def narrow_regions(spark, sf_dir):
    k = F.regexp_extract("source_file", "[0-9]+", 0).cast("bigint")
    number = F.regexp_extract("ip_location", "[0-9]+", 0).cast("bigint")
    spread = 1 + k % 4 + F.when(k % 3 == 0, F.floor(F.col("ord") / 100)).otherwise(0)
    name = F.concat(F.lit("R"), (number % spread).cast("string"))
    return views.comments(spark, sf_dir).withColumn("ip_location", F.when(F.col("ord") % 7 < k % 8, name))


@query("region_coverage", f"{NARROW} SELECT source_file, total, with_ip, round(coverage, 6) AS coverage FROM cov")
def region_coverage(spark, sf_dir):
    return regions.coverage(narrow_regions(spark, sf_dir), BY_SOURCE).select("source_file", "total", "with_ip", *r6("coverage"))


@query("region_distribution", f"{REGIONS} SELECT source_file, region, n, r AS rank FROM rk WHERE r <= 5")
def region_distribution(spark, sf_dir):
    counts = regions.region_counts(views.comments(spark, sf_dir), BY_SOURCE)
    return regions.top_regions(counts, BY_SOURCE).select("source_file", "region", "n", *long("rank"))


@query("region_gini", f"{NARROW} SELECT source_file, regions, round(gini, 6) AS gini FROM con")
def region_gini(spark, sf_dir):
    counts = regions.region_counts(narrow_regions(spark, sf_dir), BY_SOURCE)
    return regions.concentration(counts, BY_SOURCE).select("source_file", "regions", *r6("gini"))


@query("region_topk_ratio", f"""{NARROW}
SELECT source_file, round(top3, 6) AS top3_ratio, CAST(trunc(gini * 100) AS BIGINT) AS concentration_score, top_region FROM con""")
def region_topk_ratio(spark, sf_dir):
    out = regions.concentration(regions.region_counts(narrow_regions(spark, sf_dir), BY_SOURCE), BY_SOURCE)
    return out.select("source_file", *r6("top3_ratio"), *long("concentration_score"), "top_region")


@query("wave_spread", f"""{NARROW}
SELECT source_file, tn AS timed_rows, d0 AS regions_1, d1 AS regions_2, d2 AS regions_3, wave AS wave_detected, pattern FROM wv""")
def wave_spread(spark, sf_dir):
    return regions.wave_spread(narrow_regions(spark, sf_dir), BY_SOURCE).select(
        "source_file", "timed_rows", "regions_1", "regions_2", "regions_3", "wave_detected", "pattern")


@query("wave_spread_all", f"""{st.ACTIVITY}, loc AS (SELECT {st.REGION} AS region, publish_time, ord FROM activity),
tl AS (SELECT *, row_number() OVER (ORDER BY publish_time, ord) - 1 AS rn, count(*) OVER () AS tn FROM loc WHERE region IS NOT NULL)
SELECT tn AS timed_rows, count(DISTINCT region) FILTER (rn < tn // 3) AS regions_1, count(DISTINCT region) FILTER (rn >= tn // 3 AND rn < 2 * tn // 3) AS regions_2,
  count(DISTINCT region) FILTER (rn >= 2 * tn // 3) AS regions_3 FROM tl GROUP BY 1""")
def wave_spread_all(spark, sf_dir):
    return regions.wave_spread(views.activity(spark, sf_dir)).select("timed_rows", "regions_1", "regions_2", "regions_3")


@query("region_suspicion", f"""{NARROW}
SELECT source_file, ok AS has_sufficient_ip, CAST(points AS BIGINT) AS suspicion_score, ip_level AS suspicion_level, array_to_string(ip_findings, '|') AS findings FROM reg_out""")
def region_suspicion(spark, sf_dir):
    out = regions.suspicion(narrow_regions(spark, sf_dir), BY_SOURCE)
    return out.select("source_file", "has_sufficient_ip", *long("suspicion_score"), "suspicion_level", joined("findings"))


@query("region_top10_others", f"""{st.ACTIVITY},
lastc AS (SELECT source_file, user_name, arg_max(ip_location, ord) AS ip, max(ord) AS ord FROM activity GROUP BY 1, 2),
c AS (SELECT source_file, ip, count(*) AS n, min(ord) AS f FROM lastc WHERE ip IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, f, ip) AS r FROM c)
SELECT source_file, CASE WHEN r <= 10 THEN ip ELSE 'Others' END AS region, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def region_top10_others(spark, sf_dir):
    return regions.top_and_others(views.activity(spark, sf_dir), BY_SOURCE, per_user=True).select("source_file", "region", "n")
