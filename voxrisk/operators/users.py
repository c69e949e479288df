"""User profiles and their suspicion score (v2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.functions import text as tx
from voxrisk.operators.scaling import gap_statistics

LEVEL_PLATFORM = "bilibili"

# --- Fixed values: user-name patterns ------------------------------------------
TIEBA_GUEST_NAME = "^贴吧用户_[A-Za-z0-9]+$"
LONG_ALNUM_NAME = "^[a-zA-Z0-9_]{8,}$"
DIGIT_NAME = "^[0-9]+$"
ALNUM_NAME = "^[a-zA-Z0-9]+$"
BOT_PREFIXES = ("user_", "bot_", "auto_", "test_", "demo_")


def user_key() -> Column:
    return F.coalesce(
        F.nullif(F.col("user_id"), F.lit("")), F.nullif(F.col("user_name"), F.lit("")), F.lit("unknown")
    )


def name_pattern(name: Column) -> Column:
    """Which of the suspicious name shapes a name has, most specific first."""
    prefixed = F.lower(name).rlike("^(" + "|".join(BOT_PREFIXES) + ")")
    return (
        F.when(name.rlike(TIEBA_GUEST_NAME), "guest")
        .when(prefixed, "bot_prefix")
        .when(name.rlike(DIGIT_NAME), "digits")
        .when(name.rlike(LONG_ALNUM_NAME), "long_alnum")
        .when(name.rlike(ALNUM_NAME), "alnum")
        .otherwise("other")
    )


def profile_features(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Narrow per-row inputs of the profiles, so the text is not shuffled."""
    content = tx.blank_if_null(F.col("content"))
    bare = tx.strip(content)
    return df.select(
        *scope, "platform", user_key().alias("user"), "user_name", "user_level", "ord", "publish_time",
        F.coalesce("is_reply", F.lit(False)).alias("is_reply"),
        F.coalesce("like_count", F.lit(0)).alias("like_count"),
        F.length(content).alias("content_length"),
        F.length(bare).alias("bare_length"),
        tx.text_key(bare).alias("bare_key"),
        tx.has_at(content).alias("has_at"),
        (tx.count_bracket_emoji(content) + tx.count_unicode_emoji(content)).alias("n_emoji"),
    )


def user_profile(features: DataFrame, scope: Sequence[str] = (), min_comments: int = 2) -> DataFrame:
    """One row per (scope, platform, user) with at least ``min_comments`` rows.

    Level is averaged on the one platform that has levels; the name is that of the
    user's first comment.
    """
    keys = [*scope, "platform", "user"]
    level = F.when(F.col("platform") == LEVEL_PLATFORM, F.col("user_level"))
    distinct_texts = F.count_distinct(F.nullif("bare_key", F.lit("")))
    n = F.col("total_comments")
    grouped = (
        features.groupBy(*keys)
        .agg(
            F.count("*").alias("total_comments"),
            F.min_by("user_name", "ord").alias("user_name"),
            F.count_if("is_reply").alias("replies"),
            F.sum("like_count").alias("total_likes"),
            F.sum("content_length").alias("_len"),
            F.floor(F.avg(level)).cast("int").alias("user_level"),
            distinct_texts.alias("_texts"),
            F.count_if(F.col("bare_length") < 5).alias("_short"),
            F.count_if("has_at").alias("_at"),
            F.sum("n_emoji").alias("_emoji"),
        )
        .filter(n >= min_comments)
    )
    return grouped.select(
        *keys, "user_name", "total_comments", "replies", "total_likes", "user_level",
        (F.col("total_likes") / n).alias("avg_likes"),
        (F.col("_len") / n).alias("avg_content_length"),
        (F.col("_texts") / n).alias("unique_content_ratio"),
        (F.col("_short") / n).alias("short_content_ratio"),
        (F.col("_at") / n).alias("mention_ratio"),
        (F.col("_emoji") / n > 3).alias("emoji_heavy"),
    )


def time_regularity(features: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """How even the gaps between a user's comments are: 1 is clockwork, 0 is not.

    Needs two times to count as time data and three for a score above 0.
    """
    gaps = gap_statistics(features, [*scope, "platform", "user"], "publish_time")
    spread = F.try_divide("gap_std", "gap_mean")
    score = F.round(F.greatest(F.lit(0.0), 1 - F.least(spread, F.lit(2.0)) / 2), 3)
    return gaps.filter(F.col("n_times") >= 2).select(
        *scope, "platform", "user", "n_times",
        F.when(F.col("n_times") < 3, F.lit(0.0)).when(F.col("gap_mean") == 0, F.lit(1.0)).otherwise(score).alias("time_regularity"),
    )


def active_hours(features: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A user's comment hours in time order, as runs: one row per clock hour with
    its number of comments. Users with a single time are left out."""
    keys = [*scope, "platform", "user"]
    timed = features.filter(F.col("publish_time").isNotNull())
    start = F.date_trunc("hour", "publish_time")
    runs = timed.groupBy(*keys, start.alias("hour_start")).agg(F.count("*").alias("n"))
    enough = timed.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= 2).drop("_n")
    return runs.join(enough, keys, "left_semi").select(*keys, "hour_start", F.hour("hour_start").alias("hour"), "n")


def suspicion(profiles: DataFrame, regularity: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Score, level and reasons per user."""
    joined = profiles.join(regularity, [*scope, "platform", "user"], "left")
    unique, short = F.col("unique_content_ratio"), F.col("short_content_ratio")
    regular, level, n = F.col("time_regularity"), F.col("user_level"), F.col("total_comments")
    guest = F.col("user_name").rlike(TIEBA_GUEST_NAME)
    alnum = F.col("user_name").rlike(LONG_ALNUM_NAME)
    low_level = (level <= 1) & (n >= 5)
    points = (
        F.when(unique < 0.3, 40).when(unique < 0.6, 20).otherwise(0)
        + F.when(short > 0.8, 25).when(short > 0.5, 10).otherwise(0)
        + F.when(regular > 0.85, 25).when(regular > 0.65, 10).otherwise(0)
        + F.when(low_level, 20).when((level <= 2) & (n >= 10), 10).otherwise(0)
        + F.when(guest, 15).when(alnum, 10).otherwise(0)
    )
    pct = tx.percent
    reasons = F.array_compact(F.array(
        F.when(unique < 0.3, F.concat(F.lit("内容高度重复（唯一率 "), pct(unique), F.lit("）")))
        .when(unique < 0.6, F.concat(F.lit("内容存在重复（唯一率 "), pct(unique), F.lit("）"))),
        F.when(short > 0.8, F.concat(F.lit("大量极短评论（"), pct(short), F.lit(" 少于5字）"))),
        F.when(regular > 0.85, F.concat(F.lit("发言时间高度规律（规律性 "), tx.fixed(regular, 2), F.lit("）"))),
        F.when(low_level, F.concat(F.lit("低等级账号（Lv"), level.cast("string"), F.lit("）高频发言（"), n.cast("string"), F.lit("条）"))),
        F.when(guest, F.lit("用户名为系统生成格式（贴吧匿名用户）"))
        .when(alnum, F.lit("用户名为纯字母数字（疑似自动注册）")),
    ))
    scored = joined.withColumns({"suspicion_score": F.least(points, F.lit(100)), "_reasons": reasons})
    score = F.col("suspicion_score")
    return scored.withColumns({
        "suspicion_level": F.when(score >= 60, "high").when(score >= 40, "medium").otherwise("low"),
        "suspicion_reasons": F.when(F.size("_reasons") == 0, F.array(F.lit("未发现明显异常行为"))).otherwise(F.col("_reasons")),
    }).drop("_reasons")


def suspicious_users(scored: DataFrame, threshold: int = 40) -> DataFrame:
    return scored.filter(F.col("suspicion_score") >= threshold).orderBy(F.desc("suspicion_score"), "platform", "user")


def level_distribution(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Comments per user level on the platform that has levels."""
    levels = df.filter((F.col("platform") == LEVEL_PLATFORM) & F.col("user_level").isNotNull())
    return levels.groupBy(*scope, "user_level").agg(F.count("*").alias("n"))


def profiling_summary(features: DataFrame, scored: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per (scope, platform): user counts, mean score, findings."""
    keys = [*scope, "platform"]
    has_level = (F.col("platform") == LEVEL_PLATFORM) & F.col("user_level").isNotNull()
    per_user = features.groupBy(*keys, "user").agg(
        F.count_if(has_level).alias("_leveled"),
        F.count_if(has_level & (F.col("user_level") <= 2)).alias("_low"),
    )
    users = per_user.groupBy(*keys).agg(
        F.count("*").alias("total_users"), F.sum("_leveled").alias("_leveled"), F.sum("_low").alias("_low")
    )
    level = F.col("suspicion_level")
    scores = scored.groupBy(*keys).agg(
        F.count("*").alias("analyzed_users"),
        F.count_if(level == "high").alias("high_risk_count"),
        F.count_if(level == "medium").alias("medium_risk_count"),
        F.count_if(F.col("suspicion_score") >= 40).alias("suspicious_count"),
        F.avg("suspicion_score").alias("_avg"),
    )
    counters = ("analyzed_users", "high_risk_count", "medium_risk_count", "suspicious_count")
    merged = users.join(scores, keys, "left").withColumns({
        **{name: F.coalesce(name, F.lit(0)) for name in counters},
        "avg_suspicion_score": F.coalesce("_avg", F.lit(0.0)),
        "low_level_ratio": F.try_divide("_low", "_leveled"),
    })
    return findings(merged).drop("_avg", "_low", "_leveled")


def findings(summary: DataFrame, min_comments: int = 2) -> DataFrame:
    """Findings text per (scope, platform)."""
    analyzed, high, medium = F.col("analyzed_users"), F.col("high_risk_count"), F.col("medium_risk_count")
    avg, low = F.col("avg_suspicion_score"), F.col("low_level_ratio")
    lines = F.array_compact(F.array(
        F.when(high > 0, F.concat(
            F.lit("发现 "), high.cast("string"), F.lit(" 个高风险账号（占分析用户 "),
            tx.percent(F.try_divide(high, analyzed)), F.lit("）"))),
        F.when(medium > 0, F.concat(F.lit("发现 "), medium.cast("string"), F.lit(" 个中风险账号"))),
        F.when(avg > 50, F.concat(F.lit("整体账号可疑度偏高（均分 "), tx.fixed(avg, 1), F.lit("/100）"))),
        F.when((F.col("platform") == LEVEL_PLATFORM) & (low > 0.5), F.concat(
            F.lit("低等级用户（Lv0-2）占比 "), tx.percent(low), F.lit("，账号质量偏低"))),
    ))
    nobody = F.concat(F.col("platform"), F.lit(f": 无用户满足最少评论数（{min_comments}条）要求"))
    return summary.withColumn("_lines", lines).withColumn(
        "findings",
        F.when(analyzed == 0, F.array(nobody))
        .when(F.size("_lines") == 0, F.array(F.lit("用户行为整体正常，未发现明显可疑账号")))
        .otherwise(F.col("_lines")),
    ).drop("_lines")
