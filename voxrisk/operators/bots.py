"""Bot scores per user (v1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrisk.functions import text as tx
from voxrisk.operators.scaling import top_k
from voxrisk.operators.users import ALNUM_NAME, BOT_PREFIXES, DIGIT_NAME, user_key


def bot_features(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Narrow per-row inputs; the text itself stays behind."""
    content = tx.blank_if_null(F.col("content"))
    return df.select(
        *scope, user_key().alias("user"), "user_name", "platform", "user_level", "ord", "publish_time",
        F.nullif(F.col("ip_location"), F.lit("")).alias("ip"),
        tx.text_key(content).alias("content_key"),
        tx.count_unicode_emoji(content).alias("n_emoji"),
        tx.count_at(content).alias("n_at"),
    )


def bot_measures(features: DataFrame, scope: Sequence[str] = (), min_comments: int = 3) -> DataFrame:
    """All measures of a user in one grouping.

    The 24 hour counters replace a second grouping by hour, and min = max replaces
    a distinct count of regions.
    """
    hour = F.hour("publish_time")
    per_hour = F.greatest(*[F.count_if(hour == h) for h in range(24)])
    n = F.col("total_comments")
    grouped = (
        features.groupBy(*scope, "user")
        .agg(
            F.count("*").alias("total_comments"),
            F.max_by("user_name", "ord").alias("user_name"),
            F.max_by("platform", "ord").alias("platform"),
            F.count("publish_time").alias("n_timed"),
            ((F.unix_micros(F.max("publish_time")) - F.unix_micros(F.min("publish_time"))) / 3.6e9).alias("span_hours"),
            F.count_distinct("content_key").alias("unique_contents"),
            F.avg(F.nullif("user_level", F.lit(0))).alias("avg_level"),
            F.count("ip").alias("n_ip"),
            (F.min("ip") == F.max("ip")).alias("one_ip"),
            per_hour.alias("_busiest"),
            F.avg("n_emoji").alias("avg_emoji"),
            F.avg("n_at").alias("avg_at"),
        )
        .filter(n >= min_comments)
    )
    return grouped.withColumns({
        "content_similarity": F.when(n < 2, 0.0).otherwise(1 - F.col("unique_contents") / n),
        "max_hour_share": F.try_divide("_busiest", "n_timed"),
    }).drop("_busiest")


def frequency(measures: DataFrame) -> DataFrame:
    n, timed, span = F.col("total_comments"), F.col("n_timed"), F.col("span_hours")
    rate = (
        F.when((n < 2) | (timed < 2), F.lit(0.0))
        .when(span == 0, n.cast("double"))
        .otherwise(F.try_divide(n, span))
    )
    out = measures.withColumn("avg_comments_per_hour", rate)
    r = F.col("avg_comments_per_hour")
    score = (
        F.when((n < 2) | (timed < 2), 0).when(span == 0, 100)
        .when(r > 20, 100).when(r > 10, 80).when(r > 5, 60).when(r > 2, 30).otherwise(0)
    )
    return out.withColumn("frequency_score", score)


def repetition(measures: DataFrame) -> DataFrame:
    s = F.col("content_similarity")
    score = F.when(s > 0.8, 100).when(s > 0.6, 80).when(s > 0.4, 50).otherwise((s * 50).cast("int"))
    return measures.withColumn("repetition_score", score)


def account(measures: DataFrame) -> DataFrame:
    name = F.col("user_name")
    prefixed = F.lower(name).rlike("^(" + "|".join(BOT_PREFIXES) + ")")
    score = (
        F.when(name.rlike(DIGIT_NAME), 30).when(name.rlike(ALNUM_NAME), 20).otherwise(0)
        + F.when(prefixed, 30).otherwise(0)
        + F.when(F.col("avg_level") < 2, 20).otherwise(0)
        + F.when(F.col("one_ip") & (F.col("n_ip") > 5), 10).otherwise(0)
    )
    return measures.withColumn("account_score", F.least(score, F.lit(100)))


def behavior(measures: DataFrame) -> DataFrame:
    score = (
        F.when(F.col("max_hour_share") > 0.8, 30).otherwise(0)
        + F.when(F.col("avg_emoji") > 5, 20).otherwise(0)
        + F.when(F.col("avg_at") > 2, 20).otherwise(0)
    )
    return measures.withColumn("behavior_score", F.least(score, F.lit(100)))


def bot_scores(features: DataFrame, scope: Sequence[str] = (), min_comments: int = 3) -> DataFrame:
    """One row per user: four part scores, the overall score, level and reasons."""
    parts = behavior(account(repetition(frequency(bot_measures(features, scope, min_comments)))))
    freq, rep = F.col("frequency_score"), F.col("repetition_score")
    acc, beh = F.col("account_score"), F.col("behavior_score")
    overall = (freq * 0.3 + rep * 0.3 + acc * 0.2 + beh * 0.2).cast("int")
    reasons = F.array_compact(F.array(
        F.when(freq >= 60, F.concat(F.lit("发言频率异常: 平均 "), tx.fixed(F.col("avg_comments_per_hour"), 1), F.lit(" 条/小时"))),
        F.when(rep >= 60, F.concat(F.lit("内容重复度高: "), tx.percent(F.col("content_similarity")))),
        F.when(acc >= 50, F.lit("账号特征异常")),
        F.when(beh >= 50, F.lit("行为模式异常")),
    ))
    scored = parts.withColumns({"overall_score": overall, "_reasons": reasons})
    score = F.col("overall_score")
    return scored.withColumns({
        "risk_level": F.when(score < 30, "low").when(score < 60, "medium").otherwise("high"),
        "reasons": F.when(F.size("_reasons") == 0, F.array(F.lit("未发现明显异常"))).otherwise(F.col("_reasons")),
    }).drop("_reasons")


def bot_summary(scored: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    level = F.col("risk_level")
    out = scored.groupBy(*scope).agg(
        F.count("*").alias("total_users"),
        *[F.count_if(level == name).alias(f"{name}_risk") for name in ("high", "medium", "low")],
        F.avg("overall_score").alias("avg_risk_score"),
    )
    return out.withColumns({
        f"{name}_risk_ratio": F.try_divide(f"{name}_risk", "total_users") for name in ("high", "medium", "low")
    })


def high_risk_accounts(scored: DataFrame, scope: Sequence[str] = (), k: int = 20, level: str = "high") -> DataFrame:
    """Highest scores among the accounts at a level."""
    flagged = scored.filter(F.col("risk_level") == level)
    return top_k(flagged, scope, [F.desc("overall_score"), F.col("user")], k, spread_on=["user"])
