"""Overall scores, findings, warnings and recommendations per scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.functions import text as tx


def _lines(*options: Column) -> Column:
    return F.array_compact(F.array(*options))


def _or_default(lines: Column, default: str) -> Column:
    return F.when(F.size(lines) == 0, F.array(F.lit(default))).otherwise(lines)


def _cap(points: Column) -> Column:
    """At most 100; null stays null (``least`` would skip it)."""
    return F.when(points > 100, F.lit(100)).otherwise(points)


# --- v2 ------------------------------------------------------------------------


def sentiment_part_v2() -> Column:
    raw = F.col("negative_ratio") * 40 + F.col("high_risk_ratio") * 40 + F.col("avg_risk_score") * 0.2
    return F.coalesce(_cap(raw.cast("int")), F.lit(0))


def overall_v2(summary: DataFrame) -> DataFrame:
    """Parts, weighted total and level. Needs negative_ratio, high_risk_ratio,
    avg_risk_score, has_sufficient_ip, ip_score, user_score (mean over platforms)."""
    parts = summary.withColumns({
        "sentiment_part": sentiment_part_v2(),
        "ip_part": F.when(F.col("has_sufficient_ip"), F.coalesce("ip_score", F.lit(0))).otherwise(0),
        "user_part": F.coalesce(F.col("user_score").cast("int"), F.lit(0)),
    })
    s, ip, user = F.col("sentiment_part"), F.col("ip_part"), F.col("user_part")
    total = F.when(F.col("has_sufficient_ip"), (s * 0.40 + ip * 0.30 + user * 0.30).cast("int")).otherwise(
        (s * 0.50 + user * 0.50).cast("int")
    )
    out = parts.withColumns({"overall_score": _cap(total), "anomaly_part": F.lit(0)})
    score = F.col("overall_score")
    level = F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "medium").otherwise("low")
    return out.withColumn("overall_level", level)


def findings_v2(limit: int = 15) -> Column:
    """Sentiment lines, then region lines, then user lines."""
    negative, high = F.col("negative_ratio"), F.col("high_risk_ratio")
    own = _lines(
        F.when(negative > 0.5, F.concat(F.lit("负面情感占比 "), tx.percent(negative), F.lit("，舆论氛围偏负面"))),
        F.when(high > 0.1, F.concat(F.lit("高风险评论占比 "), tx.percent(high), F.lit("，含敏感内容"))),
    )
    none = F.array().cast("array<string>")
    return F.slice(F.concat(own, F.coalesce("ip_findings", none), F.coalesce("user_findings", none)), 1, limit)


def recommendations_v2() -> Column:
    suspicious = F.coalesce("suspicious_users", F.lit(0))
    lines = _lines(
        F.when(F.col("overall_level").isin("high", "critical"), F.lit("建议人工复核高风险评论，评估是否需要上报")),
        F.when(suspicious > 0, F.concat(F.lit("建议关注 "), suspicious.cast("string"), F.lit(" 个可疑账号，追踪其后续行为"))),
        F.when(F.col("wave_detected"), F.lit("检测到波浪式传播，建议追踪源头省份的账号")),
        F.when(F.col("high_risk") > 10, F.lit("高风险评论数量较多，建议扩大敏感词库覆盖范围")),
    )
    return _or_default(lines, "当前数据风险较低，保持常规监测即可")


# --- v1 ------------------------------------------------------------------------


def _has(kind: str) -> Column:
    return F.coalesce(F.array_contains("anomaly_types", kind), F.lit(False))


def sentiment_risk() -> Column:
    neg = F.col("negative_ratio")
    points = F.when(neg > 0.7, 40).when(neg > 0.5, 30).when(neg > 0.3, 20).otherwise(0)
    return F.coalesce(_cap(points + (F.col("avg_risk_score") * 0.6).cast("int")), F.lit(0))


def account_risk() -> Column:
    high = F.col("bot_high_ratio")
    points = F.when(high > 0.1, 50).when(high > 0.05, 30).when(high > 0.01, 15).otherwise(0)
    return F.coalesce(_cap(points + (F.col("bot_avg_score") * 0.5).cast("int")), F.lit(0))


def behavior_risk() -> Column:
    critical, high = F.coalesce("critical", F.lit(0)), F.coalesce("high", F.lit(0))
    kinds = F.coalesce(F.array_size("anomaly_types"), F.lit(0))
    points = (
        F.when(critical > 0, 50).otherwise(0)
        + F.when(high > 2, 30).when(high > 0, 20).otherwise(0)
        + F.least(kinds * 10, F.lit(30))
    )
    return _cap(points)


def content_risk() -> Column:
    points = (
        F.when(_has("content_duplication"), 30).otherwise(0)
        + F.when(_has("sensitive_keyword_concentration"), 25).otherwise(0)
        + F.when(_has("spam_short_content"), 20).otherwise(0)
    )
    return _cap(points)


def assess_v1(summary: DataFrame) -> DataFrame:
    """Four sub-scores, weighted total and level. Needs negative_ratio,
    avg_risk_score, bot_high_ratio, bot_avg_score, critical, high, anomaly_types."""
    parts = summary.withColumns({
        "sentiment_risk": sentiment_risk(), "account_risk": account_risk(),
        "behavior_risk": behavior_risk(), "content_risk": content_risk(),
    })
    total = (
        F.col("sentiment_risk") * 0.30 + F.col("account_risk") * 0.25
        + F.col("behavior_risk") * 0.25 + F.col("content_risk") * 0.20
    ).cast("int")
    out = parts.withColumns({"overall_score": total, "trend": F.lit("stable")})
    score = F.col("overall_score")
    level = F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")
    return out.withColumn("risk_level", level)


def warnings_v1() -> Column:
    critical, high = F.coalesce("critical", F.lit(0)), F.coalesce("high", F.lit(0))
    acting, wordy = F.col("behavior_risk") > 50, F.col("content_risk") > 40
    return _lines(
        F.when(F.col("sentiment_risk") > 60, F.concat(F.lit("负面情绪占比过高 ("), tx.percent(F.col("negative_ratio")), F.lit(")"))),
        F.when(F.col("account_risk") > 50, F.concat(F.lit("检测到 "), F.coalesce("bot_high", F.lit(0)).cast("string"), F.lit(" 个高风险账号"))),
        F.when(acting & (critical > 0), F.concat(F.lit("发现 "), critical.cast("string"), F.lit(" 个严重异常"))),
        F.when(acting & (high > 0), F.concat(F.lit("发现 "), high.cast("string"), F.lit(" 个高危异常"))),
        F.when(wordy & _has("content_duplication"), F.lit("存在内容重复刷屏行为")),
        F.when(wordy & _has("sensitive_keyword_concentration"), F.lit("敏感词出现频率异常")),
    )


# --- Fixed values: advice per level --------------------------------------------
ADVICE_V1 = {
    "critical": ("立即启动人工审核流程", "重点关注并标记高风险内容", "考虑限制高风险账号的发言权限"),
    "high": ("加强内容审核力度", "标记并跟踪高风险账号", "准备舆情应对预案"),
    "medium": ("持续监测舆情动态", "关注异常行为模式"),
    "low": ("保持正常监测",),
}


def recommendations_v1() -> Column:
    """Advice of the level, then advice triggered by the warnings (by prefix)."""
    level = F.col("risk_level")
    base = F.array(*[F.lit(line) for line in ADVICE_V1["low"]])
    for name in ("medium", "high", "critical"):
        base = F.when(level == name, F.array(*[F.lit(line) for line in ADVICE_V1[name]])).otherwise(base)
    extra = _lines(
        F.when(F.exists("warnings", lambda w: F.startswith(w, F.lit("负面情绪占比过高"))), F.lit("分析负面情绪来源,考虑正面引导")),
        F.when(F.exists("warnings", lambda w: F.contains(w, F.lit("高风险账号"))), F.lit("核查高风险账号的真实性")),
    )
    return F.concat(base, extra)
