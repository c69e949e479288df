"""Anomaly detectors (v1): one long table of anomalies per scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrisk.functions import text as tx
from voxrisk.functions.lexicon import CONCENTRATION_WORDS, OVERSEAS_NAMES
from voxrisk.operators.scaling import keyed, unkeyed

SEVERITIES = ("critical", "high", "medium", "low")
# Detector order; it decides among anomalies of equal severity.
DETECTORS = (
    "volume_spike", "night_activity", "location_concentration", "overseas_activity",
    "negative_sentiment_spike", "high_risk_content", "content_duplication",
    "spam_short_content", "sensitive_keyword_concentration",
)


def hourly_counts(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    timed = df.filter(F.col("publish_time").isNotNull())
    return timed.groupBy(*scope, F.date_trunc("hour", "publish_time").alias("hour_start")).agg(F.count("*").alias("n"))


def hour_averages(hourly: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Each non-empty hour beside the mean and number of its scope's hours."""
    keys, work = keyed(hourly, scope)
    whole = Window.partitionBy(*keys)
    out = work.withColumns({"avg_n": F.avg("n").over(whole), "n_hours": F.count("*").over(whole)})
    return unkeyed(out, scope)


def _details(**values: Column) -> Column:
    parts: list[Column] = []
    for name, value in values.items():
        parts += [F.lit(name), value.cast("string")]
    return F.create_map(*parts)


def _anomaly(kind: str, hit: Column, severity: Column, score: Column, description: Column, affected: Column,
             details: Column | None = None, time_window: Column | None = None) -> Column:
    """The anomaly as a struct where the test holds, else null."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(hit, F.struct(
        F.lit(kind).alias("anomaly_type"), severity.alias("severity"), score.cast("int").alias("score"),
        description.alias("description"), affected.cast("bigint").alias("affected_count"),
        (time_window if time_window is not None else F.lit(None).cast("string")).alias("time_window"),
        (details if details is not None else none).alias("details"),
        F.lit(DETECTORS.index(kind)).alias("detector_no"),
    ))


def found(rows: DataFrame, scope: Sequence[str], *detectors: Column) -> DataFrame:
    """The anomalies that the detectors see in the rows, one row each."""
    return rows.select(*scope, F.inline(F.array_compact(F.array(*detectors))))


def volume_spike(hourly: DataFrame, scope: Sequence[str] = (), factor: float = 3.0, high_factor: float = 5.0, min_hours: int = 3) -> DataFrame:
    """Hours with far more comments than the scope's mean non-empty hour."""
    base = hour_averages(hourly, scope).filter(F.col("n_hours") >= min_hours)
    n, avg = F.col("n"), F.col("avg_n")
    ratio = n / avg
    return found(base, scope, _anomaly(
        "volume_spike", n > avg * factor, F.when(n > avg * high_factor, "high").otherwise("medium"),
        F.least(((ratio - 1) * 20).cast("int"), F.lit(100)),
        F.concat(F.lit("评论量突增: "), n.cast("string"), F.lit(" 条 (平均 "), tx.fixed(avg, 1), F.lit(" 条)")),
        n, _details(ratio=ratio), F.date_format("hour_start", "yyyy-MM-dd HH:00"),
    ))


# --- one row of figures per scope ------------------------------------------------


def anomaly_features(df: DataFrame, scope: Sequence[str] = (), words: Sequence[str] = CONCENTRATION_WORDS, short_below: int = 10) -> DataFrame:
    """Narrow per-row inputs of the detectors; the text stays behind. Scores are kept
    where the rows have them."""
    content = tx.blank_if_null(F.col("content"))
    scores = [name for name in ("sentiment", "risk_score") if name in df.columns]
    return df.select(
        *scope, "ord", "publish_time", "ip_location", *scores, tx.text_key(content).alias("content_key"),
        (F.length(content) < short_below).alias("is_short"),
        F.array(*[F.contains(content, F.lit(w)) for w in words]).alias("has_word"),
    )


def scope_measures(features: DataFrame, scope: Sequence[str] = (), words: Sequence[str] = CONCENTRATION_WORDS, high_risk: int = 60) -> DataFrame:
    """Everything the scope-wide detectors need, from one pass over the rows."""
    scored = "sentiment" in features.columns
    aggs = [
        F.count("*").alias("total"),
        F.count_if(F.hour("publish_time") < 6).alias("night"),
        F.count_distinct("content_key").alias("distinct_contents"),
        F.count_if("is_short").alias("short_contents"),
        *[F.count_if(F.col("has_word")[i]).alias(f"_n{i}") for i in range(len(words))],
    ]
    if scored:
        aggs += [
            F.count("sentiment").alias("scored"),
            F.count_if(F.col("sentiment") == "negative").alias("negative"),
            F.count_if(F.col("risk_score") >= high_risk).alias("high_risk"),
        ]
    out = features.groupBy(*scope).agg(*aggs)
    ranked = [
        F.struct(F.col(f"_n{i}").alias("n"), F.lit(-i).alias("pos"), F.lit(w).alias("word")) for i, w in enumerate(words)
    ]
    best = F.array_max(F.array(*ranked))
    return out.withColumns({
        "duplicate_ratio": 1 - F.col("distinct_contents") / F.col("total"),
        "top_word": best["word"], "top_word_count": best["n"],
    }).drop(*[f"_n{i}" for i in range(len(words))])


def location_measures(df: DataFrame, scope: Sequence[str] = (), overseas: Sequence[str] = OVERSEAS_NAMES) -> DataFrame:
    """Region totals per scope from the region counts; ties go to the first seen."""
    name = F.nullif(F.col("ip_location"), F.lit(""))
    counts = (
        df.select(*scope, name.alias("region"), "ord").filter(F.col("region").isNotNull())
        .groupBy(*scope, "region").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    )
    best = F.max(F.struct("n", (-F.col("first_ord")).alias("pos"), "region"))
    out = counts.groupBy(*scope).agg(
        F.count("*").alias("n_regions"), F.sum("n").alias("located"), best.alias("_best"),
        F.coalesce(F.sum(F.when(F.col("region").isin(*overseas), F.col("n"))), F.lit(0)).alias("overseas"),
    )
    return out.withColumns({"top_region": F.col("_best.region"), "top_region_count": F.col("_best.n")}).drop("_best")


def scope_summary(
    features: DataFrame, hourly: DataFrame, scope: Sequence[str] = (), words: Sequence[str] = CONCENTRATION_WORDS,
    overseas: Sequence[str] = OVERSEAS_NAMES, high_risk: int = 60,
) -> DataFrame:
    """Row, region and hour figures of each scope side by side."""
    keys, rows = keyed(features, scope)
    _, hours = keyed(hourly, scope)
    out = scope_measures(rows, keys, words, high_risk).join(location_measures(rows, keys, overseas), keys, "left")
    return unkeyed(out.join(hours.groupBy(*keys).agg(F.count("*").alias("n_hours")), keys, "left"), scope)


# --- detectors over that row -----------------------------------------------------


def night_activity(limit: float = 0.3, min_hours: int = 3) -> Column:
    night = F.col("night")
    ratio = night / F.col("total")
    return _anomaly(
        "night_activity", (F.col("n_hours") >= min_hours) & (ratio > limit), F.lit("medium"), (ratio * 100).cast("int"),
        F.concat(F.lit("深夜异常活动: "), night.cast("string"), F.lit(" 条评论 ("), tx.percent(ratio), F.lit(")")),
        night, _details(night_ratio=ratio),
    )


def location_concentration(limit: float = 0.5, min_rows: int = 20) -> Column:
    ratio = F.col("top_region_count") / F.col("located")
    return _anomaly(
        "location_concentration", (F.col("n_regions") >= 2) & (ratio > limit) & (F.col("located") > min_rows),
        F.lit("medium"), (ratio * 100).cast("int"),
        F.concat(F.lit("地域集中异常: "), F.col("top_region"), F.lit(" 占比 "), tx.percent(ratio)),
        F.col("top_region_count"), _details(location=F.col("top_region"), ratio=ratio),
    )


def overseas_activity(min_rows: int = 10, limit: float = 0.1) -> Column:
    n = F.col("overseas")
    ratio = n / F.col("located")
    return _anomaly(
        "overseas_activity", (F.col("n_regions") >= 2) & (n > min_rows) & (ratio > limit), F.lit("low"),
        (ratio * 100).cast("int"),
        F.concat(F.lit("海外异常活动: "), n.cast("string"), F.lit(" 条评论 ("), tx.percent(ratio), F.lit(")")), n,
    )


def negative_spike(limit: float = 0.7, critical: float = 0.8) -> Column:
    n = F.col("negative")
    ratio = F.try_divide(n, "scored")
    return _anomaly(
        "negative_sentiment_spike", ratio > limit, F.when(ratio > critical, "critical").otherwise("high"),
        (ratio * 100).cast("int"),
        F.concat(F.lit("负面情感异常: "), n.cast("string"), F.lit(" 条 ("), tx.percent(ratio), F.lit(")")),
        n, _details(negative_ratio=ratio),
    )


def high_risk_content(min_rows: int = 10) -> Column:
    n = F.col("high_risk")
    return _anomaly(
        "high_risk_content", n > min_rows, F.lit("high"), F.least(n * 2, F.lit(100)),
        F.concat(F.lit("高风险评论: "), n.cast("string"), F.lit(" 条")), n,
    )


def content_duplication(limit: float = 0.3, high: float = 0.5) -> Column:
    ratio = F.col("duplicate_ratio")
    return _anomaly(
        "content_duplication", ratio > limit, F.when(ratio > high, "high").otherwise("medium"), (ratio * 100).cast("int"),
        F.concat(F.lit("内容重复异常: 重复率 "), tx.percent(ratio)),
        (F.col("total") * ratio).cast("bigint"), _details(duplicate_ratio=ratio),
    )


def spam_short(limit: float = 0.4, short_below: int = 10) -> Column:
    n = F.col("short_contents")
    ratio = n / F.col("total")
    return _anomaly(
        "spam_short_content", ratio > limit, F.lit("medium"), (ratio * 100).cast("int"),
        F.concat(F.lit("短评论刷屏: "), n.cast("string"), F.lit(f" 条 (< {short_below}字)")), n,
    )


def keyword_concentration(min_rows: int = 10) -> Column:
    n = F.col("top_word_count")
    return _anomaly(
        "sensitive_keyword_concentration", n > min_rows, F.lit("medium"), F.least(n * 5, F.lit(100)),
        F.concat(F.lit("敏感词集中: '"), F.col("top_word"), F.lit("' 出现 "), n.cast("string"), F.lit(" 次")),
        n, _details(keyword=F.col("top_word"), count=n),
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def anomalies(
    features: DataFrame, scope: Sequence[str] = (), *, words: Sequence[str] = CONCENTRATION_WORDS,
    overseas: Sequence[str] = OVERSEAS_NAMES, volume_factor: float = 3.0, night_limit: float = 0.3,
    location_limit: float = 0.5, negative_limit: float = 0.7, duplicate_limit: float = 0.3, short_limit: float = 0.4,
) -> DataFrame:
    """All detectors over the rows of ``anomaly_features``; ``severity_no`` and
    ``detector_no`` give the report order. The eight scope-wide detectors read one
    summary row, so the comments are aggregated once."""
    hourly = hourly_counts(features, scope)
    summary = scope_summary(features, hourly, scope, words, overseas)
    wide = found(
        summary, scope, night_activity(night_limit), location_concentration(location_limit), overseas_activity(),
        negative_spike(negative_limit), high_risk_content(), content_duplication(duplicate_limit),
        spam_short(short_limit), keyword_concentration(),
    )
    both = volume_spike(hourly, scope, volume_factor).unionByName(wide)
    return both.withColumn("severity_no", severity_rank(F.col("severity")))


def in_report_order(anomalies_found: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return anomalies_found.orderBy(*scope, "severity_no", "detector_no", "time_window")


def anomaly_summary(anomalies_found: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Counts per severity, the kinds found, and two flags."""
    out = anomalies_found.groupBy(*scope).agg(
        F.count("*").alias("total_anomalies"),
        *[F.count_if(F.col("severity") == name).alias(name) for name in SEVERITIES],
        F.array_sort(F.collect_set("anomaly_type")).alias("anomaly_types"),  # nine kinds at most
    )
    return out.withColumns({"has_critical": F.col("critical") > 0, "has_high": F.col("high") > 0})
