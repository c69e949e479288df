"""Complete analyses: one report row per scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrisk.functions import scoring
from voxrisk.functions.lexicon import V1, V2, Profile
from voxrisk.operators import anomalies as an
from voxrisk.operators import bots, filters, quality, regions, risk, sentiment, topics, users
from voxrisk.operators.scaling import keyed, top_k, unkeyed
from voxrisk.session import cut_lineage

#: Characters of a text that the v1 report quotes, and how many accounts and texts it lists.
EXCERPT, LISTED_ACCOUNTS, LISTED_TEXTS = 100, 20, 50


def row_features(comments: DataFrame, keys: Sequence[str], profile: Profile) -> DataFrame:
    """Everything later steps need of a row, without its text.

    Text is read, scored and hashed once here; what follows shuffles a few numbers.
    """
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    scored = sentiment.with_risk(
        sentiment.with_sensitive(sentiment.with_sentiment(comments, profile), profile), profile
    )
    analysed = ("sentiment", "sentiment_score", "sensitive_count", "risk_score")
    if profile.name == "v2":
        scored = scored.withColumns({name: F.when(~empty, F.col(name)) for name in analysed})
    base = users.profile_features(
        scored.withColumn("_carried", F.struct(*analysed, "ip_location")), [*keys, "_carried"]
    )
    return base.select(*[c for c in base.columns if c != "_carried"], "_carried.*")


def user_scores(features: DataFrame, keys: Sequence[str], min_comments: int = 2) -> DataFrame:
    profiles = users.user_profile(features, keys, min_comments)
    return users.suspicion(profiles, users.time_regularity(features, keys), keys)


def report_v2(
    comments: DataFrame, scope: Sequence[str] = ("source_file",), profile: Profile = V2, *, risk_threshold: int = 60,
    analysis_limit: int | None = None, min_coverage: float = regions.MIN_COVERAGE, features: DataFrame | None = None,
) -> DataFrame:
    """Sentiment, regions and users folded into one score and report row per scope."""
    keys, rows = keyed(comments, scope)
    if features is None:
        features = cut_lineage(row_features(rows, keys, profile))
    analysed = features.filter(F.col("sentiment").isNotNull())
    if analysis_limit is not None:
        analysed = filters.analysis_limit(features, keys, analysis_limit).filter(F.col("sentiment").isNotNull())
    mood = sentiment.distribution(analysed, keys, "v2", risk_threshold).withColumnRenamed("total", "analysed_comments")
    area = regions.suspicion(features, keys, min_coverage).select(
        *keys, F.col("total").alias("total_comments"), "with_ip", "coverage", "has_sufficient_ip", "gini", "top3_ratio",
        "concentration_score", "wave_detected", "pattern",
        F.col("suspicion_score").alias("ip_score"), F.col("suspicion_level").alias("ip_level"),
        F.col("findings").alias("ip_findings"),
    )
    places = regions.region_counts(features, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("region", "n"))).alias("provinces")  # region names, a bounded set
    )
    people = users.profiling_summary(features, user_scores(features, keys), keys)
    analysed_platform = F.col("analyzed_users") > 0
    per_platform = F.array_sort(F.collect_list(F.struct("platform", "findings")))  # one entry per platform
    people = people.groupBy(*keys).agg(
        F.avg(F.when(analysed_platform, F.col("avg_suspicion_score"))).alias("user_score"),
        F.sum("suspicious_count").alias("suspicious_users"),
        F.flatten(F.transform(per_platform, lambda x: x["findings"])).alias("user_findings"),
    )
    first_platform = features.groupBy(*keys).agg(F.min_by("platform", "ord").alias("platform"))
    joined = area.join(mood, keys, "left").join(people, keys, "left").join(places, keys, "left").join(first_platform, keys)
    out = risk.overall_v2(joined.withColumn("high_risk", F.coalesce("high_risk", F.lit(0))))
    out = out.withColumns({"key_findings": risk.findings_v2(), "recommendations": risk.recommendations_v2()})
    return unkeyed(out.withColumnRenamed("high_risk", "high_risk_comments"), scope)


def with_report_fields(report: DataFrame, source_url: str = "", generated_at: str | None = None) -> DataFrame:
    """The columns the renderers expect beside the figures. Reports of another scope than files name no file."""
    stamp = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    named = report if "source_file" in report.columns else report.withColumn("source_file", F.lit(""))
    return named.withColumns({"source_url": F.lit(source_url), "generated_at": stamp})


def row_features_v1(comments: DataFrame, keys: Sequence[str], profile: Profile = V1, risky_from: int = 60) -> DataFrame:
    """The v1 row inputs without the text, scored once and cut from their source. Rows of a risk of ``risky_from`` or more
    keep the beginning of their text and its sensitive words (``risky``)."""
    scored = sentiment.with_risk(
        sentiment.with_sensitive(sentiment.with_sentiment(comments, profile), profile), profile
    )
    risky = F.when(F.col("risk_score") >= risky_from, F.struct(F.substring("content", 1, EXCERPT).alias("excerpt"), "sensitive_words"))
    carried = F.struct("content", "ip_location", "sentiment", "sentiment_score", "risk_score", risky.alias("risky"))
    people = bots.bot_features(scored.withColumn("_row", carried), [*keys, "_row"]).drop("content_key")
    rows = people.select("*", "_row.*").drop("_row")
    own = ("content", "ord", "publish_time", "ip_location", "sentiment", "risk_score")  # added again below
    kept = [name for name in rows.columns if name not in own]
    topic_words = scoring.contained_words(F.col("content"), profile.topic_sensitive)
    rows = rows.withColumn("topic_words", topic_words)
    return cut_lineage(an.anomaly_features(rows, [*kept, "topic_words"], profile.concentration))


def assessment_v1(
    features: DataFrame, keys: Sequence[str], profile: Profile = V1, scored_users: DataFrame | None = None, **detector_limits: float
) -> DataFrame:
    """Sub-scores, warnings and advice from the rows of ``row_features_v1``. ``scored_users`` are their bot scores, if already known."""
    scored_users = bots.bot_scores(features, keys) if scored_users is None else scored_users
    mood = sentiment.distribution(features, keys, "v1").withColumnRenamed("total", "total_comments")
    accounts = bots.bot_summary(scored_users, keys).select(
        *keys, F.col("total_users").alias("bot_users"), F.col("high_risk").alias("bot_high"),
        F.col("medium_risk").alias("bot_medium"), F.col("low_risk").alias("bot_low"),
        F.col("high_risk_ratio").alias("bot_high_ratio"), F.col("avg_risk_score").alias("bot_avg_score"),
    )
    odd = an.anomaly_summary(
        an.anomalies(features, keys, words=profile.concentration, overseas=profile.overseas, **detector_limits), keys
    )
    out = risk.assess_v1(mood.join(accounts, list(keys), "left").join(odd, list(keys), "left"))
    out = out.withColumn("warnings", risk.warnings_v1())
    return out.withColumn("recommendations", risk.recommendations_v1())


def appendices_v1(features: DataFrame, scored_users: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per scope the accounts of high risk, highest scores first, and the riskiest texts, earlier ones first among equals; both in lists of
    bounded length. A scope with neither has no row."""
    flagged = bots.high_risk_accounts(scored_users, keys, LISTED_ACCOUNTS)
    account = F.struct(
        "rank", F.col("user").alias("user_id"), "user_name", F.col("overall_score").alias("risk_score"), "risk_level", "total_comments", "reasons")
    texts = features.where(F.col("risky").isNotNull()).select(*keys, "ord", "risk_score", "risky.*")
    texts = top_k(texts, keys, [F.desc("risk_score"), F.col("ord"), F.col("excerpt")], LISTED_TEXTS, spread_on=["ord"])
    text = F.struct("rank", F.col("ord").alias("index"), F.col("excerpt").alias("content"), "risk_score", "sensitive_words")

    def listed(rows: DataFrame, entry, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("rank")).alias(name))

    return listed(flagged, account, "high_risk_accounts").join(listed(texts, text, "sensitive_content"), list(keys), "full")


def report_v1(
    comments: DataFrame, scope: Sequence[str] = ("source_file",), profile: Profile = V1, *, keywords_k: int = 20, risky_from: int = 60,
    **detector_limits: float,
) -> DataFrame:
    """Sentiment, bots, anomalies and topics folded into the v1 assessment per scope, with the accounts and texts of high risk.

    The text is read three times: for the row features, the keywords, the topic labels.
    """
    keys, rows = keyed(comments, scope)
    features = row_features_v1(rows, keys, profile, risky_from)
    scored_users = cut_lineage(bots.bot_scores(features, keys))  # one row per user
    assessed = cut_lineage(assessment_v1(features, keys, profile, scored_users, **detector_limits))  # one row per scope
    words = cut_lineage(topics.keywords_count(rows, keys, profile.stopwords, keywords_k))  # k rows per scope
    leaning = topics.orientation(assessed.withColumnRenamed("total_comments", "total"))
    themes = topics.topic_summary(
        words, topics.topic_clusters(rows, keys, words), topics.word_ranking(features, keys, "topic_words"), leaning, keys,
        weight="n",
    ).drop("total", "orientation")
    span = quality.time_range(features, keys)
    out = assessed.join(themes, keys, "left").join(span, keys, "left").join(appendices_v1(features, scored_users, keys), keys, "left")
    out = out.withColumns({name: F.coalesce(name, F.array()) for name in ("high_risk_accounts", "sensitive_content")})
    return unkeyed(out.withColumn("platform", F.array_join("platforms", ", ")), scope)


def with_report_fields_v1(report: DataFrame, data_source: str = "", generated_at: str | None = None) -> DataFrame:
    """Id, time and data source of a v1 report; the id is made of the time."""
    stamp = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return report.withColumns({
        "data_source": F.lit(data_source), "generated_at": stamp, "report_id": F.concat(F.lit("RPT_"), F.regexp_replace(stamp, "[^0-9]", ""))})


def report_row_v1(report: DataFrame, scope: Sequence[str], data_source: str = "", generated_at: str | None = None) -> DataFrame:
    """The v1 report as one JSON record per scope."""
    report = with_report_fields_v1(report, data_source, generated_at)
    body = F.to_json(F.struct(
        "report_id", "generated_at", "data_source", "total_comments", "platform", F.struct("start", "end").alias("time_range"),
        F.col("overall_score").alias("overall_risk_score"), "risk_level",
        F.struct("sentiment_risk", "account_risk", "behavior_risk", "content_risk").alias("risk_breakdown"),
        F.struct("positive", "negative", "neutral", "avg_sentiment_score", "avg_risk_score").alias("sentiment_analysis"),
        F.struct("bot_users", "bot_high", "bot_medium", "bot_low", "bot_avg_score").alias("bot_detection"),
        F.struct("total_anomalies", "anomaly_types").alias("anomaly_detection"),
        F.struct("top_keywords", "orientation_label", "trending_score").alias("topic_analysis"),
        "warnings", "recommendations", "high_risk_accounts", "sensitive_content",
    ))
    return report.select(*scope, body.alias("report"))


