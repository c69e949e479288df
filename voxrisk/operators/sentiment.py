"""Sentiment, sensitive words and row risk; distributions over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.functions import scoring as sc
from voxrisk.functions import text as tx
from voxrisk.functions.lexicon import MAX_INLINE_WORDS, Profile
from voxrisk.operators.scaling import top_k
from voxrisk.operators.wordsearch import with_found

#: What tells the rows of a comment table apart.
ROW = ("source_file", "ord")


def _with_words(df: DataFrame, name: str, words: Sequence, content: str) -> DataFrame:
    """The rows with the listed words that they contain: (word, category) if the list has categories."""
    categorised = bool(words) and not isinstance(words[0], str)
    if len(words) <= MAX_INLINE_WORDS:
        pick = sc.contained_categorised if categorised else sc.contained_words
        return sc.computed_once(df, **{name: pick(F.col(content), words)})
    schema = "place int, word string, category string" if categorised else "place int, word string"
    rows = [(i, *w) for i, w in enumerate(words)] if categorised else list(enumerate(dict.fromkeys(words)))
    return with_found(df, df.sparkSession.createDataFrame(rows, schema), ROW, name, content)


def with_sentiment(df: DataFrame, profile: Profile, content: str = "content", score: Column | None = None) -> DataFrame:
    """Add ``sentiment``, ``sentiment_score`` and (v2) ``confidence``.

    ``score`` replaces the lexicon score, e.g. with a trained model's probability.
    """
    if score is None:
        low = df.withColumn("_low", F.lower(content))
        if max(len(profile.positive), len(profile.negative)) <= MAX_INLINE_WORDS:
            hits = sc.computed_once(
                low, _pos=sc.count_contained(F.col("_low"), profile.positive), _neg=sc.count_contained(F.col("_low"), profile.negative))
        else:
            both = _with_words(_with_words(low, "_pos", profile.positive, "_low"), "_neg", profile.negative, "_low")
            hits = both.withColumns({"_pos": F.size("_pos"), "_neg": F.size("_neg")})
        scored = hits.withColumn("sentiment_score", sc.polarity(F.col("_pos"), F.col("_neg")))
        sure = sc.confidence(F.col("_pos"), F.col("_neg"))
    else:
        scored = df.withColumn("sentiment_score", F.coalesce(score, F.lit(0.5)))
        sure = sc.model_confidence(F.col("sentiment_score"))
    scored = scored.withColumn("sentiment", sc.label(F.col("sentiment_score")))
    if profile.name == "v2":
        scored = scored.withColumn("confidence", sure)
    return scored.drop("_low", "_pos", "_neg")


def with_sensitive(df: DataFrame, profile: Profile, content: str = "content") -> DataFrame:
    """Add the sensitive words of each row: with categories (v2) or flat (v1)."""
    if profile.name == "v2":
        hits = _with_words(df, "sensitive_words", profile.sensitive, content)
        return hits.withColumns({
            "sensitive_count": F.size("sensitive_words"),
            "sensitive_categories": F.array_distinct(F.transform("sensitive_words", lambda x: x["category"])),
        })
    words = [word for word, _ in profile.sensitive]
    hits = _with_words(df, "sensitive_words", words, content)
    return hits.withColumn("sensitive_count", F.size("sensitive_words"))


def with_risk(df: DataFrame, profile: Profile, content: str = "content") -> DataFrame:
    """Add ``risk_score`` and ``risk_level`` (and ``risk_factors`` for v2)."""
    text = F.col(content)
    if profile.name == "v2":
        df = sc.computed_once(df, _text_points=sc.text_features_v2(text))
        factors = F.struct(
            sc.sentiment_points_v2(F.col("sentiment"), F.col("sentiment_score")).alias("sentiment"),
            sc.sensitive_points_v2(F.col("sensitive_count"), F.size("sensitive_categories")).alias("sensitive"),
            F.col("_text_points").alias("text_features"),
        )
        scored = df.withColumn("risk_factors", factors).withColumn(
            "risk_score",
            F.least(
                F.col("risk_factors.sentiment") + F.col("risk_factors.sensitive") + F.col("risk_factors.text_features"),
                F.lit(100),
            ),
        )
        return scored.withColumn("risk_level", sc.risk_level_v2(F.col("risk_score"))).drop("_text_points")
    points = sc.text_points_v1(text)
    scored = sc.computed_once(df, _text_points=points).withColumn(
        "risk_score", sc.risk_score_v1(F.col("sentiment_score"), F.col("sensitive_count"), F.col("_text_points"))
    ).drop("_text_points")
    return scored.withColumn("risk_level", sc.risk_level_v1(F.col("risk_score")))


def analyze(df: DataFrame, profile: Profile, content: str = "content", score: Column | None = None) -> DataFrame:
    """All row measures of a profile. v2 leaves out rows without content."""
    rows = df.filter(F.coalesce(F.col(content), F.lit("")) != "") if profile.name == "v2" else df
    rows = with_risk(with_sensitive(with_sentiment(rows, profile, content, score), profile, content), profile, content)
    return rows.withColumn("keywords", tx.first_keywords(F.col(content), profile.stopwords))


def share(part: Column, total: Column) -> Column:
    return F.try_divide(part, total)


def distribution(df: DataFrame, scope: Sequence[str], profile: str = "v2", high_risk: int = 60) -> DataFrame:
    """Counts, ratios and averages of scored rows per scope."""
    is_label = {name: F.count_if(F.col("sentiment") == name) for name in ("positive", "negative", "neutral")}
    aggs = [F.count("*").alias("total"), *[agg.alias(name) for name, agg in is_label.items()]]
    flags: list[str] = []
    if profile == "v2":
        aggs += [
            F.count_if(F.col("sensitive_count") > 0).alias("with_sensitive"),
            F.count_if(F.col("risk_score") >= high_risk).alias("high_risk"),
        ]
        flags = ["with_sensitive", "high_risk"]
    aggs += [
        F.avg("sentiment_score").alias("avg_sentiment_score"),
        F.avg("risk_score").alias("avg_risk_score"),
    ]
    out = df.groupBy(*scope).agg(*aggs)
    return out.withColumns({f"{name}_ratio": share(F.col(name), F.col("total")) for name in (*is_label, *flags)})


def category_counts(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rows per sensitive category (each row counts once per category)."""
    return (
        df.select(*scope, F.explode("sensitive_categories").alias("category"))
        .groupBy(*scope, "category")
        .agg(F.count("*").alias("n"))
    )


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, scope: Sequence[str] = ()) -> DataFrame:
    """Row counts in equal-width bins over [low, high]; empty bins count 0.

    The last bin includes the upper bound.
    """
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    inside = df.filter(F.col(column).between(low, high))
    counts = inside.groupBy(*scope, place.alias("bin")).agg(F.count("*").alias("n"))
    spread = F.map_from_entries(F.collect_list(F.struct("bin", "n")))  # at most ``bins`` entries
    packed = counts.groupBy(*scope).agg(spread.alias("_m"))
    return packed.select(
        *scope, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_m"
    ).select(
        *scope, "bin", (F.col("bin") * width + low).alias("bin_low"),
        F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).alias("n"),
    )


def top_high_risk(
    df: DataFrame, scope: Sequence[str], threshold: int = 60, k: int = 10, excerpt: int = 100
) -> DataFrame:
    """Riskiest rows per scope, earlier rows first among equals."""
    risky = df.filter(F.col("risk_score") >= threshold).select(
        *scope, "ord", F.substring("content", 1, excerpt).alias("content"), "risk_score", "sensitive_words"
    )
    return top_k(risky, scope, [F.desc("risk_score"), F.col("ord")], k, spread_on=["ord"])
