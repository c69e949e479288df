"""Row-level sentiment and risk as Column expressions, one set per profile.

v2 and v1 use different constants and are never mixed; every function takes or
implies its profile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.functions import text as tx
from voxrisk.functions.lexicon import Categorised

NEGATIVE_BELOW, POSITIVE_ABOVE = 0.35, 0.65


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns that are evaluated once per row, whatever follows.

    A filter on a projected column is moved below the projection, and the text would be
    searched again there, several times over, before any shuffle. Predicates are not
    moved below a generator, so the columns come out of one.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def contained_words(content: Column, words: Sequence[str]) -> Column:
    """Array of the distinct ``words`` that occur in the text."""
    if not words:
        return F.array().cast("array<string>")
    table = F.array(*[F.lit(w) for w in dict.fromkeys(words)])
    return F.filter(table, lambda w: F.contains(content, w))


def count_contained(content: Column, words: Sequence[str]) -> Column:
    return F.size(contained_words(content, words))


def contained_categorised(content: Column, words: Categorised) -> Column:
    """Array of (word, category) for the listed words that occur in the text."""
    if not words:
        return F.array().cast("array<struct<word:string,category:string>>")
    table = F.array(
        *[F.struct(F.lit(w).alias("word"), F.lit(c).alias("category")) for w, c in words]
    )
    return F.filter(table, lambda x: F.contains(content, x["word"]))


def label(score: Column) -> Column:
    """Both bounds are strict: 0.35 and 0.65 are neutral."""
    return (
        F.when(score < NEGATIVE_BELOW, "negative").when(score > POSITIVE_ABOVE, "positive").otherwise("neutral")
    )


def polarity(hits_pos: Column, hits_neg: Column) -> Column:
    """Share of positive hits; 0.5 without any hit."""
    total = hits_pos + hits_neg
    return F.when(total == 0, F.lit(0.5)).otherwise(F.try_divide(hits_pos, total))


def confidence(hits_pos: Column, hits_neg: Column) -> Column:
    return F.least((hits_pos + hits_neg) / F.lit(5.0), F.lit(1.0))


def model_confidence(score: Column) -> Column:
    return F.abs(score - 0.5) * 2


def text_features_v2(content: Column) -> Column:
    return (
        F.when(F.length(content) < 5, 10).otherwise(0)
        + F.when(tx.repeated_punct(content), 5).otherwise(0)
        + F.when(tx.repeated_emoji(content, "v2"), 5).otherwise(0)
    )


def sensitive_points_v2(n_words: Column, n_categories: Column) -> Column:
    points = F.least(n_categories * 15, F.lit(40)) + F.least(n_words * 8, F.lit(30))
    return F.when(n_words > 0, F.least(points, F.lit(40))).otherwise(0)


def sentiment_points_v2(sentiment: Column, score: Column) -> Column:
    negative = F.when(score < 0.2, 40).when(score < 0.35, 30).otherwise(20)
    return F.when(sentiment == "negative", negative).otherwise(0)


def risk_level_v2(score: Column) -> Column:
    return (
        F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").otherwise("low")
    )


def text_points_v1(content: Column) -> Column:
    size = F.length(content)
    return (
        F.when(size < 5, 15).when(size > 500, 5).otherwise(0)
        + F.when(tx.repeated_punct(content), 5).otherwise(0)
        + F.when(tx.repeated_emoji(content, "v1"), 5).otherwise(0)
        + F.when(tx.all_upper(content), 5).otherwise(0)
    )


def risk_score_v1(score: Column, n_words: Column, text_points: Column) -> Column:
    points = (
        F.when(score < 0.2, 30).when(score < 0.35, 20).when(score < 0.5, 10).otherwise(0)
        + F.least(n_words * 10, F.lit(40))
        + text_points
    )
    return F.least(points, F.lit(100))


def risk_level_v1(score: Column) -> Column:
    return F.when(score < 30, "low").when(score < 60, "medium").otherwise("high")


