"""Join-shaped steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrisk.functions import scoring as sc
from voxrisk.functions.lexicon import PROVINCE_EN, inline_words
from voxrisk.operators.scaling import first_per_key
from voxrisk.operators.wordsearch import found_words


def sentiment_back(comments: DataFrame, results: DataFrame, columns: Sequence[str] = ("sentiment", "sentiment_score", "risk_score")) -> DataFrame:
    """Scores onto comments by id. Of several results per id the last wins; comments
    without a result keep nulls."""
    last = first_per_key(results.select("comment_id", "ord", *columns), ["comment_id"], [F.desc("ord")])
    return comments.join(last.drop("ord"), "comment_id", "left")


def lexicon_join(df: DataFrame, words: DataFrame, keep: Sequence[str] = ("ord",), content: str = "content") -> DataFrame:
    """(row, word, category) for every listed word a text contains.

    A list that fits in the plan is tested in place, a longer one goes through ``indexed_join``; both give the same rows.
    """
    small = inline_words(words)
    if small is None:
        return indexed_join(df, words, keep, content)
    hits = df.select(*keep, F.explode_outer(sc.contained_words(F.col(content), small)).alias("word"))
    hits = hits.filter(F.col("word").isNotNull())
    return hits.join(words, "word") if "category" in words.columns else hits


def indexed_join(df: DataFrame, words: DataFrame, keep: Sequence[str], content: str = "content") -> DataFrame:
    """``lexicon_join`` for a list of any length; ``keep`` has to tell the rows apart."""
    hits = found_words(df, words, keep, content)
    return hits.join(words, "word") if "category" in words.columns else hits


def without_stopwords(tokens: DataFrame, stopwords: DataFrame, token: str = "token") -> DataFrame:
    """Token rows whose token is not listed."""
    return tokens.join(stopwords.select(F.col("word").alias(token)), token, "left_anti")


def province_table(spark: SparkSession, names: dict[str, str] = PROVINCE_EN) -> DataFrame:
    return spark.createDataFrame(list(names.items()), "region STRING, english STRING")


def province_names(df: DataFrame, names: DataFrame, default: str = "Others") -> DataFrame:
    """English region name; ``default`` for names not in the table."""
    joined = df.join(names, "region", "left")
    return joined.withColumn("english", F.coalesce("english", F.lit(default)))


def parent_replies(df: DataFrame, scope: Sequence[str] = ("source_file",)) -> DataFrame:
    """Replies beside the comment they answer."""
    mains = df.filter(~F.col("is_reply")).select(
        *scope, F.col("comment_id").alias("parent_id"), F.col("user_name").alias("parent_user"),
        F.length("content").alias("parent_length"),
    )
    replies = df.filter("is_reply").select(
        *scope, "parent_id", F.col("comment_id").alias("reply_id"), F.col("user_name").alias("reply_user")
    )
    return replies.join(mains, [*scope, "parent_id"])


def comments_of_accounts(comments: DataFrame, accounts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Comments written by the listed accounts."""
    return comments.join(accounts.select(*keys), list(keys), "left_semi")


def union_all(*sources: DataFrame) -> DataFrame:
    """Rows of all sources, columns matched by name; missing ones become null."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source, allowMissingColumns=True)
    return out
