"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrisk.functions import text as tx
from voxrisk.operators.scaling import head_per_scope
from voxrisk.operators.users import user_key


def nonempty(df: DataFrame, content: str = "content") -> DataFrame:
    return df.filter(tx.strip(tx.blank_if_null(F.col(content))) != "")


def platform_reply(df: DataFrame, platforms: Sequence[str] | None = None, replies: bool | None = None) -> DataFrame:
    """Rows of some platforms; only replies, only main comments, or both."""
    out = df if platforms is None else df.filter(F.col("platform").isin(*platforms))
    return out if replies is None else out.filter(F.col("is_reply") == F.lit(replies))


def high_risk(df: DataFrame, threshold: int = 60) -> DataFrame:
    return df.filter(F.col("risk_score") >= threshold)


def valid_time(df: DataFrame) -> DataFrame:
    return df.filter(F.col("publish_time").isNotNull())


def users_with_min_comments(df: DataFrame, scope: Sequence[str], minimum: int) -> DataFrame:
    """Users with enough comments, with their count."""
    counts = df.groupBy(*scope, user_key().alias("user")).agg(F.count("*").alias("n_comments"))
    return counts.filter(F.col("n_comments") >= minimum)


def preview(df: DataFrame, n: int = 1000) -> DataFrame:
    return df.orderBy("ord").limit(n)


def analysis_limit(df: DataFrame, scope: Sequence[str], n: int | None) -> DataFrame:
    """First ``n`` rows of every scope in file order, rows at one place of several files by file name; all rows
    without a limit. Looks up the n-th rows when called."""
    return df if n is None else head_per_scope(df, scope, "ord", n, None if "source_file" in scope else "source_file")
