"""Distinct counts that add up: sketches kept per scope and day, merged over any days.

Exact counts stay the default everywhere else; these are for questions over long times, where the rows can't be read again."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the registers' number: 2^14 of them tell a count within about 0.8 % (one standard error, 1.04 / sqrt(2^bits)).
PRECISION = 14


def daily_sketches(df: DataFrame, scope: Sequence[str], time: str, value: str, precision: int = PRECISION) -> DataFrame:
    """(scope, day, rows, sketch): one HyperLogLog sketch of ``value`` for every scope and day.

    The sketches of a scope are a few kilobytes a day at most, whatever the rows; tasks make their own and Spark unites them. Null values are
    counted by ``rows`` alone; rows without a time belong to the day null. Numbers and texts of the same look are different values."""
    kept = F.col(value) if dict(df.dtypes)[value] in ("int", "bigint", "string", "binary") else F.col(value).cast("string")
    return df.groupBy(*scope, F.to_date(time).alias("day")).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg(kept, F.lit(precision)).alias("sketch"))


def add_days(known: DataFrame, more: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Sketches of two tables of ``daily_sketches`` as one; days in both are united. Rows that came twice count once as values."""
    both = known.unionByName(more)
    return both.groupBy(*scope, "day").agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_over(sketches: DataFrame, scope: Sequence[str], first: date | None = None, last: date | None = None) -> DataFrame:
    """(scope, days, rows, distinct): the estimated number of different values from day ``first`` to day ``last``, both included.

    Only sketches are read. The day null belongs to no range and counts only where none is given."""
    inside: Column = F.lit(True)
    if first is not None:
        inside = inside & (F.col("day") >= F.lit(first))
    if last is not None:
        inside = inside & (F.col("day") <= F.lit(last))
    return sketches.where(inside).groupBy(*scope).agg(
        F.count_distinct("day").alias("days"), F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def error_bound(precision: int = PRECISION, errors: float = 3.0) -> float:
    """Share by which an estimate is off at most, at that many standard errors."""
    return errors * 1.04 / (1 << precision) ** 0.5
