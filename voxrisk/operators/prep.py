"""Preparation of generic tables: duplicates, dates, missing values, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrisk.operators.scaling import first_per_key


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def cast_dates(df: DataFrame, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")) -> DataFrame:
    """Text columns become timestamps when every value parses (one pass decides)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df

    def parsed(name: str) -> Column:
        return F.coalesce(*[F.try_to_timestamp(F.col(name), F.lit(fmt)) for fmt in formats])

    checks = [(F.count(name) == F.count(parsed(name))).alias(name) for name in texts]
    decided = df.agg(*checks, *[F.count(name).alias(f"{name}__n") for name in texts]).first()
    dates = {name: parsed(name) for name in texts if decided[name] and decided[f"{name}__n"] > 0}
    return df.withColumns(dates) if dates else df


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest among equals, as text.

    Values are counted as (column, value) rows, so no task holds all values of a column.
    """
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count("*").alias("n"))
    )
    best = first_per_key(counts, ["name"], [F.desc("n"), F.col("value")])
    return {row["name"]: row["value"] for row in best.collect()}  # one row per column


def fill_mean_mode(df: DataFrame) -> DataFrame:
    """Nulls of numeric columns become the mean, of others the mode.

    A whole-number column with nulls becomes DOUBLE, since its mean may have a fraction.
    """
    numeric = numeric_columns(df)
    others = [name for name in df.columns if name not in numeric]
    row = df.agg(
        *[F.avg(name).alias(f"mean_{name}") for name in numeric],
        *[F.count_if(F.col(name).isNull()).alias(f"gaps_{name}") for name in df.columns],
    ).first()
    gappy = [name for name in others if row[f"gaps_{name}"]]
    modes = column_modes(df, gappy)
    fills: dict[str, Column] = {}
    for name in numeric:
        if row[f"gaps_{name}"] and row[f"mean_{name}"] is not None:
            fills[name] = F.coalesce(F.col(name).cast("double"), F.lit(float(row[f"mean_{name}"])))
    for name, value in modes.items():
        fills[name] = F.coalesce(F.col(name), F.lit(value).cast(df.schema[name].dataType))
    return df.withColumns(fills) if fills else df


def useless_columns(df: DataFrame) -> list[str]:
    """Columns that are all null or hold one single value."""
    row = df.agg(
        *[F.count(name).alias(f"n_{name}") for name in df.columns],
        *[(F.min(name) == F.max(name)).alias(f"one_{name}") for name in df.columns],
    ).first()
    return [name for name in df.columns if row[f"n_{name}"] == 0 or row[f"one_{name}"]]


def drop_useless_columns(df: DataFrame) -> DataFrame:
    return df.drop(*useless_columns(df))


def clean_table(df: DataFrame) -> DataFrame:
    """Duplicates out, dates recognised, gaps filled, useless columns dropped."""
    return drop_useless_columns(fill_mean_mode(cast_dates(dedupe_rows(df))))


def _long(df: DataFrame, columns: Sequence[str], prefix: str, value: str) -> DataFrame:
    """One-row table with ``prefix + column`` fields to (column_name, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{prefix}{c}").alias(value)) for c in columns])
    return df.select(F.inline(pairs), "_rows")


def missing_report(df: DataFrame) -> DataFrame:
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in df.columns]
    )
    rows = _long(counts, df.columns, "m_", "missing_count")
    return rows.select(
        "column_name", "missing_count", F.round(F.try_divide("missing_count", "_rows"), 4).alias("missing_ratio")
    )


def outlier_report(df: DataFrame, limit: float = 3.0) -> DataFrame:
    """Values further than ``limit`` population deviations from the column mean."""
    columns = numeric_columns(df)
    stats = df.agg(
        *[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()  # two numbers per column

    def far(c: str) -> Column:
        mean, spread = stats[f"a_{c}"], stats[f"s_{c}"]
        if mean is None or not spread:
            return F.lit(False)
        return F.abs((F.col(c) - F.lit(float(mean))) / F.lit(float(spread))) > limit

    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(far(c)).alias(f"o_{c}") for c in columns])
    rows = _long(counts, columns, "o_", "outlier_count")
    return rows.select(
        "column_name", "outlier_count", F.round(F.try_divide("outlier_count", "_rows"), 4).alias("outlier_ratio")
    )


def content_hash_dedupe(df: DataFrame, content: str = "content", order: str = "ord") -> DataFrame:
    """First row per MD5 of the content."""
    hashed = df.withColumn("content_md5", F.md5(F.col(content).cast("binary")))
    return first_per_key(hashed, ["content_md5"], [F.col(order)])


def merge_dedupe_replies(first_page: DataFrame, later_pages: DataFrame) -> DataFrame:
    """Replies of both inputs, each text once per parent, first page first."""
    merged = first_page.withColumn("_page", F.lit(0)).unionByName(later_pages.withColumn("_page", F.lit(1)))
    return first_per_key(merged, ["parent_id", "content"], [F.col("_page"), F.col("ord")]).drop("_page")


def interpolate_linear(df: DataFrame, series: Sequence[str], x: str, y: str, n: int = 2, buckets: int = 4096) -> DataFrame:
    """Each series on ``n * points`` evenly spaced x values between its ends.

    Neighbouring points are paired inside x buckets in parallel, and one row per
    bucket bridges the gaps. A pair then emits the grid points it brackets, so no
    range join is needed. Equal x values are averaged.
    """
    keys = list(series)
    raw = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    known = raw.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    points = known.groupBy(*keys, "_x").agg(F.avg("_y").alias("_y"), F.count("*").alias("_c"))
    ends = points.groupBy(*keys).agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), (F.sum("_c") * n).alias("_n")
    ).filter(F.col("_hi") > F.col("_lo"))
    place = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)
    placed = points.join(ends, keys).withColumn("_b", place)
    here = F.struct(F.col("_x").alias("x"), F.col("_y").alias("y"))
    near = Window.partitionBy(*keys, "_b").orderBy("_x")
    inner = placed.withColumn("_p", F.lag(here).over(near)).filter(F.col("_p").isNotNull()).select(
        *keys, "_p", here.alias("_q"), "_lo", "_hi", "_n"
    )
    span = placed.groupBy(*keys, "_b", "_lo", "_hi", "_n").agg(F.min(here).alias("_q"), F.max(here).alias("_last"))
    bridge = span.withColumn("_p", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b"))).filter(
        F.col("_p").isNotNull()
    ).select(*keys, "_p", "_q", "_lo", "_hi", "_n")
    pairs = inner.unionByName(bridge)
    step = (F.col("_hi") - F.col("_lo")) / (F.col("_n") - 1)
    # grid point i sits at lo + i * step; the pair owns those in (p.x, q.x]
    low = F.floor((F.col("_p.x") - F.col("_lo")) / F.col("_step") + 1e-9) + 1
    low = F.when(F.col("_p.x") == F.col("_lo"), F.lit(0).cast("bigint")).otherwise(low)
    high = F.floor((F.col("_q.x") - F.col("_lo")) / F.col("_step") + 1e-9)
    grid = pairs.withColumn("_step", step).withColumns({"_i0": low, "_i1": high}).filter(F.col("_i0") <= F.col("_i1"))
    at = F.col("_lo") + F.col("i") * F.col("_step")
    slope = (F.col("_q.y") - F.col("_p.y")) / (F.col("_q.x") - F.col("_p.x"))
    return grid.withColumn("i", F.explode(F.sequence("_i0", "_i1"))).select(
        *keys, "i", at.alias("x"), (F.col("_p.y") + slope * (at - F.col("_p.x"))).alias("y")
    )
