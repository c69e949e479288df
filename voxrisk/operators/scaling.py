"""Grouped steps that stay parallel when one group holds much of the data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrisk.session import settle

# Spark keeps at most k rows per group and task before the shuffle up to this k
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SALTS = 16


ALL = "_all"


def keyed(df: DataFrame, scope: Sequence[str]) -> tuple[list[str], DataFrame]:
    """Grouping keys for a scope; the empty scope gets one constant key."""
    return (list(scope), df) if scope else ([ALL], df.withColumn(ALL, F.lit(0)))


def unkeyed(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Without the constant key that ``keyed`` added."""
    return df if scope else df.drop(ALL)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank",
    spread_on: Sequence[str] = (),
) -> DataFrame:
    """The first ``k`` rows per group in the given order, numbered from 1.

    Groups are cut twice: per (group, salt) and then per group, so a huge group is
    sorted by many tasks and the last one sees ``SALTS * k`` rows. ``spread_on``
    names columns that differ between rows of a group. Up to GROUP_LIMIT Spark also cuts
    before the shuffle; a larger k gives the same rows and moves more.
    """
    if not keys:
        head = df.orderBy(*order).limit(k)
        return head.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    work = df
    if spread_on:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(SALTS)))
        by_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
        work = salted.withColumn(rank, F.row_number().over(by_salt)).filter(F.col(rank) <= k).drop("_salt")
    by_key = Window.partitionBy(*keys).orderBy(*order)
    return work.withColumn(rank, F.row_number().over(by_key)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key. The ``= 1`` filter lets Spark drop all but one row per key
    and task before the shuffle, so many copies of one key cost nothing."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(window)).filter(F.col("_first") == 1).drop("_first")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def time_levels(ts: Column, order: Column) -> list[Column]:
    """A minute-sized step, the exact time with the coarse place of the row, the row."""
    us = micros(ts)
    return [F.shiftright(us, 26), F.struct(us.alias("us"), F.shiftright(order, 20).alias("chunk")), order]


def order_levels(order: Column) -> list[Column]:
    return [F.shiftright(order, 36), F.shiftright(order, 18), order]


def rank_boundaries(
    df: DataFrame,
    scope: Sequence[str],
    levels: Sequence[Column],
    cuts: Callable[[Column], Sequence[Column]],
) -> DataFrame:
    """Sort keys found at given ranks of each scope, without sorting the scope.

    ``levels`` refine the order step by step (later ones break ties of the earlier).
    ``cuts`` maps the row count of a scope to 0-based ranks. Each level counts rows
    per bucket (with map-side combine) and goes on inside the one bucket holding the
    rank. The buckets found are written between levels: they are few, and with their size
    known the next level joins them without moving the rows. Result: scope columns, ``cut`` (number) and ``l0..`` (the key at the rank);
    no row for a rank outside the scope.
    """
    keys, base = keyed(df, scope)
    names = [f"l{i}" for i in range(len(levels))]
    base = base.select(*keys, *[level.alias(name) for level, name in zip(levels, names)])

    counts = base.groupBy(*keys, "l0").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*keys)
    upto = F.sum("_c").over(whole.orderBy("l0"))
    ranked = counts.select(*keys, "l0", "_c", upto.alias("_hi"), F.sum("_c").over(whole).alias("_n"))
    wanted = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("cut"), rank.cast("bigint").alias("rank"))
            for i, rank in enumerate(cuts(F.col("_n")))
        ])
    )
    lo = F.col("_hi") - F.col("_c")
    found = (
        ranked.select(*keys, "l0", "_hi", "_c", wanted.alias("_w"))
        .filter((F.col("_w.rank") >= lo) & (F.col("_w.rank") < F.col("_hi")))
        .select(*keys, F.col("_w.cut").alias("cut"), "l0", (F.col("_w.rank") - lo).alias("_rest"))
    )
    for i in range(1, len(levels)):
        found = settle(found, "ranks")
        prefix, name = names[:i], names[i]
        group = [*keys, "cut", *prefix, "_rest"]
        counts = base.join(found, [*keys, *prefix]).groupBy(*group, name).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "cut").orderBy(name))
        lo = F.col("_hi") - F.col("_c")
        found = (
            counts.withColumn("_hi", upto)
            .filter((F.col("_rest") >= lo) & (F.col("_rest") < F.col("_hi")))
            .select(*keys, "cut", *names[: i + 1], (F.col("_rest") - lo).alias("_rest"))
        )
    return unkeyed(settle(found.select(*keys, "cut", *names), "ranks"), scope)


def head_per_scope(df: DataFrame, scope: Sequence[str], order: str, n: int, tie: str | None = None) -> DataFrame:
    """The first ``n`` rows of every scope, for any ``n``: rows up to the n-th place,
    which is looked up first, so nothing is sorted. ``tie`` names a column that orders rows of equal ``order``."""
    if not scope:
        return df.orderBy(order, *([tie] if tie else [])).limit(n)
    levels = [*order_levels(F.col(order)), *([F.col(tie)] if tie else [])]
    ends = rank_boundaries(df, scope, levels, lambda total: [F.least(F.lit(n), total) - 1])
    last = ends.select(*scope, F.struct(*[F.col(f"l{i}").alias(f"c{i}") for i in range(2, len(levels))]).alias("_last"))
    here = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([order, *([tie] if tie else [])], 2)])
    return df.join(last, list(scope)).filter(here <= F.col("_last")).drop("_last")


def gap_statistics(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Mean and population spread of the gaps between consecutive times per key.

    Equal times are counted once before the shuffle. Neighbours are found inside
    minute buckets in parallel; only one row per bucket is needed to bridge them.
    Columns: keys, ``n_times``, ``gap_mean``, ``gap_std`` (seconds).
    """
    keys = list(keys)
    times = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, micros(F.col(ts)).alias("_us"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_b", F.shiftright("_us", 26))
    )
    inner_prev = F.lag("_us").over(Window.partitionBy(*keys, "_b").orderBy("_us"))
    inner = times.select(*keys, ((F.col("_us") - inner_prev) / 1e6).alias("_gap"), "_c")
    ends = times.groupBy(*keys, "_b").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    bridge_prev = F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_b"))
    bridge = ends.select(
        *keys, ((F.col("_lo") - bridge_prev) / 1e6).alias("_gap"), F.lit(0).cast("bigint").alias("_c")
    )
    stats = inner.unionByName(bridge).groupBy(*keys).agg(
        F.sum("_c").alias("n_times"),
        F.count("_gap").alias("_k"),
        F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("_m"),
        F.coalesce(F.var_pop("_gap"), F.lit(0.0)).alias("_v"),
    )
    gaps = F.col("n_times") - 1
    mean = F.try_divide(F.col("_k") * F.col("_m"), gaps)
    zeros = gaps - F.col("_k")
    squares = F.col("_k") * (F.col("_v") + F.pow(F.col("_m") - F.col("gap_mean"), 2)) + zeros * F.pow("gap_mean", 2)
    return stats.withColumn("gap_mean", mean).select(
        *keys, "n_times", "gap_mean", F.sqrt(F.try_divide(squares, gaps)).alias("gap_std")
    )
