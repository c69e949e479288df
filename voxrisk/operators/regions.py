"""Region (IP location) concentration and spread (v2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrisk.functions import text as tx
from voxrisk.operators.scaling import keyed, rank_boundaries, time_levels, top_k, unkeyed

MIN_COVERAGE = 0.3
MIN_TIMED_ROWS = 10


def region(column: str = "ip_location") -> Column:
    """Stripped region name, null when missing or blank."""
    return F.nullif(tx.strip(F.col(column)), F.lit(""))


def coverage(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*scope).agg(F.count("*").alias("total"), F.count(region()).alias("with_ip"))
    return out.withColumn("coverage", F.try_divide("with_ip", "total"))


def region_counts(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Comments per region. ``first_ord`` orders equal counts by first appearance."""
    located = df.select(*scope, region().alias("region"), "ord").filter(F.col("region").isNotNull())
    return located.groupBy(*scope, "region").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def _rank_order() -> list[Column]:
    return [F.desc("n"), F.col("first_ord"), F.col("region")]


def top_regions(counts: DataFrame, scope: Sequence[str] = (), k: int = 5) -> DataFrame:
    return top_k(counts, scope, _rank_order(), k)


def concentration(counts: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient, top-3 share and score from the region counts, which are few."""
    keys, work = keyed(counts, scope)
    whole = Window.partitionBy(*keys)
    work = work.select(
        *keys, "region", "n",
        F.row_number().over(whole.orderBy("n")).alias("_i"),
        F.row_number().over(whole.orderBy(*_rank_order())).alias("_r"),
    )
    grouped = work.groupBy(*keys).agg(
        F.count("*").alias("regions"),
        F.sum("n").alias("with_ip"),
        F.sum(F.col("n") * F.col("_i")).alias("_weighted"),
        F.sum(F.when(F.col("_r") <= 3, F.col("n"))).alias("_top3"),
        F.max_by("region", -F.col("_r")).alias("top_region"),
        F.max("n").alias("top_count"),
    )
    k, total = F.col("regions"), F.col("with_ip")
    # sum of v * (2i - k - 1) = 2 * weighted - (k + 1) * total
    gini = F.when(k == 1, F.lit(1.0)).otherwise(
        F.try_divide(2 * F.col("_weighted") - (k + 1) * total, k * total)
    )
    out = grouped.withColumns({"gini": gini, "top3_ratio": F.try_divide("_top3", "with_ip")})
    out = out.withColumn("concentration_score", (F.col("gini") * 100).cast("int"))
    return unkeyed(out.drop("_weighted", "_top3"), scope)


def wave_spread(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Distinct regions in the first, second and last third of the located, timed rows.

    The thirds are cut at the row numbers n/3 and 2n/3. The two cutting rows are
    found by counting (``rank_boundaries``); every row then compares itself with
    them, so no scope is ever sorted as a whole.
    """
    keys, work = keyed(df.select(*scope, region().alias("region"), "publish_time", "ord"), scope)
    timed = work.filter(F.col("region").isNotNull() & F.col("publish_time").isNotNull())
    us = F.unix_micros("publish_time")
    cuts = rank_boundaries(
        timed, keys, time_levels(F.col("publish_time"), F.col("ord")),
        lambda n: [F.floor(n / 3), F.floor(2 * n / 3)],
    )
    at = F.struct(F.col("l1.us").alias("us"), F.col("l2").alias("ord"))
    bounds = cuts.groupBy(*keys).agg(
        F.max(F.when(F.col("cut") == 0, at)).alias("_b1"), F.max(F.when(F.col("cut") == 1, at)).alias("_b2")
    )
    here = F.struct(us.alias("us"), F.col("ord").alias("ord"))
    third = F.when(here < F.col("_b1"), 0).when(here < F.col("_b2"), 1).otherwise(2)
    seen = (
        timed.join(bounds, keys)
        .groupBy(*keys, third.alias("third"), "region")
        .agg(F.count("*").alias("_c"))
    )
    out = seen.groupBy(*keys).agg(
        F.sum("_c").alias("timed_rows"),
        *[F.count_if(F.col("third") == i).alias(f"regions_{i + 1}") for i in range(3)],
    )
    first, last = F.col("regions_1"), F.col("regions_3")
    enough = F.col("timed_rows") >= MIN_TIMED_ROWS
    wave = enough & (first <= 2) & (last >= 2 * first)
    few = F.greatest("regions_1", "regions_2", "regions_3") <= 3
    out = out.withColumns({
        "wave_detected": wave,
        "pattern": F.when(~enough, "unknown").when(wave, "wave_spread").when(few, "concentrated").otherwise("normal"),
    })
    return unkeyed(out, scope)


def suspicion(df: DataFrame, scope: Sequence[str] = (), min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Coverage, concentration, spread, score, level and findings per scope.

    Scopes with too few located rows keep their coverage and a finding only.
    """
    keys, work = keyed(df, scope)
    cover = coverage(work, keys)
    focus = concentration(region_counts(work, keys), keys).drop("with_ip")
    spread = wave_spread(work, keys)
    joined = cover.join(focus, keys, "left").join(spread, keys, "left")
    return unkeyed(score_regions(joined, min_coverage), scope)


def score_regions(joined: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    enough = F.col("coverage") >= min_coverage
    gated = joined.withColumn("has_sufficient_ip", enough)
    for name in ("regions", "top_region", "top_count", "gini", "top3_ratio", "concentration_score", "wave_detected", "pattern"):
        gated = gated.withColumn(name, F.when(F.col("has_sufficient_ip"), F.col(name)))
    gated = gated.withColumns({
        "wave_detected": F.coalesce("wave_detected", F.lit(False)),
        "pattern": F.coalesce("pattern", F.lit("unknown")),
    })
    focus, top3, regions = F.col("concentration_score"), F.col("top3_ratio"), F.col("regions")
    wave, gini = F.col("wave_detected"), F.col("gini")
    score = (
        F.when(focus >= 80, 40).when(focus >= 50, 20).otherwise(0)
        + F.when(top3 >= 0.85, 25).when(top3 >= 0.70, 10).otherwise(0)
        + F.when(wave, 25).otherwise(0)
        + F.when(regions == 1, 20).when(regions <= 3, 10).otherwise(0)
    )
    lines = F.array_compact(F.array(
        F.when(focus >= 80, F.concat(
            F.lit("地域高度集中："), F.col("top_region"), F.lit(" 占 "),
            tx.percent(F.try_divide("top_count", "with_ip")), F.lit("，基尼系数 "), tx.fixed(gini, 2)))
        .when(focus >= 50, F.concat(F.lit("地域较集中（基尼系数 "), tx.fixed(gini, 2), F.lit("）"))),
        F.when(top3 >= 0.85, F.concat(F.lit("前3省份占比 "), tx.percent(top3), F.lit("，疑似区域性集中操作"))),
        F.when(wave, F.lit("检测到波浪式扩散模式：评论从少数省份向外扩散，疑似有组织传播")),
        F.when(regions == 1, F.concat(F.lit("所有评论仅来自 1 个省份（"), F.col("top_region"), F.lit("）")))
        .when(regions <= 3, F.concat(F.lit("评论仅来自 "), regions.cast("string"), F.lit(" 个省份，地域多样性极低"))),
    ))
    skipped = F.concat(
        F.lit("IP 属地覆盖率仅 "), tx.percent(F.col("coverage")), F.lit("（"), F.col("with_ip").cast("string"),
        F.lit("/"), F.col("total").cast("string"), F.lit(f" 条），低于分析阈值 {min_coverage:.0%}，跳过地域分析"),
    )
    scored = gated.withColumns({"suspicion_score": F.least(score, F.lit(100)), "_lines": lines})
    points, ok = F.col("suspicion_score"), F.col("has_sufficient_ip")
    return scored.withColumns({
        "suspicion_level": F.when(~ok, "low").when(points >= 70, "high").when(points >= 40, "medium").otherwise("low"),
        "findings": F.when(~ok, F.array(skipped))
        .when(F.size("_lines") == 0, F.array(F.lit("地域分布正常，未发现明显集中传播特征")))
        .otherwise(F.col("_lines")),
    }).drop("_lines")


def top_and_others(df: DataFrame, scope: Sequence[str] = (), k: int = 10, per_user: bool = False, others: str = "Others") -> DataFrame:
    """The ``k`` largest regions and the sum of the rest.

    ``per_user`` counts each user name once, by its last comment.
    """
    rows = df
    if per_user:
        last = F.max_by(F.struct("ip_location"), "ord").alias("_last")
        rows = df.groupBy(*scope, "user_name").agg(last, F.max("ord").alias("ord")).select(
            *scope, F.col("_last.ip_location").alias("ip_location"), "ord"
        )
    counts = region_counts(rows, scope)
    keys, work = keyed(counts, scope)
    ranked = work.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*_rank_order())))
    name = F.when(F.col("_r") <= k, F.col("region")).otherwise(F.lit(others))
    return ranked.groupBy(*scope, name.alias("region")).agg(F.sum("n").alias("n"))
