"""Shards of nearly equal bytes by sampled splitters. DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrisk.session import settle

RANGES_PER_SHARD = 64  # first cut; a hundredth of a shard is then the unit of balance
RANGE_BYTES = 64 << 20  # a range is sorted by one task, so it may not grow with the data
RANGE_ROWS = 200_000
SAMPLES_PER_RANGE = 32
ID_BITS = 24
FIRST = -(1 << 63)  # smallest long, for what comes before all keys


def ranges_below(bounds: Column, key: Column, most: int) -> Column:
    """How many of the sorted ``bounds`` (at most ``most``) are <= key, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at),
    )


def _splitters(drawn: DataFrame, into: Column, keys: list[str]) -> DataFrame:
    """Weighted quantiles of drawn keys: the first key of each of ``into`` parts of a range but the first part."""
    ordered = Window.partitionBy(*keys).orderBy("s")
    whole = Window.partitionBy(*keys)
    at = drawn.withColumn("_end", F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("w").over(whole))
    part = F.least(F.floor((F.col("_end") - F.col("w") / 2) * into / F.col("_all")), into - 1)
    return at.withColumn("_part", part).groupBy(*keys, "_part").agg(F.min("s").alias("s")).where("_part > 0")


def _as_bounds(found: DataFrame) -> list[int]:
    """Sorted splitters; one per range, so their number is bounded by the ranges asked for.

    A text that is cut once is not cut at all: its rows stay together behind the splitter."""
    keys = {r.s for r in found.select("s").collect()}
    texts = Counter(s >> ID_BITS for s in keys)
    return sorted({s if texts[s >> ID_BITS] > 1 else s >> ID_BITS << ID_BITS for s in keys})


def _literal(bounds: list[int]) -> Column:
    return F.array(*[F.lit(s).cast("bigint") for s in bounds]).cast("array<bigint>")


def shard_by_size(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, ranges_per_shard: int = RANGES_PER_SHARD,
    range_bytes: int = RANGE_BYTES, range_rows: int = RANGE_ROWS, samples_per_range: int = SAMPLES_PER_RANGE,
) -> DataFrame:
    """Put every row into one of ``n_shards`` shards of nearly equal size, equal texts side by side.

    Size is the UTF-8 length of the text (null: none) plus 1. Rows are ordered by a hash of the text,
    then of the id. A size-weighted sample of these keys gives the quantile splitters of
    ``n_shards * ranges_per_shard`` ranges or of as many as ``range_bytes`` and ``range_rows`` ask
    for. A range that turns out overfull is divided again by a sample of its own, also in the middle
    of equal texts. Exact running sizes inside the ranges then cut the order into shards. A group
    of equal texts stays in one shard unless it is over a 200th of a shard or spans ranges.

    Returns id, size, text_crc32, range, shard and slot (gapless from 0 in each shard). Rows with a
    null id or text count like others; repeated rows are all kept and get slots of their own. An
    empty table gives no rows. Other columns are not read. Sampling jobs run when this is called."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_text, by_id = F.xxhash64(text), F.xxhash64(F.col(id_col), F.lit(7))
    keys = settle(docs.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        by_text.alias("g"), by_id.alias("h"),
        # what is sampled and compared: the leading bits of the text's hash, then those of the id's
        F.shiftleft(F.shiftright(by_text, ID_BITS), ID_BITS).bitwiseOR(F.shiftrightunsigned(by_id, 64 - ID_BITS)).alias("s"),
    ), "shard-keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_ranges = max(n_shards * ranges_per_shard, math.ceil(total / range_bytes), math.ceil(rows / range_rows))
    per_range = max(1.0, total / n_ranges)
    luck = F.pmod(F.xxhash64("h", "g", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)

    def draw(of: DataFrame, weight: Column, unit: Column | float) -> DataFrame:
        """Rows by chance in proportion to weight, one per ``unit`` of it; a row above that always."""
        return of.withColumn("w", weight.cast("double")).where(luck < F.col("w") / unit).withColumn("w", F.greatest(F.col("w"), F.lit(unit) if isinstance(unit, float) else unit))

    drawn = draw(keys, F.col("size"), per_range / samples_per_range).withColumn("r", F.lit(0))
    bounds = _as_bounds(_splitters(drawn, F.lit(n_ranges), ["r"]))

    for _ in range(8):
        ranged = keys.withColumn("r", ranges_below(_literal(bounds), F.col("s"), len(bounds)))
        totals = settle(ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("s") < F.max("s")).alias("divisible")), "shard-ranges")
        most_bytes, most_rows = 2 * max(per_range, 1), 2 * max(range_rows, rows / n_ranges)
        over = totals.where(((F.col("bytes") > most_bytes) | (F.col("n") > most_rows)) & F.col("divisible"))
        over = over.withColumn("into", F.greatest(F.ceil(F.col("bytes") / per_range), F.ceil(F.col("n") / range_rows), F.lit(2)))
        mixed = F.col("size") / F.col("bytes") + 1 / F.col("n")  # divides bytes and rows alike
        again = ranged.join(over, "r")
        more = _splitters(draw(again, mixed, 2 / (F.col("into") * samples_per_range)), F.col("into"), ["r", "into"])
        new = {x.s for x in more.select("s").collect()} - set(bounds)
        if not new:
            break
        bounds = sorted(set(bounds) | new)

    order = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = totals.select(
        "r", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_rows")
    )
    inside = Window.partitionBy("r").orderBy("g", "h", id_col, "size")
    same = Window.partitionBy("r", "g")
    placed = (
        ranged.join(settle(starts, "shard-starts"), "r")
        .withColumn("_row", F.col("_rows") + F.row_number().over(inside) - 1)
        .withColumn("_at", F.col("_bytes") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("_first", F.min("_at").over(same)).withColumn("_group", F.sum("size").over(same))
    )
    whole = F.col("_group") <= max(1, total // n_shards // 200)
    middle = F.when(whole, 2 * F.col("_first") + F.col("_group")).otherwise(2 * F.col("_at") + F.col("size"))
    shard = F.least(F.floor(middle * n_shards / max(1, 2 * total)), F.lit(n_shards - 1)).cast("int")
    placed = settle(placed.select(id_col, "size", "text_crc32", F.col("r").alias("range"), shard.alias("shard"), "_row"), "shard-rows")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_start"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", "range", "shard", (F.col("_row") - F.col("_start")).cast("bigint").alias("slot")
    )
