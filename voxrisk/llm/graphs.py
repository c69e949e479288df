"""Helpers on links between ids: connected components and cheap narrowing to a set of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrisk.session import settle

BITMAP_WORDS = 1 << 17  # 8 million bits in at most 131,072 rows: small enough to broadcast whatever the data


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with its columns renamed to c0, c1, ...: what is added beside them clashes with no name of the caller's."""
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])


def narrow(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose key may be among ``ids``, without moving the rows.

    The ids set bits in a bitmap of fixed size, which is broadcast. A row whose bit is not set is surely not
    among them; some others pass as well, so an exact join has to follow where that matters."""
    held = numbered(rows)
    return maybe_among(held, held.columns[rows.columns.index(key)], ids, id_col).where("_maybe").select(*held.columns).toDF(*rows.columns)


def maybe_among(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``_maybe``: false if the key is surely not among ``ids``, by a bitmap of fixed size. Adds _word, _bit and _bits too."""
    spot = lambda c: F.pmod(F.xxhash64(F.lit(5), F.col(c)), F.lit(BITMAP_WORDS * 64))
    word, bit = (lambda c: F.floor(spot(c) / 64).cast("int")), (lambda c: (spot(c) % 64).cast("int"))
    bits = ids.select(word(id_col).alias("_word"), bit(id_col).alias("_bit"))
    bitmap = settle(bits.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")), "bitmap")
    marked = rows.withColumn("_word", word(key)).withColumn("_bit", bit(key)).join(F.broadcast(bitmap), "_word", "left")
    return marked.withColumn("_maybe", F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1 = 1"), F.lit(False)))


def without(rows: DataFrame, key: str, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows whose key is not among ``gone``; only those that may be among them are moved for an exact anti-join."""
    held = numbered(rows)
    own = held.columns[rows.columns.index(key)]
    maybe = maybe_among(held, own, gone, id_col)
    sure = maybe.where(~F.col("_maybe")).select(*held.columns)
    rest = maybe.where("_maybe").select(*held.columns).join(gone.select(F.col(id_col).alias(own)), own, "left_anti").select(*held.columns)
    return sure.unionByName(rest).toDF(*rows.columns)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, component) per node that has a link, the
    component being its smallest node. Alternates large-star and small-star steps until nothing changes; each
    is an aggregation by node and a join that the adaptive planner splits where one node has many links."""
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        wide = settle(wide.where("a <> b").distinct(), "links")
        lower = wide.groupBy("a").agg(F.min("b").alias("m"))
        tight = wide.join(lower, "a")
        edges = settle(
            tight.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
