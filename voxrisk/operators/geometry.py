"""Points in a few dimensions: grid cells, their neighbours, and closest pairs between groups of points.

A point is an array column ``x`` of doubles. Distances are squared sums of coordinate differences in column order."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.session import settle

#: Cells are made this much smaller, so that rounding can't put points of one cell further apart than meant.
MARGIN = 1e-6
MOST_DIMENSIONS = 4


def point(columns: Sequence[str]) -> Column:
    """Coordinates as an array, null where one of them is missing or not finite. Zero has one sign only."""
    x = F.array(*[F.col(name).cast("double") + F.lit(0.0) for name in columns])
    usable = F.forall(x, lambda c: F.coalesce(F.abs(c) < math.inf, F.lit(False)))
    return F.when(usable, x)


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, one: total + one)


def cell_side(reach: float, dimensions: int) -> float:
    """Side of cells any two points of which are within ``reach`` of one another."""
    return reach / math.sqrt(dimensions) * (1 - MARGIN)


def cell(x: Column, side: float) -> Column:
    return F.transform(x, lambda c: F.floor(c / side))


def cell_steps(reach: float, side: float, dimensions: int, half: bool = False) -> list[tuple[int, ...]]:
    """Steps to all cells that can hold a point within ``reach`` of one in a cell, itself included; ``half`` leaves out
    the cell itself and one of each two opposite steps."""
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"cells serve up to {MOST_DIMENSIONS} dimensions; reduce the columns first")
    far = math.floor(reach / side * (1 + MARGIN)) + 1
    steps = [
        s for s in product(range(-far, far + 1), repeat=dimensions)
        if sum(max(0, abs(c) - 1) ** 2 for c in s) * side * side <= reach * reach * (1 + MARGIN)
    ]
    return [s for s in steps if s > (0,) * dimensions] if half else steps


def stepped(at: Column, steps: Sequence[tuple[int, ...]]) -> Column:
    """Array of the cells that the steps lead to."""
    table = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in s]) for s in steps])
    return F.transform(table, lambda s: F.zip_with(at, s, lambda a, b: a + b))


def _boxes(points: DataFrame, dimensions: int, side: float) -> DataFrame:
    """Bounding boxes of the points of each (group, sub-cell), with one point out of each."""
    low = F.array(*[F.min(F.col("x")[i]) for i in range(dimensions)]).alias("low")
    high = F.array(*[F.max(F.col("x")[i]) for i in range(dimensions)]).alias("high")
    return points.groupBy("group", cell(F.col("x"), side).alias("sub")).agg(low, high, F.min("x").alias("one"))


def closest_pairs(points: DataFrame, pairs: DataFrame, dimensions: int, side: float, limit: float, enough: float = 0.0) -> DataFrame:
    """(a, b, d2): squared distance of the closest points of groups ``a`` and ``b``, for those of the ``pairs`` (a, b) of groups in
    ``points`` (group, x) that have points within ``limit``. Where points within ``enough`` are found, d2 may be that of any such two.

    No list of point pairs is made. Groups are covered by boxes around the points of sub-cells, ``side`` wide at first. Two
    boxes that can't hold a closer pair than one already known are left; the others are split into halves of half the side, until
    boxes hold one place only. So a round keeps few boxes around the closest places, however many points the groups have."""
    reach, done = limit * limit, enough * enough
    named = lambda boxes, e: boxes.select(F.col("group").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("sub", "low", "high", "one")])
    parent = lambda sub: F.transform(sub, lambda c: F.floor(c / 2))
    apart = F.aggregate(
        F.zip_with(F.zip_with("low_b", "high_a", lambda l, h: l - h), F.zip_with("low_a", "high_b", lambda l, h: l - h), lambda s, t: F.greatest(s, t, F.lit(0.0))),
        F.lit(0.0), lambda total, gap: total + gap * gap)
    single = (F.col("low_a") == F.col("high_a")) & (F.col("low_b") == F.col("high_b"))
    known, boxes = None, settle(_boxes(points, dimensions, side), "boxes")
    open_pairs = pairs.join(named(boxes, "a"), "a").join(named(boxes, "b"), "b")
    while True:
        measured = settle(open_pairs.select(
            "a", "b", "sub_a", "sub_b", apart.alias("least"), squared_distance(F.col("one_a"), F.col("one_b")).alias("d2"), single.alias("single")), "box-pairs")
        found = measured.groupBy("a", "b").agg(F.min("d2").alias("d2"))
        known = settle((found if known is None else known.unionByName(found)).groupBy("a", "b").agg(F.min("d2").alias("d2")), "closest")
        left = measured.drop("d2").join(known, ["a", "b"]).where(
            ~F.col("single") & (F.col("least") < F.col("d2")) & (F.col("least") <= reach) & (F.col("d2") > done)).select("a", "b", "sub_a", "sub_b")
        left = settle(left, "box-pairs")
        if left.isEmpty():
            return known.where(F.col("d2") <= reach)
        wanted = left.select(F.col("a").alias("group"), F.col("sub_a").alias("up")).union(left.select("b", "sub_b")).distinct()
        inside = points.withColumn("up", cell(F.col("x"), side)).join(wanted, ["group", "up"], "left_semi").select("group", "x")
        side /= 2
        boxes = settle(_boxes(inside, dimensions, side), "boxes")
        child = lambda e: named(boxes, e).withColumn("up", parent(F.col(f"sub_{e}")))
        open_pairs = left.select("a", "b", F.col("sub_a").alias("up_a"), F.col("sub_b").alias("up_b")).join(
            child("a").withColumnRenamed("up", "up_a"), ["a", "up_a"]).join(child("b").withColumnRenamed("up", "up_b"), ["b", "up_b"])
