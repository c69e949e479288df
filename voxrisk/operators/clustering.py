"""Clusters of rows by their numbers: density clusters and single linkage at any height."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrisk.operators.geometry import cell, cell_side, cell_steps, closest_pairs, point, squared_distance, stepped
from voxrisk.operators.graphs import connected, minimum_forest
from voxrisk.session import settle

CORE, BORDER, NOISE = "core", "border", "noise"
#: Single linkage: places that the finest cells may hold, and how much wider each level's reach is.
FINE_PLACES, WIDER = 32, 4.0


def places(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(x, n, first): every different place, how many rows lie there and the smallest key of them."""
    rows = df.select(point(columns).alias("x"), F.col(key).alias("key")).where("x IS NOT NULL")
    return rows.groupBy("x").agg(F.count("*").alias("n"), F.min("key").alias("first"))


def _told(df: DataFrame, columns: Sequence[str], labels: DataFrame) -> DataFrame:
    """The rows with the label of their place."""
    here = df.withColumn("_x", point(columns))
    return here.join(labels.withColumnRenamed("x", "_x"), "_x", "left").drop("_x")


def density_clusters(df: DataFrame, key: str, columns: Sequence[str], eps: float, min_points: int) -> DataFrame:
    """The rows with ``cluster`` and ``role``: density clusters by Euclidean distance over one to four numeric columns.

    A row with at least ``min_points`` rows within ``eps``, itself included, is ``core``. Core rows within ``eps`` of one another share a
    cluster, named by the smallest key of its core rows. Another row within ``eps`` of a core row is ``border`` and joins
    the cluster of the nearest one, of equally near ones the cluster with the smallest name. The rest is ``noise`` without a cluster.

    Rows at the same place count as one place with a weight. Places go into cells so small that all within one are
    neighbours: a cell with ``min_points`` rows or more makes all of them core, and no pair inside a cell is ever listed. Places of the
    other, thin cells are fewer than ``min_points`` a cell; lists of them, bounded so, meet the places of neighbouring cells. Cells are linked where
    ``closest_pairs`` finds core places close enough, and the clusters are the components of cells.

    Rows with a null or non-finite number are returned with null cluster and role. Repeated keys are rows of their own; null
    keys name no cluster unless there is no other. An empty table gives no rows. Jobs run when this is called."""
    d = len(columns)
    side, limit = cell_side(eps, d), eps * eps
    everywhere = cell_steps(eps, side, d)
    spots = settle(places(df, key, columns).withColumn("cell", cell(F.col("x"), side)), "places")
    cells = settle(spots.groupBy("cell").agg(F.sum("n").alias("rows")), "cells")
    dense = F.col("rows") >= min_points
    placed = spots.join(cells, "cell")
    thin = settle(placed.where(~dense).select("x", "n", "first", "cell"), "thin")

    def meetings(of: DataFrame, others: DataFrame) -> DataFrame:
        """(s, d2, and the columns of ``others``) for the places of thin cells and others within reach."""
        around = of.select(F.col("x").alias("s"), F.explode(stepped(F.col("cell"), everywhere)).alias("cell"))
        lists = around.join(cells.select("cell"), "cell", "left_semi").groupBy("cell").agg(F.collect_list("s").alias("near"))
        within = F.filter(F.transform("near", lambda s: F.struct(s.alias("s"), squared_distance(s, F.col("x")).alias("d2"))), lambda m: m["d2"] <= limit)
        return others.join(lists, "cell").select(*others.columns, F.inline(within))

    counted = meetings(thin, spots.select("x", "n", "cell")).groupBy("s").agg(F.sum("n").alias("rows"))
    crowded = settle(counted.where(dense).select(F.col("s").alias("x")), "crowded")
    lonely = settle(thin.join(crowded, "x", "left_anti"), "lonely")
    core = settle(placed.where(dense).select("x", "first", "cell").unionByName(thin.join(crowded, "x", "left_semi").select("x", "first", "cell")), "core")

    core_cells = settle(core.select("cell").distinct(), "core-cells")
    neighbours = core_cells.select(F.col("cell").alias("a"), F.explode(stepped(F.col("cell"), cell_steps(eps, side, d, half=True))).alias("b"))
    neighbours = settle(neighbours.join(core_cells.withColumnRenamed("cell", "b"), "b", "left_semi"), "cell-pairs")
    linked = closest_pairs(core.select(F.col("cell").alias("group"), "x"), neighbours, d, side, limit=eps, enough=eps)
    together = connected(linked.select("a", "b"))
    whole = core.join(together.withColumnRenamed("node", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    names = whole.groupBy("component").agg(F.min("first").alias("cluster"))
    core = settle(whole.join(names, "component").select("x", "cell", "cluster"), "core-named")

    beside = meetings(lonely, core.select("cluster", "x", "cell")).groupBy("s").agg(F.min(F.struct("d2", "cluster")).alias("best"))
    border = beside.select(F.col("s").alias("x"), F.col("best.cluster").alias("cluster"))
    nothing = lonely.join(border, "x", "left_anti").select("x", F.lit(None).cast(core.schema["cluster"].dataType).alias("cluster"))
    labels = (
        core.select("x", "cluster", F.lit(CORE).alias("role")).unionByName(border.withColumn("role", F.lit(BORDER)))
        .unionByName(nothing.withColumn("role", F.lit(NOISE)))
    )
    return _told(df, columns, settle(labels, "labels"))


@dataclass(frozen=True)
class Linkage:
    """Single linkage up to a height: places, and the merges (a, b, height) of a minimum spanning forest over their ``first`` keys."""

    spots: DataFrame
    merges: DataFrame
    height: float
    columns: tuple[str, ...]

    def cut(self, df: DataFrame, height: float) -> DataFrame:
        """The rows with ``cluster``: rows joined by steps of at most ``height`` share one, named by its smallest key. Rows with a null or
        non-finite number have none."""
        if height > self.height:
            raise ValueError(f"linked up to {self.height} only")
        groups = connected(self.merges.where(F.col("height") <= height).select("a", "b"))
        named = self.spots.select("x", "first").join(groups, F.col("first") == F.col("node"), "left")
        return _told(df, self.columns, named.select("x", F.coalesce("component", "first").alias("cluster")))


def single_linkage(df: DataFrame, key: str, columns: Sequence[str], height: float) -> Linkage:
    """Hierarchy of clusters: all merges by Euclidean distance over one to four numeric columns, up to ``height``.

    Keys must be unique and not null (ValueError otherwise). Rows at one place are merged at once. The reach grows by WIDER from level to level. On the finest, cells
    hold at most FINE_PLACES places, and pairs within neighbouring cells are listed; where places lie closer than that, there are more and finer
    levels. On each further level the trees so far are the nodes. Trees within one cell are further apart than the last reach, so
    a cell meets a bounded number of them, and ``closest_pairs`` measures those of neighbouring cells without listing their rows. Each
    level's forest is exact for its heights, so together they are a minimum spanning forest of all pairs within ``height``.

    Rows with a null or non-finite number take no part. An empty table has no merges. Jobs run when this is called."""
    d = len(columns)
    bad, n, distinct = df.agg(F.count_if(F.col(key).isNull()), F.count(key), F.count_distinct(key)).first()
    if bad or n != distinct:
        raise ValueError(f"{key} has to be unique and not null")
    spots = settle(places(df, key, columns), "places")

    def most(reach: float) -> int:
        counts = spots.groupBy(cell(F.col("x"), cell_side(reach, d)).alias("cell")).agg(F.count("*").alias("n"))
        return counts.agg(F.max("n")).first()[0] or 0

    levels = [height]
    while most(levels[0]) > FINE_PLACES and len(levels) < 40:
        levels.insert(0, levels[0] / WIDER)

    reach = levels[0]
    side = cell_side(reach, d)
    here = spots.select("x", "first", cell(F.col("x"), side).alias("cell"))
    there = here.select(F.col("x").alias("y"), F.col("first").alias("b"), F.explode(stepped(F.col("cell"), cell_steps(reach, side, d))).alias("cell"))
    listed = here.join(there, "cell").where("first < b").select(F.col("first").alias("a"), "b", F.sqrt(squared_distance(F.col("x"), F.col("y"))).alias("height"))
    merges, trees = minimum_forest(settle(listed.where(F.col("height") <= reach), "pairs"))
    merges = settle(merges, "merges")
    tree_of = settle(spots.join(trees, F.col("first") == F.col("node"), "left").select("x", "first", F.coalesce("component", "first").alias("tree")), "trees")
    for reach in levels[1:]:
        side = cell_side(reach, d)
        group = F.struct("cell", "tree")
        members = tree_of.withColumn("cell", cell(F.col("x"), side)).select(group.alias("group"), "x")
        groups = settle(members.select("group").distinct(), "groups")
        around = groups.select(F.col("group").alias("a"), F.explode(stepped(F.col("group.cell"), cell_steps(reach, side, d))).alias("cell"))
        others = groups.select(F.col("group").alias("b"), F.col("group.cell").alias("cell"))
        pairs = around.join(others, "cell").where("a.tree < b.tree").select("a", "b")
        near = closest_pairs(members, settle(pairs, "group-pairs"), d, side, limit=reach)
        edges = near.groupBy(F.col("a.tree").alias("a"), F.col("b.tree").alias("b")).agg(F.sqrt(F.min("d2")).alias("height"))
        more, joined = minimum_forest(settle(edges, "tree-pairs"))
        merges = settle(merges.unionByName(more), "merges")
        tree_of = settle(tree_of.join(joined, F.col("tree") == F.col("node"), "left").select("x", "first", F.coalesce("component", "tree").alias("tree")), "trees")
    return Linkage(spots, merges, height, tuple(columns))
