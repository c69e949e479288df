"""Links between things: connected components and minimum spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrisk.session import settle


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link (a, b), the component being its smallest node.

    Each round hangs a node's larger neighbours below its smallest one, then its smaller ones, until nothing moves:
    aggregations by node and joins, which the adaptive planner splits where one node has very many links."""
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        smallest = edges.unionByName(turned).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = settle(turned.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
        smallest = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(down.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now


def minimum_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, members) of edges (a, b, height): the edges of a minimum spanning forest, and (node, component) of every node.

    In each round every tree takes its cheapest outgoing edge, equal heights being ordered by the edge's nodes so that no circle
    can close; trees at least halve in number, so a forest over n nodes takes at most log2(n) rounds."""
    lighter = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("height").alias("height"))
    # (a, b) are trees, (p, q) the nodes that the edge was given for
    left = settle(lighter.select("a", "b", "height", F.col("a").alias("p"), F.col("b").alias("q")), "forest")
    forest, members = left.select("p", "q", "height").limit(0), None
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    members = settle(nodes.select("node", F.col("node").alias("component")), "forest")
    while not left.isEmpty():
        edge = F.struct("height", "p", "q", "a", "b")
        out = left.select(F.col("a").alias("tree"), edge.alias("e")).union(left.select("b", edge))
        taken = settle(out.groupBy("tree").agg(F.min("e").alias("e")).select("e.*").distinct(), "forest")
        forest = forest.unionByName(taken.select("p", "q", "height"))
        merged = settle(connected(taken), "forest")
        named = lambda column: merged.select(F.col("node").alias(column), F.col("component").alias(f"{column}_new"))
        moved = left.join(named("a"), "a").join(named("b"), "b").where("a_new <> b_new")
        a, b = F.least("a_new", "b_new").alias("a"), F.greatest("a_new", "b_new").alias("b")
        # of several edges between two trees only the cheapest can be taken
        left = settle(moved.select(a, b, "height", "p", "q").groupBy("a", "b").agg(F.min(F.struct("height", "p", "q")).alias("e")).select(
            "a", "b", "e.height", "e.p", "e.q"), "forest")
        again = members.join(merged.withColumnRenamed("component", "into"), members.component == merged.node, "left").select(
            members.node, F.coalesce("into", "component").alias("component"))
        members = settle(again, "forest")
    return forest.select(F.col("p").alias("a"), F.col("q").alias("b"), "height"), members
