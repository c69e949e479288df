"""Spark ML's random forest on one column, fitted from sums.

Spark ML keeps every row with its draws for all trees, and reads them all again for each level. On one column with a bounded number of bins
every split of every tree follows from the draws and the sums of y by tree and bin, which one pass adds up. The draws, bins, splits and
leaves are those of ``RandomForestRegressor``, up to the rounding of sums; that makes draws depend on how rows lie in their partitions."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as JavaColumn

#: Rows on which the bins are settled, as in Spark ML.
SAMPLED = 10_000
#: ``monotonically_increasing_id`` counts the rows of a partition in so many low bits.
ROW_BITS = 33
EPSILON = sys.float_info.epsilon


def checked(rows: DataFrame) -> DataFrame:
    """(x, y) as numbers; reading either fails where it is null, NaN or infinite."""
    def finite(name: str, said: str) -> Column:
        value = F.col(name).cast("double")
        odd = value.isNull() | F.isnan(value) | (F.abs(value) == math.inf)
        return F.when(odd, F.raise_error(F.lit(f"{said} MUST NOT be Null, NaN or Infinity"))).otherwise(value).alias(name)

    return rows.select(finite("x", "Values"), finite("y", "Labels"))


def poisson_draws(row: Column, trees: int, seed: int) -> Column:
    """How often each tree draws a row, as Spark ML does it: Poisson numbers of mean 1 from one generator for a partition, which is seeded by the
    partition's number at its first row. ``row`` is the ``monotonically_increasing_id``; every task has its own copy of the
    generator. Works in generated code only: with ``spark.sql.codegen.factoryMode`` NO_CODEGEN it fails."""
    jvm = SparkSession.active()._jvm
    catalyst, types, columns = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types, jvm.org.apache.spark.sql.classic.ExpressionUtils
    of = lambda column: columns.expression(column._jc)
    seq = lambda *some: jvm.PythonUtils.toSeq(list(some))
    law = catalyst.Literal.fromObject(jvm.org.apache.commons.math3.distribution.PoissonDistribution(1.0))
    start = F.shiftright(row, ROW_BITS) + F.lit(seed + 1).cast("bigint")
    seeded = catalyst.objects.InitializeJavaBean(law, jvm.PythonUtils.toScalaMap({"reseedRandomGenerator": of(start)}))
    source = getattr(catalyst, "If")(of(F.shiftleft(row, 64 - ROW_BITS) == 0), seeded, law)
    ints = types.ObjectType(jvm.java.lang.Class.forName("[I"))
    drawn = catalyst.objects.Invoke(source, "sample", ints, seq(of(F.lit(trees))), seq(), True, False, False)
    kind = types.DataTypes.createArrayType(types.DataTypes.IntegerType, False)
    array = catalyst.objects.StaticInvoke(
        catalyst.UnsafeArrayData().getClass(), kind, "fromPrimitiveArray", seq(drawn), seq(), True, False, True, jvm.scala.Option.empty())
    return JavaColumn(columns.column(array))


def split_points(rows: DataFrame, n: int, max_bins: int, seed: int) -> list[float]:
    """Upper ends of all bins but the last: between the values of a sample, at about equal numbers of rows. It is Spark ML's sample."""
    bins = min(max_bins, n)
    fraction = min(1.0, max(bins * bins, SAMPLED) / n)
    spark = rows.sparkSession
    values = rows.select("x")
    seed = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    some = spark._jsparkSession.createDataFrame(values._jdf.javaRDD().sample(False, fraction, seed), values._jdf.schema())
    counts = {r.x: float(r["count"]) for r in DataFrame(some, spark).where(F.col("x") != 0).groupBy("x").count().collect()}
    if not counts:
        return []
    seen, wanted = sum(counts.values()), fraction * n
    if wanted - seen > EPSILON * seen * 100:  # what is missing are zeros, or rows that the sample fell short of
        counts[0.0] = wanted - seen
    at = sorted(counts)
    middles = [(a + b) / 2 for a, b in zip(at, at[1:])]
    if len(middles) < bins:
        return middles
    found, stride = [], wanted / bins
    total, target = counts[at[0]], stride
    for value, middle in zip(at[1:], middles):
        before, total = total, total + counts[value]
        if abs(before - target) < abs(total - target):
            found.append(middle)
            target += stride
    return found


def bin_sums(rows: DataFrame, points: list[float], trees: int, seed: int) -> DataFrame:
    """(tree, bin, w, y, yy): draws, and sums of y and of its squares over the draws. A task returns its sums only."""
    drawn = rows.select("x", "y", F.monotonically_increasing_id().alias("row")).select("x", "y", poisson_draws(F.col("row"), trees, seed).alias("draws"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(points) + 1, trees, 3))
        for batch in batches:
            place = np.searchsorted(points, batch.column("x").to_numpy())
            y = batch.column("y").to_numpy()
            draws = batch.column("draws").flatten().to_numpy().reshape(-1, trees)
            for at in np.unique(place):
                inside = place == at
                w, z = draws[inside].astype(np.float64), y[inside]
                sums[at] += (np.stack([np.ones(len(z)), z, z * z]) @ w).T
        at, tree = (i.astype(np.int32) for i in np.nonzero(sums[:, :, 0]))
        w, y, yy = sums[at, tree].T
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (tree, at, w.astype(np.int64), y, yy)], names=["tree", "bin", "w", "y", "yy"])

    return drawn.mapInArrow(read, "tree int, bin int, w long, y double, yy double").groupBy("tree", "bin").agg(*(F.sum(c).alias(c) for c in ("w", "y", "yy")))


class Node(NamedTuple):
    """``sums`` are those of bin_sums over the node's rows; a leaf has no children."""

    sums: tuple[float, float, float]
    impurity: float
    gain: float = 0.0
    split: float | None = None
    children: tuple[Node, Node] | None = None

    @property
    def prediction(self) -> float:
        return self.sums[1] / self.sums[0] if self.sums[0] else 0.0


def variance(sums) -> float:
    w, y, yy = map(float, sums)
    return (yy - y * y / w) / w if w else 0.0


def grown(cells: np.ndarray, points: list[float], depth: int) -> Node:
    """The tree on (bin, sums). As in Spark ML, of equal gains the first split counts, and sister leaves that say the same become one."""
    def grow(low: int, high: int, level: int, known: Node | None) -> Node:
        upto = np.cumsum(cells[low:high], axis=0)
        total = upto[-1]
        if known is None:
            whole = upto[0] + (total - upto[0]) if points else total
            known = Node(tuple(map(float, whole)), variance(whole))
        best, cut, parts = -math.inf, 0, None
        for k in range(high - low - 1):
            left, right = upto[k], total - upto[k]
            if left[0] < 1 or right[0] < 1:
                continue
            weight = float(left[0] + right[0])
            gain = known.impurity - float(left[0]) / weight * variance(left) - float(right[0]) / weight * variance(right)
            if gain >= 0 and gain > best:
                best, cut, parts = gain, low + k, (left, right)
        if parts is None:
            return known._replace(impurity=-1.0)
        if best <= 0 or level == depth:
            return known
        children = []
        for sums, (start, end) in zip(parts, ((low, cut + 1), (cut + 1, high))):
            child = Node(tuple(map(float, sums)), variance(sums))
            children.append(child if level + 1 == depth or abs(child.impurity) < EPSILON else grow(start, end, level + 1, child))
        if not any(c.children for c in children) and children[0].prediction == children[1].prediction:
            return known
        return known._replace(gain=best, split=points[cut], children=tuple(children))

    return grow(0, len(cells), 0, None)


def _model(spark: SparkSession, forest: RandomForestRegressor, roots: list[Node]) -> RandomForestRegressionModel:
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    double, tree, models = jvm.double, jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression
    leaf, inner, split, stats = tree.LeafNode, tree.InternalNode, tree.ContinuousSplit, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def build(node: Node):
        sums = array(double, 3)
        for i, v in enumerate(node.sums):
            sums[i] = v
        held = stats(sums, int(node.sums[0]))
        if node.children is None:
            return leaf(node.prediction, node.impurity, held)
        return inner(node.prediction, node.impurity, node.gain, *map(build, node.children), split(0, node.split), held)

    one = models.DecisionTreeRegressionModel
    trees = array(one, len(roots))
    for i, root in enumerate(roots):
        trees[i] = one(build(root), 1)
    model = forest._copyValues(RandomForestRegressionModel(models.RandomForestRegressionModel(forest.uid, trees, 1)))
    model._transfer_params_to_java()  # a prediction divides by the parameter numTrees
    return model


def fit(forest: RandomForestRegressor, rows: DataFrame) -> RandomForestRegressionModel | None:
    """``forest`` fitted to (x, y); None without any rows. Rows are read three times: counted and checked, sampled for the bins, and drawn."""
    rows, trees, seed = checked(rows), forest.getNumTrees(), forest.getSeed()
    n = rows.agg(F.count(F.col("x") + F.col("y"))).first()[0]
    if not n:
        return None
    points = split_points(rows, n, forest.getMaxBins(), seed)
    cells = np.zeros((trees, len(points) + 1, 3))
    for r in bin_sums(rows, points, trees, seed).collect():
        cells[r.tree, r.bin] = r.w, r.y, r.yy
    return _model(rows.sparkSession, forest, [grown(c, points, forest.getMaxDepth()) for c in cells])


def steps(model: RandomForestRegressionModel) -> list[tuple[float, float]]:
    """(highest x, prediction) of a forest on one column, which says the same up to the next split of any tree; the last reaches to infinity."""
    ends = [*sorted({float(t) for t in re.findall(r"<= (\S+?)\)", model.toDebugString)}), math.inf]
    return [(end, model.predict(Vectors.dense([end]))) for end in ends]


def predict(model: RandomForestRegressionModel, rows: DataFrame) -> DataFrame:
    """Adds ``prediction``, found by comparing x with the splits instead of walking through every tree."""
    x = F.col("x").cast("double")
    told = F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit("Encountered null or NaN in x")))
    *some, (_, last) = steps(model)
    for end, value in some:
        told = told.when(x <= end, F.lit(value))
    return rows.withColumn("prediction", told.otherwise(F.lit(last)))
