"""The forest from sums against the one that Spark ML grows row by row."""

import math
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor

from voxrisk.operators import bagged, models

SHAPES = {
    "few values": (700, lambda i, rng: float(i % 9)),
    "zeros and negatives": (700, lambda i, rng: float(max(-20, i % 60 - 30)) if i % 3 else 0.0),
    "more values than bins": (900, lambda i, rng: rng.uniform(-1, 1)),
    "bins from a sample": (12000, lambda i, rng: rng.gauss(0, 10) if i % 4 else 0.0),
    "one value": (40, lambda i, rng: 7.0),
    "empty partitions": (3, lambda i, rng: float(i)),
    "one row": (1, lambda i, rng: 1.0),
}


def told(model):
    """Splits and predictions of all trees, in their order."""
    return [(cut, said and float(said)) for cut, said in re.findall(r"<= (\S+?)\)|Predict: (\S+)", model.toDebugString)]


def near(found):
    return [(cut, said and pytest.approx(said, rel=1e-9)) for cut, said in found]


def frame(spark, shape, parts=5):
    n, x = SHAPES[shape]
    rng = random.Random(n)
    rows = [(at := x(i, rng), rng.gauss(at, 2)) for i in range(n)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "x double, y double")


@pytest.mark.parametrize("shape", SHAPES)
def test_trees_are_those_of_spark_ml(spark, shape):
    rows = frame(spark, shape)
    for trees, depth in ((6, 5), (2, 0), (2, 9)):
        forest = RandomForestRegressor(featuresCol="_x1", labelCol="y", numTrees=trees, maxDepth=depth, seed=42)
        got, want = bagged.fit(forest, rows), forest.fit(VectorAssembler(inputCols=["x"], outputCol="_x1").transform(rows))
        assert told(got) == near(told(want))
        assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray())
        assert got.getNumTrees == trees and got.predict(Vectors.dense([0.5])) == pytest.approx(want.predict(Vectors.dense([0.5])))


def test_rows_of_one_value_of_y(spark):
    rows = spark.createDataFrame([(float(i % 7), 2.0) for i in range(60)], "x double, y double")
    model = bagged.fit(RandomForestRegressor(featuresCol="_x1", labelCol="y", numTrees=3, seed=1), rows)
    assert told(model) == [("", 2.0)] * 3 and model.featureImportances.toArray()[0] == 0


def test_forest_keeps_no_rows(spark, monkeypatch):
    """Spark ML's own fit holds 100 draws for each row and reads them once a level; its prediction walks through every tree."""
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda *_: pytest.fail("rows are kept"))
    rows = [(f"k{i}", float(i % 40), float(i % 40 + i % 3), i % 5 == 0) for i in range(400)]
    pairs = spark.createDataFrame(rows, "key string, x double, y double, is_test boolean").repartition(3)
    model = models.fit_forest(pairs, trees=8)
    found = models.predict(model, pairs)
    assert "UDF" not in found._jdf.queryExecution().toString()
    ends = [end for end, _ in bagged.steps(model.stages[-1])]
    at = spark.createDataFrame([(v,) for end in ends for v in (end, end - 0.5, end + 0.5)] + [(-math.inf,)], "x double")
    want = sorted((r.x, r.prediction) for r in model.transform(at).collect())
    assert sorted((r.x, r.prediction) for r in models.predict(model, at).collect()) == want
    assert found.columns == ["key", "x", "y", "is_test", "prediction"] and found.count() == 400


def test_a_task_returns_sums(spark):
    """One row for a tree and bin, whatever the number of rows."""
    rows = bagged.checked(frame(spark, "bins from a sample", parts=1))
    sums = bagged.bin_sums(rows, [-5.0, 0.0, 5.0], 4, 3).collect()
    assert sorted((r.tree, r.bin) for r in sums) == [(t, b) for t in range(4) for b in range(4)]
    law = spark._jvm.org.apache.commons.math3.distribution.PoissonDistribution(1.0)
    law.reseedRandomGenerator(3 + 0 + 1)
    drawn = list(law.sample(4 * 12000))
    assert [sum(r.w for r in sums if r.tree == t) for t in range(4)] == [sum(drawn[t::4]) for t in range(4)]


@pytest.mark.parametrize("x,y", [(math.nan, 1.0), (1.0, math.nan), (math.inf, 1.0), (1.0, -math.inf)])
def test_odd_numbers_are_refused(spark, x, y):
    """As Spark ML does."""
    rows = spark.createDataFrame([("a", 1.0, 2.0, False), ("b", x, y, False)], "key string, x double, y double, is_test boolean")
    with pytest.raises(PySparkException):
        models.fit_forest(rows, trees=2)


def test_no_prediction_without_x(spark):
    rows = spark.createDataFrame([(f"k{i}", float(i), float(i), False) for i in range(20)], "key string, x double, y double, is_test boolean")
    model = models.fit_forest(rows, trees=2)
    for x in (None, math.nan):
        with pytest.raises(PySparkException):
            models.predict(model, spark.createDataFrame([(x,)], "x double")).collect()
    with pytest.raises(PySparkException):
        models.fit_forest(rows.limit(0), trees=2)
