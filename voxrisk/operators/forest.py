"""Random forests on one column whose trees grow until every leaf is pure."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxrisk.session import settle

try:
    from _md5 import md5  # short messages take less than half the time
except ModuleNotFoundError:
    from hashlib import md5

TREES = 100
HASH_RANGE = 1 << 32
#: A row's weight in a tree is a Poisson number of mean 1: how often one of many draws with replacement takes it. The weight is how many of
#: these bounds its hash reaches; heavier weights have a chance below one in 10^8.
POISSON_BOUNDS = tuple(math.floor(HASH_RANGE * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(10))


def sampled_means(rows: DataFrame, trees: int) -> DataFrame:
    """(tree, x, mean) of the rows (key, x, y): the mean of y at every x of a tree's sample, each row counted as often as the sample has it, the
    same on every run. One digest of the key and a block number serves four trees. Rows are spread over all tasks first, as each needs many
    digests; an Arrow batch leaves as its sums by tree and value, which Spark adds up."""
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = spread.select(F.coalesce(F.concat(F.col("key").cast("string"), F.lit(":")), F.lit("")).alias("key"), "x", F.col("y").cast("double").alias("y"))
    kind = keyed.schema["x"].dataType
    blocks = [str(block).encode() for block in range((trees - 1) // 4 + 1)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            digests = b"".join([md5(key + block).digest() for key in map(str.encode, batch.column("key").to_pylist()) for block in blocks])
            u = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(batch.num_rows, -1)[:, :trees]
            w = sum((u >= np.uint32(bound)).astype(np.uint8) for bound in POISSON_BOUNDS)
            values = batch.column("x").dictionary_encode()
            place = (values.indices.to_numpy()[:, None].astype(np.int64) * trees + np.arange(trees)).ravel()
            y = np.where(w > 0, batch.column("y").to_numpy(zero_copy_only=False)[:, None], 0.0) * w
            count = np.bincount(place, w.ravel(), len(values.dictionary) * trees)
            total = np.bincount(place, y.ravel(), len(values.dictionary) * trees)
            held = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held % trees, pa.int32()), values.dictionary.take(pa.array(held // trees)), pa.array(count[held].astype(np.int64)), pa.array(total[held])],
                names=["tree", "x", "w", "y"])

    schema = T.StructType().add("tree", T.IntegerType()).add("x", kind).add("w", T.LongType()).add("y", T.DoubleType())
    return keyed.mapInArrow(read, schema).groupBy("tree", "x").agg((F.sum("y") / F.sum("w")).alias("mean"))


def forest_predictions(pairs: DataFrame, trees: int = TREES, key: str = "key") -> DataFrame:
    """(x, prediction) for every x of ``pairs`` (key, x, y, is_test), by trees that are fitted to the rows not in the test.

    A tree on one column that splits between neighbouring values until its leaves are pure has a leaf for each value in its sample, whatever
    the order of the splits, and the splits lie halfway between neighbours. So a value has the mean of the nearest value in the sample, of two
    equally near ones the smaller. That is what is computed: no tree is stored, and none has a limit on its depth.

    Means are summed per tree and value in tasks. Values are dealt into ranges; inside a range the nearest values are found by one ordered
    pass, and between ranges by their first and last values, so no task orders all values of a tree. A tree with an empty sample has no
    say; without any rows to fit predictions are null. Rows with a null x or y are expected to be gone."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    means = sampled_means(pairs.where(~F.col("is_test")).select(F.col(key).alias("key"), "x", "y"), trees)
    values = settle(pairs.select("x").distinct().repartitionByRange("x").withColumn("part", F.spark_partition_id()), "forest-values")

    at = F.when(F.col("mean").isNotNull(), F.struct("x", "mean"))
    grid = settle(values.select("x", "part", tree).join(means, ["tree", "x"], "left").withColumn("leaf", at), "forest-grid")
    ends = grid.groupBy("tree", "part").agg(F.min("leaf").alias("low"), F.max("leaf").alias("high"))
    by_tree = Window.partitionBy("tree").orderBy("part")
    before = F.last("high", ignorenulls=True).over(by_tree.rowsBetween(Window.unboundedPreceding, -1)).alias("before")
    after = F.first("low", ignorenulls=True).over(by_tree.rowsBetween(1, Window.unboundedFollowing)).alias("after")
    outer = ends.select("tree", "part", before, after)
    inside = Window.partitionBy("tree", "part").orderBy("x")
    left = F.last("leaf", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("left")
    right = F.first("leaf", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("right")
    near = grid.select("tree", "part", "x", left, right).join(outer, ["tree", "part"]).select(
        "tree", "x", F.coalesce("left", "before").alias("l"), F.coalesce("right", "after").alias("r"))
    takes_left = F.col("r").isNull() | (F.col("x") <= (F.col("l.x") + F.col("r.x")) / 2)
    leaf = F.when(F.col("l").isNotNull() & takes_left, F.col("l.mean")).otherwise(F.col("r.mean"))
    return near.groupBy("x").agg(F.avg(leaf).alias("prediction"))


def predict_forest(pairs: DataFrame, trees: int = TREES, key: str = "key") -> DataFrame:
    """The rows with ``prediction``."""
    return pairs.join(settle(forest_predictions(pairs, trees, key), "forest"), "x")
