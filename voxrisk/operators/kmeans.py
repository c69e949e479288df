"""k-means: centres found in a few passes over the rows, each giving mergeable sums per cluster."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.operators.moments import numbers

SEED, SEEDING_ROUNDS, OVERSAMPLING = 42, 5, 2.0
Centres = list[list[float]]


AT_ONCE = 4096  # rows of a batch whose distances are held together


def nearest(x: Column, centres: Centres) -> Column:
    """(d2, cluster) of the nearest centre, the first of equally near ones. Squares are summed in column order; null without a point."""
    at = np.array(centres, float)

    def told(*columns: pa.Array) -> pa.Array:
        points = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
        best, near = np.empty(len(points)), np.empty(len(points), np.int32)
        for low in range(0, len(points), AT_ONCE):
            some = points[low : low + AT_ONCE]
            d2 = np.zeros((len(at), len(some)))
            for i in range(at.shape[1]):
                off = some[:, i] - at[:, i : i + 1]
                d2 += off * off
            own = d2.argmin(axis=0)
            near[low : low + AT_ONCE], best[low : low + AT_ONCE] = own, d2[own, np.arange(len(some))]
        return pa.StructArray.from_arrays([pa.array(best), pa.array(near)], names=["d2", "cluster"])

    best = F.arrow_udf(told, "struct<d2: double, cluster: int>")
    return F.when(x.isNotNull(), best(*[x[i] for i in range(at.shape[1])]))


def _luck(key: Column, turn: int) -> Column:
    """A number from 0 to 1 that depends on the row's key alone: the same on every run and after the loss of a task."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(SEED), F.lit(turn)), 11) / float(1 << 53)


@dataclass(frozen=True)
class Step:
    """One pass with given centres: the cost of the rows, and the centres that follow."""

    cost: float
    sizes: list[int]
    centres: Centres


def lloyd_step(rows: DataFrame, centres: Centres) -> Step:
    """Assign every row (key, x) to its nearest centre and move the centres to the means of their rows.

    A centre without rows goes to the row that is furthest from its centre, the one with the smallest key of equals; of several
    such centres the others stay. Neither raises the cost. Sums are made in tasks, and one row per cluster reaches the driver."""
    d = len(centres[0])
    placed = rows.select("key", "x", nearest(F.col("x"), centres).alias("best")).select("key", "x", "best.*")
    sums = placed.groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("d2").alias("cost"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)]).collect()
    found = {r.cluster: r for r in sums}
    after = [[found[c][f"m{i}"] for i in range(d)] if c in found else list(old) for c, old in enumerate(centres)]
    empty = [c for c in range(len(centres)) if c not in found]
    if empty and found:
        far = placed.agg(F.min(F.struct((-F.col("d2")).alias("d2"), "key", "x")).alias("far")).first().far  # seldom needed, so a pass of its own
        if far.d2 < 0:
            after[empty[0]] = list(far.x)
    return Step(float(sum(r.cost for r in sums)), [found[c].n if c in found else 0 for c in range(len(centres))], after)


def _reduced(points: np.ndarray, weights: np.ndarray, k: int) -> Centres:
    """k centres of a few weighted points: the heaviest first, then always the one that adds most cost; then plain k-means on them."""
    chosen = [int(weights.argmax())]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(points)) and (far * weights).max() > 0:
        chosen.append(int((far * weights).argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centres = points[chosen].copy()
    for _ in range(100):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        now = np.array([np.average(points[own == c], axis=0, weights=weights[own == c]) if weights[own == c].sum() else centres[c] for c in range(len(centres))])
        if (now == centres).all():
            break
        centres = now
    return centres.tolist()


def seed_centres(rows: DataFrame, k: int) -> Centres:
    """Up to ``k`` first centres of rows (key, x): fewer only if there are fewer different places.

    It begins with the row of the best luck. In each of SEEDING_ROUNDS passes every row becomes a candidate with a chance in
    proportion to its squared distance from the candidates so far, about OVERSAMPLING * k rows a pass in expectation. The candidates, weighted by
    the rows nearest to them, are then reduced to k on the driver."""
    first = rows.orderBy(_luck(F.col("key"), 0), "key", "x").limit(1).collect()
    if not first:
        return []
    candidates = [list(first[0].x)]
    for turn in range(1, SEEDING_ROUNDS + 1):
        apart = nearest(F.col("x"), candidates)["d2"]
        cost = rows.agg(F.sum(apart)).first()[0]
        if not cost:
            break
        chance = OVERSAMPLING * k * apart / F.lit(float(cost))
        drawn = rows.where(_luck(F.col("key"), turn) < chance).select("x").distinct().orderBy("x").collect()
        candidates += [list(r.x) for r in drawn]
    counted = rows.groupBy(nearest(F.col("x"), candidates)["cluster"].alias("c")).count().collect()
    weights = np.zeros(len(candidates))
    for r in counted:
        weights[r.c] = r["count"]
    return _reduced(np.array(candidates), weights, k)


@dataclass(frozen=True)
class KMeans:
    columns: tuple[str, ...]
    centres: Centres
    costs: list[float]

    def assign(self, df: DataFrame) -> DataFrame:
        """The rows with ``cluster`` (from 0) and ``distance``; both null where a number is missing or not finite."""
        x = numbers(self.columns)
        if not self.centres:
            return df.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})
        best = nearest(F.col("_x"), self.centres)
        return df.withColumn("_x", x).withColumn("_best", F.when(F.col("_x").isNotNull(), best)).withColumns(
            {"cluster": F.col("_best.cluster"), "distance": F.sqrt("_best.d2")}).drop("_x", "_best")


def kmeans(df: DataFrame, key: str, columns: Sequence[str], k: int, steps: int = 50, gain: float = 1e-9) -> KMeans:
    """Centres of ``k`` clusters by Euclidean distance over numeric columns, and the cost before every step.

    Passes go on until the centres stand still, a step lowers the cost by less than ``gain`` of it, or ``steps`` have been made. Fewer
    different places than k give as many centres as there are places; no usable rows give none. Rows with a missing or non-finite number take no part;
    null and repeated keys only share their luck in seeding."""
    rows = df.select(F.col(key).alias("key"), numbers(columns).alias("x")).where("x IS NOT NULL")
    centres = seed_centres(rows, k)
    costs: list[float] = []
    while centres and len(costs) < steps:
        step = lloyd_step(rows, centres)
        costs.append(step.cost)
        if step.centres == centres or (len(costs) > 1 and costs[-2] - costs[-1] <= gain * costs[-2]):
            break
        centres = step.centres
    return KMeans(tuple(columns), centres, costs)
