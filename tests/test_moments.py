"""Models on shared moments, and k-means, against plain numpy versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxrisk.operators import kmeans as km
from voxrisk.operators import moments as mo


def frame(spark, data, parts=3):
    d = data.shape[1]
    rows = [(i, *map(float, row)) for i, row in enumerate(data)]
    return [f"c{j}" for j in range(d)], spark.createDataFrame(rows, "id long, " + ", ".join(f"c{j} double" for j in range(d))).repartition(parts)


def sample(n=400, d=5, seed=1, offset=0.0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) + offset


# --- moments ---------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 7])
def test_moments(spark, parts):
    data = sample(offset=1e6)
    names, df = frame(spark, data, parts)
    bad = spark.createDataFrame([(900, None, *[1.0] * 4), (901, math.nan, *[1.0] * 4), (902, math.inf, *[1.0] * 4)], df.schema)
    got = mo.moments(df.unionByName(bad), names)
    assert got.n == 400
    assert np.allclose(got.mean, data.mean(axis=0), rtol=1e-12)
    assert np.allclose(got.covariance, np.cov(data.T, bias=True), rtol=1e-9, atol=1e-9)
    assert np.allclose(got.correlation, np.corrcoef(data.T), atol=1e-9)


def test_moments_edges(spark):
    names, df = frame(spark, np.zeros((0, 3)))
    got = mo.moments(df, names)
    assert got.n == 0 and not got.cross.any()
    names, df = frame(spark, np.array([[1.0, 2.0]]))
    assert mo.moments(df, names).n == 1
    with pytest.raises(ValueError):
        mo.moments(df, [])


def test_principal_components(spark):
    data = sample()
    names, df = frame(spark, data)
    found = mo.principal_components(df, names, 3)
    values, axes = np.linalg.eigh(np.cov(data.T, bias=True))
    assert np.allclose(found.variances, values[::-1][:3]) and found.explained.sum() < 1
    assert np.allclose(np.abs(found.axes.T @ axes[:, ::-1][:, :3]), np.eye(3), atol=1e-8)
    out = found.project(df).agg(*[F.var_pop(f"pc{k}") for k in (1, 2, 3)], F.corr("pc1", "pc2"), F.avg("pc1")).first()
    assert np.allclose(out[:3], found.variances) and abs(out[3]) < 1e-9 and abs(out[4]) < 1e-9
    scaled = mo.principal_components(df, names, scaled=True)
    assert scaled.variances.sum() == pytest.approx(5)
    again = mo.principal_components(df.repartition(2), names, 3)
    assert np.allclose(again.axes, found.axes, atol=1e-9)  # signs don't depend on the order of rows


# --- regression --------------------------------------------------------------------------
def test_linear_and_ridge(spark):
    data = sample(d=4, seed=2)
    data[:, 3] = 2 + data[:, 0] - 3 * data[:, 1] + 0.1 * data[:, 3]
    names, df = frame(spark, data)
    plain = mo.ridge_regression(df, names[:3], "c3")
    x = np.column_stack([np.ones(len(data)), data[:, :3]])
    want = np.linalg.lstsq(x, data[:, 3], rcond=None)[0]
    assert np.allclose([plain.intercept, *plain.coefficients], want)
    left = data[:, 3] - x @ want
    assert plain.r2 == pytest.approx(1 - left @ left / ((data[:, 3] - data[:, 3].mean()) ** 2).sum())
    off = (plain.predict(df).select(F.max(F.abs(F.col("prediction") - F.lit(0.0)))).first()[0])
    assert off == pytest.approx(np.abs(x @ want).max())
    z = (data[:, :3] - data[:, :3].mean(axis=0)) / data[:, :3].std(axis=0)
    y = data[:, 3] - data[:, 3].mean()
    w = np.linalg.solve(z.T @ z / len(z) + 0.5 * np.eye(3), z.T @ y / len(z)) / data[:, :3].std(axis=0)
    ridge = mo.ridge_regression(df, names[:3], "c3", penalty=0.5)
    assert np.allclose(ridge.coefficients, w)
    assert mo.LinearModel(("a", "b"), 1.0, np.array([2.0, -3.0]), 1, 1.0).expression() == "y=1.0000+2.0000*a-3.0000*b"


def test_dependent_and_constant_columns(spark):
    data = sample(d=3, seed=3)
    data = np.column_stack([data[:, 0], np.full(len(data), 7.0), data[:, 1], 2 * data[:, 0] - data[:, 1], data[:, 2]])
    names, df = frame(spark, data)
    found = mo.ridge_regression(df, names[:4], "c4")
    x = np.column_stack([np.ones(len(data)), data[:, [0, 2]]])
    want = np.linalg.lstsq(x, data[:, 4], rcond=None)[0]
    assert found.coefficients[1] == 0 and (found.coefficients == 0).sum() == 2
    predicted = found.intercept + data[:, :4] @ found.coefficients
    assert np.allclose(predicted, x @ want)
    names, empty = frame(spark, np.zeros((0, 2)))
    nothing = mo.ridge_regression(empty, names[:1], "c1")
    assert nothing.n == 0 and nothing.coefficients.tolist() == [0.0] and math.isnan(nothing.r2)


def nipals(x, y, k):
    x, y = (x - x.mean(axis=0)) / x.std(axis=0), y - y.mean()
    w_all, p_all, q_all = [], [], []
    for _ in range(k):
        w = x.T @ y
        w /= np.linalg.norm(w)
        t = x @ w
        p, q = x.T @ t / (t @ t), y @ t / (t @ t)
        x, y = x - np.outer(t, p), y - q * t
        w_all.append(w), p_all.append(p), q_all.append(q)
    w, p = np.array(w_all).T, np.array(p_all).T
    return w @ np.linalg.solve(p.T @ w, np.array(q_all))


@pytest.mark.parametrize("k", [1, 2, 4])
def test_partial_least_squares(spark, k):
    data = sample(d=5, seed=4)
    names, df = frame(spark, data)
    found = mo.partial_least_squares(df, names[:4], "c4", k)
    want = nipals(data[:, :4], data[:, 4], k) / data[:, :4].std(axis=0)
    assert np.allclose(found.coefficients, want, atol=1e-8)
    if k == 4:  # all directions: least squares
        assert np.allclose(found.coefficients, mo.ridge_regression(df, names[:4], "c4").coefficients, atol=1e-6)
    flat = frame(spark, np.column_stack([data[:, 0], np.zeros(len(data))]))
    assert mo.partial_least_squares(flat[1], ["c0"], "c1", 2).coefficients.tolist() == [0.0]


def test_factor_analysis(spark):
    rng = np.random.default_rng(5)
    common = rng.standard_normal((3000, 2))
    loadings = np.array([[0.9, 0], [0.8, 0.1], [0.7, 0], [0.1, 0.8], [0, 0.9], [0, 0.6]])
    data = common @ loadings.T + rng.standard_normal((3000, 6)) * np.sqrt(1 - (loadings ** 2).sum(axis=1))
    names, df = frame(spark, data)
    found = mo.factor_analysis(df, names, 2)
    assert np.abs(np.abs(found.loadings) - np.abs(loadings)).max() < 0.08
    assert np.abs(found.communalities - (loadings ** 2).sum(axis=1)).max() < 0.08
    # a plain version of the same iteration
    r = np.corrcoef(data.T)
    h = 1 - 1 / np.linalg.inv(r).diagonal()
    for _ in range(500):
        reduced = r.copy()
        np.fill_diagonal(reduced, h)
        values, axes = np.linalg.eigh(reduced)
        h = ((axes[:, -2:] * np.sqrt(values[-2:])) ** 2).sum(axis=1)
    assert np.allclose(found.communalities, h, atol=1e-7)
    raw = mo.factor_analysis(df, names, 2, rotate=False)
    assert np.allclose((raw.loadings ** 2).sum(axis=1), (found.loadings ** 2).sum(axis=1))  # turning keeps them
    constant = mo.factor_analysis(df.withColumn("c9", F.lit(1.0)), [*names, "c9"], 2)
    assert constant.communalities[-1] == 0


def test_varimax_finds_the_best_angle():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((8, 2))
    kind = lambda x: (x ** 4).sum() - (((x ** 2).sum(axis=0)) ** 2 / len(x)).sum()
    best = max(kind(a @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])) for t in np.linspace(0, math.pi, 20_001))
    assert kind(mo.varimax(a)) == pytest.approx(best, rel=1e-6)


# --- k-means -------------------------------------------------------------------------------
def test_kmeans(spark):
    rng = np.random.default_rng(7)
    middle = np.array([[0, 0], [10, 0], [0, 10], [10, 10]])
    data = np.vstack([m + rng.standard_normal((60, 2)) for m in middle])
    names, df = frame(spark, data)
    found = km.kmeans(df, "id", names, 4)
    assert all(b <= a * (1 + 1e-12) for a, b in zip(found.costs, found.costs[1:]))
    assert sorted(tuple(np.round(c, -1)) for c in found.centres) == sorted(map(tuple, middle.astype(float)))
    told = {r.id: (r.cluster, r.distance) for r in found.assign(df).collect()}
    off = ((data[:, None] - np.array(found.centres)[None]) ** 2).sum(axis=2)
    assert all(told[i] == (off[i].argmin(), pytest.approx(math.sqrt(off[i].min()))) for i in told)
    assert km.kmeans(df.repartition(5), "id", names, 4).centres == [pytest.approx(c) for c in found.centres]  # luck hangs on keys, not on places


def test_lloyd_step_and_empty_cluster(spark):
    data = np.array([[0.0], [1.0], [2.0], [9.0]])
    _, df = frame(spark, data)
    rows = df.select(F.col("id").alias("key"), F.array("c0").alias("x"))
    step = km.lloyd_step(rows, [[1.0], [100.0], [200.0]])
    assert step.cost == 1 + 0 + 1 + 64 and step.sizes == [4, 0, 0]
    assert step.centres == [[3.0], [9.0], [200.0]]  # the furthest row takes the first empty centre
    assert km.lloyd_step(rows, step.centres).cost <= step.cost


def test_nearest_centre_of_whole_batches(spark):
    rng = np.random.default_rng(11)
    data, centres = rng.integers(0, 6, (km.AT_ONCE + 300, 2)).astype(float), rng.integers(0, 6, (9, 2)).astype(float)
    _, df = frame(spark, data)
    rows = df.select("id", km.nearest(F.when(F.col("id") != 5, F.array("c0", "c1")), centres.tolist()).alias("best")).coalesce(1)
    assert "ArrowEvalPython" in rows._jdf.queryExecution().executedPlan().toString()
    told = {r.id: r.best for r in rows.collect()}
    d2 = ((data[:, None] - centres[None]) ** 2).sum(axis=2)
    assert told.pop(5) is None and all(tuple(b) == (d2[i].min(), d2[i].argmin()) for i, b in told.items())  # the first of equally near ones


def test_kmeans_edges(spark):
    names, df = frame(spark, np.zeros((0, 2)))
    found = km.kmeans(df, "id", names, 3)
    assert found.centres == [] and found.assign(df).count() == 0
    names, df = frame(spark, np.array([[1.0, 1.0]] * 5 + [[2.0, 2.0]]))
    found = km.kmeans(df, "id", names, 4)
    assert sorted(found.centres) == [[1.0, 1.0], [2.0, 2.0]] and found.costs[-1] == 0
    bad = spark.createDataFrame([(1, None, 1.0), (2, math.nan, 1.0)], df.schema)
    assert [(r.cluster, r.distance) for r in found.assign(bad).collect()] == [(None, None)] * 2
