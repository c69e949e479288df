"""Full-depth forests against trees that are really grown, split by split."""

import hashlib
import random

import pytest

from voxrisk.operators import forest, models


def drawn(key, tree):
    u = int(hashlib.md5(f"{key}:{tree // 4}".encode()).hexdigest()[tree % 4 * 8:][:8], 16)
    return sum(u >= bound for bound in forest.POISSON_BOUNDS)


def grown(rows):
    """(threshold, left, right) or a mean: splits by the least squared error until a node holds one x or one y."""
    ys = [y for _, y in rows]
    values = sorted({x for x, _ in rows})
    if len(values) == 1 or len(set(ys)) == 1:
        return sum(ys) / len(ys)
    cost = lambda part: sum((y - sum(part) / len(part)) ** 2 for y in part)
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
    best = min(cuts, key=lambda c: cost([y for x, y in rows if x <= c]) + cost([y for x, y in rows if x > c]))
    return best, grown([r for r in rows if r[0] <= best]), grown([r for r in rows if r[0] > best])


def told(tree, x):
    while isinstance(tree, tuple):
        tree = tree[1] if x <= tree[0] else tree[2]
    return tree


@pytest.mark.parametrize("n,whole", [(60, True), (60, False), (1, True)])
def test_forest_equals_grown_trees(spark, n, whole):
    rng = random.Random(n + whole)
    rows = []
    for i in range(n):
        x = float(rng.randrange(25)) if whole else rng.uniform(0, 10)
        rows.append((f"k{i}", x, rng.gauss(x, 3), i > 0 and rng.random() < 0.2))
    rows += rows[:1]  # a repeated row
    df = spark.createDataFrame(rows, "key string, x double, y double, is_test boolean").repartition(3)
    got = {r.x: r.prediction for r in forest.forest_predictions(df, trees=12).collect()}
    trees = []
    for t in range(12):
        sample = [(x, y) for k, x, y, test in rows if not test for _ in range(drawn(k, t))]
        if sample:
            trees.append(grown(sample))
    assert got == {x: pytest.approx(sum(told(tree, x) for tree in trees) / len(trees)) for _, x, _, _ in rows}


def test_ranges_meet(spark):
    """Many values in many ranges, few of them in a sample."""
    rng = random.Random(4)
    rows = [(f"k{i}", i / 4, rng.random(), i % 10 > 0) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, x double, y double, is_test boolean")
    got = {r.x: r.prediction for r in forest.forest_predictions(df, trees=5).collect()}
    samples = [{x: y for k, x, y, test in rows if not test and drawn(k, t)} for t in range(5)]
    want = {x: sum(s[min(s, key=lambda p: (abs(p - x), p))] for s in samples) / 5 for _, x, _, _ in rows}
    assert {x: pytest.approx(y) for x, y in want.items()} == got


def test_sums_leave_the_tasks_not_the_draws(spark):
    """A batch leaves one row for a tree and value, however many rows it has; means count rows as often as they are drawn."""
    rows = [(f"k{i}" if i else None, float(i % 3), float(i)) for i in range(300)]
    means = forest.sampled_means(spark.createDataFrame(rows, "key string, x double, y double").repartition(2), 6)
    assert "Generate" not in means._jdf.queryExecution().toString()
    want = {}
    for t in range(6):
        for x in range(3):
            some = [y for k, at, y in rows if at == x for _ in range(drawn(k, t) if k else sum(
                int(hashlib.md5(str(t // 4).encode()).hexdigest()[t % 4 * 8:][:8], 16) >= b for b in forest.POISSON_BOUNDS))]
            want |= {(t, x): pytest.approx(sum(some) / len(some))} if some else {}
    assert {(r.tree, r.x): r["mean"] for r in means.collect()} == want


def test_weights_follow_the_poisson_law(spark):
    counts = [drawn(k, t) for k in range(2000) for t in range(8)]
    assert abs(sum(counts) / len(counts) - 1) < 0.03 and abs(counts.count(0) / len(counts) - 0.368) < 0.015


def test_forest_without_rows(spark):
    schema = "key string, x double, y double, is_test boolean"
    assert forest.predict_forest(spark.createDataFrame([], schema)).count() == 0
    only_test = spark.createDataFrame([("a", 1.0, 2.0, True)], schema)
    assert [r.prediction for r in forest.predict_forest(only_test).collect()] == [None]
    assert models.TEST_TENTHS == 2
