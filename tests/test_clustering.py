"""Density clusters, single linkage and forests against plain-Python versions."""

import math
import random

import pytest

from voxrisk.operators import clustering
from voxrisk.operators.geometry import cell_side, closest_pairs
from voxrisk.operators.graphs import connected, minimum_forest


def distance2(p, q):
    return sum((a - b) * (a - b) for a, b in zip(p, q))


def labels_of(links, nodes):
    label = {i: i for i in nodes}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {i: root(i) for i in nodes}


def brute_density(rows, eps, min_points):
    rows = [(k, p) for k, p in rows if all(c is not None and math.isfinite(c) for c in p)]
    near = {k: [q for q, y in rows if distance2(p, y) <= eps * eps] for k, p in rows}
    at = dict(rows)
    core = {k for k in near if len(near[k]) >= min_points}
    names = labels_of([(k, q) for k in core for q in near[k] if q in core], core)
    out = {}
    for k, p in rows:
        found = [(distance2(p, at[q]), names[q]) for q in near[k] if q in core]
        out[k] = (names[k], "core") if k in core else (min(found)[1], "border") if found else (None, "noise")
    return out


def random_points(rng, n, d):
    centres = [[rng.uniform(0, 20) for _ in range(d)] for _ in range(5)]
    spread = [rng.choice([0.05, 0.5, 2.0]) for _ in centres]
    rows = []
    for k in range(n):
        c = rng.randrange(5)
        p = [rng.gauss(m, spread[c]) for m in centres[c]] if rng.random() < 0.85 else [rng.uniform(-5, 25) for _ in range(d)]
        if rng.random() < 0.3:
            p = [round(x, 1) for x in p]  # ties in distance and equal places
        rows.append((k, p))
    return rows


def table(spark, rows, d):
    names = [f"c{i}" for i in range(d)]
    return names, spark.createDataFrame([(k, *p, "x") for k, p in rows], "id long, " + ", ".join(f"{c} double" for c in names) + ", role_given string")


@pytest.mark.parametrize("d,eps,min_points", [(1, 0.1, 4), (2, 0.5, 5), (2, 0.1, 3), (3, 1.0, 4)])
def test_density_clusters(spark, d, eps, min_points):
    rng = random.Random(d * 100 + min_points)
    rows = random_points(rng, 260, d) + [(1000, [None] * d), (1001, [math.nan] + [0.0] * (d - 1)), (1002, [math.inf] * d)]
    rows += [(2000 + i, [3.0] * d) for i in range(40)] + [(3000, [-0.0] * d), (3001, [0.0] * d)]
    names, df = table(spark, rows, d)
    got = {r.id: (r.cluster, r.role) for r in clustering.density_clusters(df, "id", names, eps, min_points).collect()}
    want = brute_density(rows, eps, min_points) | {i: (None, None) for i in (1000, 1001, 1002)}
    assert got == want


def test_density_one_hot_cell(spark):
    rng = random.Random(5)
    hot = [(i, [rng.uniform(0, 0.5), rng.uniform(0, 0.5)]) for i in range(700)]
    rows = hot + [(1000 + i, [rng.uniform(-3, 3), rng.uniform(-3, 3)]) for i in range(200)]
    names, df = table(spark, rows, 2)
    assert {r.id: (r.cluster, r.role) for r in clustering.density_clusters(df, "id", names, 0.8, 6).collect()} == brute_density(rows, 0.8, 6)


def test_density_edges(spark):
    names, df = table(spark, [], 2)
    assert clustering.density_clusters(df, "id", names, 1.0, 3).count() == 0
    names, df = table(spark, [(1, [0.0, 0.0]), (1, [0.5, 0.0]), (None, [9.0, 9.0])], 2)
    got = sorted((r.id or -1, r.cluster, r.role) for r in clustering.density_clusters(df, "id", names, 1.0, 2).collect())
    assert got == [(-1, None, "noise"), (1, 1, "core"), (1, 1, "core")]
    with pytest.raises(ValueError):
        clustering.density_clusters(spark.createDataFrame([(1, *[0.0] * 5)], "id long, " + ", ".join(f"c{i} double" for i in range(5))), "id", [f"c{i}" for i in range(5)], 1.0, 2)


def test_closest_pairs(spark):
    rng = random.Random(8)
    groups = {g: [[rng.gauss(m, 0.4), rng.gauss(m, 0.4)] for _ in range(60)] for g, m in (("a", 0), ("b", 1), ("c", 5), ("d", 0))}
    points = spark.createDataFrame([(g, p) for g, ps in groups.items() for p in ps], "group string, x array<double>")
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("a", "d")]
    got = {(r.a, r.b): r.d2 for r in closest_pairs(points, spark.createDataFrame(pairs, "a string, b string"), 2, cell_side(1.0, 2), limit=2.0).collect()}
    want = {(a, b): min(distance2(p, q) for p in groups[a] for q in groups[b]) for a, b in pairs}
    assert got == pytest.approx({k: v for k, v in want.items() if v <= 4.0})


def test_connected_and_forest(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(50), rng.randrange(50), float(rng.randrange(12))) for _ in range(120)] + [(60, 60 + k, 1.0) for k in range(1, 30)] + [(7, 7, 0.0)]
    df = spark.createDataFrame(edges, "a long, b long, height double")
    nodes = {x for a, b, _ in edges for x in (a, b)} - {7} | {x for a, b, _ in edges if a != b for x in (a, b)}
    want = labels_of([(a, b) for a, b, _ in edges], nodes)
    assert {r.node: r.component for r in connected(df).collect()} == want
    forest, members = minimum_forest(df)
    assert {r.node: r.component for r in members.collect()} == want
    chosen, plain = [], {i: i for i in nodes}
    for a, b, h in sorted(edges, key=lambda e: e[2]):
        now = labels_of([(x, y) for x, y, _ in chosen], nodes)
        if now.get(a) != now.get(b):
            chosen.append((a, b, h))
    assert plain and sorted(r.height for r in forest.collect()) == sorted(h for _, _, h in chosen)


@pytest.mark.parametrize("d,fine", [(1, 32), (2, 32), (2, 4)])
def test_single_linkage(spark, monkeypatch, d, fine):
    monkeypatch.setattr(clustering, "FINE_PLACES", fine)
    rng = random.Random(fine + d)
    rows = random_points(rng, 140, d) + [(500 + i, [1.0] * d) for i in range(3)] + [(900, [None] * d)]
    names, df = table(spark, rows, d)
    found = clustering.single_linkage(df, "id", names, 1.5)
    usable = [(k, p) for k, p in rows if None not in p]
    for height in (0.0, 0.2, 0.7, 1.5):
        links = [(a, b) for a, p in usable for b, q in usable if a < b and math.sqrt(distance2(p, q)) <= height]
        want = labels_of(links, [k for k, _ in usable]) | {900: None}
        assert {r.id: r.cluster for r in found.cut(df, height).collect()} == want, height
    with pytest.raises(ValueError):
        found.cut(df, 2.0)


def test_single_linkage_edges(spark):
    names, df = table(spark, [], 2)
    assert clustering.single_linkage(df, "id", names, 1.0).merges.count() == 0
    names, df = table(spark, [(1, [0.0, 0.0]), (1, [0.0, 1.0])], 2)
    with pytest.raises(ValueError):
        clustering.single_linkage(df, "id", names, 1.0)
