"""Clusters, components, factors and models on several columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxrisk import views
from voxrisk.catalog.registry import query, r6
from voxrisk.operators import clustering, kmeans, moments

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: Bursts of activity: hours on the time line and value, in units of EPS.
EPS, MIN_POINTS = 2.0, 6
HEIGHTS = (1.0, 3.0)
#: First centres of the single k-means step over quantity and price in thousands.
CENTRES = [[5.0, 5.0], [20.0, 20.0], [30.0, 40.0], [45.0, 60.0], [200.0, 900.0]]


def _components_sql(nodes: str, links: str) -> str:
    """Smallest node reachable, by passing smaller names on along the links (a, b) in both directions."""
    return f"""
  SELECT id, id AS name FROM {nodes}
  UNION
  SELECT l.a, min(w.name) FROM {{walk}} w JOIN {links} l ON l.b = w.id JOIN recurring.{{walk}} r ON r.id = l.a WHERE w.name < r.name GROUP BY l.a"""


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    return events.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3600000000.0)).alias("hour"), "value")


@query("density_clusters", f"""
WITH RECURSIVE p AS (SELECT event_id AS id, epoch_us(ts) / 3600000000.0 AS x, value AS y FROM events),
near AS (
  SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b
  ON b.x BETWEEN a.x - {EPS} AND a.x + {EPS} AND b.y BETWEEN a.y - {EPS} AND a.y + {EPS}
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS} * {EPS}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_POINTS}),
links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
walk(id, name) USING KEY (id) AS ({_components_sql("core", "links").format(walk="walk")}),
beside AS (
  SELECT n.a AS id, arg_min(w.name, (n.d2, w.name)) AS name FROM near n JOIN walk w ON w.id = n.b
  WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a)
SELECT p.id AS event_id, coalesce(w.name, b.name) AS cluster,
  CASE WHEN w.id IS NOT NULL THEN 'core' WHEN b.id IS NOT NULL THEN 'border' ELSE 'noise' END AS role
FROM p LEFT JOIN walk w ON w.id = p.id LEFT JOIN beside b ON b.id = p.id""")
def density_clusters(spark, sf_dir):
    out = clustering.density_clusters(_bursts(spark, sf_dir), "event_id", ["hour", "value"], EPS, MIN_POINTS)
    return out.select("event_id", "cluster", "role")


def _cut_sql(height: float, name: str) -> str:
    return f"""near_{name} AS (
  SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON b.x BETWEEN a.x - {height} AND a.x + {height} AND b.y BETWEEN a.y - {height} AND a.y + {height}
  AND a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {height}),
walk_{name}(id, name) USING KEY (id) AS ({_components_sql("p", f"near_{name}").format(walk=f"walk_{name}")})"""


@query("linkage_clusters", f"""
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part),
{_cut_sql(HEIGHTS[0], "low")},
{_cut_sql(HEIGHTS[1], "high")}
SELECT l.id AS p_partkey, l.name AS cluster_low, h.name AS cluster_high FROM walk_low l JOIN walk_high h ON l.id = h.id""")
def linkage_clusters(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    linked = clustering.single_linkage(part, "p_partkey", ["p_retailprice", "p_size"], max(HEIGHTS))
    low, high = (linked.cut(part, h).select("p_partkey", F.col("cluster").alias(f"cluster_{name}")) for h, name in zip(HEIGHTS, ("low", "high")))
    return low.join(high, "p_partkey")


_CENTRES_SQL = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(CENTRES))


@query("kmeans_step", f"""
WITH p AS (SELECT row_number() OVER () AS place, l_orderkey * 10 + l_linenumber AS key, l_quantity AS x, l_extendedprice / 1000.0 AS y FROM lineitem),
c(cluster, cx, cy) AS (VALUES {_CENTRES_SQL}),
d AS (SELECT place, key, x, y, cluster, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM p, c),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY place ORDER BY d2, cluster) = 1),
far AS (SELECT x, y FROM best ORDER BY d2 DESC, key, x, y LIMIT 1),
sums AS (SELECT cluster, count(*) AS n, avg(x) AS x, avg(y) AS y FROM best GROUP BY cluster),
empty AS (SELECT min(cluster) AS cluster FROM c WHERE cluster NOT IN (SELECT cluster FROM sums))
SELECT CAST(c.cluster AS BIGINT) AS cluster, coalesce(s.n, 0) AS n, round(coalesce(s.x, f.x, c.cx), 6) AS x, round(coalesce(s.y, f.y, c.cy), 6) AS y,
  round((SELECT sum(d2) FROM best) / (SELECT count(*) FROM best), 6) AS mean_cost
FROM c LEFT JOIN sums s ON s.cluster = c.cluster LEFT JOIN empty e ON e.cluster = c.cluster LEFT JOIN far f ON e.cluster IS NOT NULL""")
def kmeans_step(spark, sf_dir):
    key, x = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.array("l_quantity", F.col("l_extendedprice") / 1000.0)
    step = kmeans.lloyd_step(views.table(spark, sf_dir, "lineitem").select(key.alias("key"), x.alias("x")), CENTRES)
    mean = step.cost / max(1, sum(step.sizes))
    rows = [(c, n, *at, mean) for c, (n, at) in enumerate(zip(step.sizes, step.centres))]
    return spark.createDataFrame(rows, "cluster long, n long, x double, y double, mean_cost double").select("cluster", "n", *r6("x", "y", "mean_cost"))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    scaled = views.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_extendedprice") / 1e5).alias("price"),
        (F.col("l_discount") * 10).alias("discount"))
    found = kmeans.kmeans(scaled, "key", ["quantity", "price", "discount"], 6, steps=10)
    return found.assign(scaled).select("key", "cluster", *r6("distance"))


@query("covariance_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 4) AS covariance, round(corr({a}, {b}), 6) AS correlation FROM (SELECT * REPLACE (l_extendedprice / 1000 AS l_extendedprice) FROM lineitem)"
    for a in MEASURES for b in MEASURES))
def covariance_matrix(spark, sf_dir):
    """Prices are in thousands, so that all entries have digits to show."""
    m = moments.moments(views.table(spark, sf_dir, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice") / 1000), MEASURES)
    cov, corr = m.covariance, m.correlation
    rows = [(a, b, float(cov[i, j]), float(corr[i, j])) for i, a in enumerate(MEASURES) for j, b in enumerate(MEASURES)]
    out = spark.createDataFrame(rows, "a string, b string, covariance double, correlation double")
    return out.select("a", "b", F.round("covariance", 4).alias("covariance"), *r6("correlation"))


@query("principal_components", """
WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT 1 AS component, round(1 + abs(r), 6) AS variance, round((1 + abs(r)) / 2, 6) AS explained, round(sqrt(0.5), 6) AS w_quantity, round(sign(r) * sqrt(0.5), 6) AS w_price FROM c
UNION ALL
SELECT 2, round(1 - abs(r), 6), round((1 - abs(r)) / 2, 6), round(sqrt(0.5), 6), round(-sign(r) * sqrt(0.5), 6) FROM c""")
def principal_components(spark, sf_dir):
    found = moments.principal_components(views.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], scaled=True)
    rows = [(k + 1, float(v), float(e), float(w[0]), float(w[1])) for k, (v, e, w) in enumerate(zip(found.variances, found.explained, found.axes.T))]
    return spark.createDataFrame(rows, "component int, variance double, explained double, w_quantity double, w_price double").select(
        "component", *r6("variance", "explained", "w_quantity", "w_price"))


@query("component_scores", """
WITH s AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, stddev_pop(l_extendedprice) AS sy, sign(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round(((l_quantity - mx) / sx + r * (l_extendedprice - my) / sy) * sqrt(0.5), 4) + 0.0 AS pc1,
  round(((l_quantity - mx) / sx - r * (l_extendedprice - my) / sy) * sqrt(0.5), 4) + 0.0 AS pc2 FROM lineitem, s""")
def component_scores(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem")
    found = moments.principal_components(rows, ["l_quantity", "l_extendedprice"], scaled=True)
    return found.project(rows).select("l_orderkey", "l_linenumber", (F.round("pc1", 4) + 0.0).alias("pc1"), (F.round("pc2", 4) + 0.0).alias("pc2"))


def _normal_sql(penalty: float) -> str:
    """Weights of two standardised columns from their 2 x 2 normal equations."""
    return f"""
WITH m AS (
  SELECT count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS sa, stddev_pop(l_discount) AS sb,
    corr(l_quantity, l_discount) AS r, covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS ca,
    covar_pop(l_discount, l_extendedprice) / stddev_pop(l_discount) AS cb, var_pop(l_extendedprice) AS vy FROM lineitem),
w AS (SELECT *, (ca * (1 + {penalty}) - r * cb) / ((1 + {penalty}) * (1 + {penalty}) - r * r) AS za, (cb * (1 + {penalty}) - r * ca) / ((1 + {penalty}) * (1 + {penalty}) - r * r) AS zb FROM m)
SELECT n, round(my - ma * za / sa - mb * zb / sb, 3) AS intercept, round(za / sa, 4) AS w_quantity, round(zb / sb, 3) AS w_discount,
  round(1 - (vy - 2 * (za * ca + zb * cb) + za * za + zb * zb + 2 * za * zb * r) / vy, 6) AS r2 FROM w"""


def _weights(spark: SparkSession, model: moments.LinearModel) -> DataFrame:
    row = (model.n, model.intercept, *map(float, model.coefficients), model.r2)
    return spark.createDataFrame([row], "n long, intercept double, w_quantity double, w_discount double, r2 double").select(
        "n", F.round("intercept", 3).alias("intercept"), F.round("w_quantity", 4).alias("w_quantity"), F.round("w_discount", 3).alias("w_discount"), *r6("r2"))


@query("linear_regression", _normal_sql(0.0))
def linear_regression(spark, sf_dir):
    return _weights(spark, moments.ridge_regression(views.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"))


@query("ridge_regression", _normal_sql(0.25))
def ridge_regression(spark, sf_dir):
    return _weights(spark, moments.ridge_regression(views.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", penalty=0.25))


@query("partial_least_squares", """
WITH m AS (
  SELECT count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS sa, stddev_pop(l_discount) AS sb,
    corr(l_quantity, l_discount) AS r, covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS ca,
    covar_pop(l_discount, l_extendedprice) / stddev_pop(l_discount) AS cb, var_pop(l_extendedprice) AS vy FROM lineitem),
w AS (SELECT *, (ca * ca + cb * cb) / (ca * ca + cb * cb + 2 * r * ca * cb) AS q FROM m)
SELECT n, round(my - ma * q * ca / sa - mb * q * cb / sb, 3) AS intercept, round(q * ca / sa, 4) AS w_quantity, round(q * cb / sb, 3) AS w_discount,
  round(1 - (vy - 2 * q * (ca * ca + cb * cb) + q * q * (ca * ca + cb * cb + 2 * r * ca * cb)) / vy, 6) AS r2 FROM w""")
def partial_least_squares(spark, sf_dir):
    return _weights(spark, moments.partial_least_squares(views.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 1))


@query("factor_analysis")
def factor_analysis(spark, sf_dir):
    found = moments.factor_analysis(views.table(spark, sf_dir, "lineitem"), MEASURES, 2)
    rows = [(c, float(a), float(b), float(h)) for c, (a, b), h in zip(found.columns, found.loadings, found.communalities)]
    return spark.createDataFrame(rows, "name string, factor1 double, factor2 double, communality double").select("name", *r6("factor1", "factor2", "communality"))
