"""Nearest vectors by inner product: stable projections, kd-trees over them, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrisk.session import settle

PROJECTIONS = 16  # even, so that the chi-square distribution has a closed form
#: Chance that a true neighbour's projection lies within the radius at which the search stops; bounds the recall from below.
CONFIDENCE = 0.95
SAMPLE = 20_000  # most vectors that the cells are fitted on; every vector is indexed
CELL_ROWS = 4096
SAMPLES_PER_CELL = 16
BLOCK_ROWS = 4096  # vectors that one kd-tree holds; fuller cells, also of equal vectors, get several
QUERIES_AT_ONCE = 2048
FIRST_BLOCKS = 4  # blocks that a query searches before its radius decides on the others
SLAB = 512  # vectors of a leaf of a block's kd-tree
TOGETHER = 256  # queries that share one matrix product


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number m of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(m // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def projection(width: int, m: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    """Gaussian (2-stable) matrix: squared projected over squared true distance follows chi-square with m degrees of freedom."""
    return np.random.default_rng(seed).standard_normal((width + 1, m))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate makes all vectors equally long, so that nearest by distance is largest by inner product."""
    return np.concatenate([vectors, np.sqrt(np.maximum(longest - (vectors * vectors).sum(axis=1), 0))[:, None]], axis=1)


def kd_splits(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, value, left, right) of a kd-tree of about so many leaves; a child -1-i is leaf i."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def grow(rows: np.ndarray, parts: int) -> int:
        nonlocal count
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(points.shape[1])
        if parts < 2 or not spread.size or spread.max() <= 0:
            count += 1
            return -count
        axis = int(spread.argmax())
        value = float(np.median(points[rows, axis]))
        left = points[rows, axis] < value
        if not left.any():  # the median is the least value: cut above it
            value = float(points[rows, axis][points[rows, axis] > value].min())
            left = points[rows, axis] < value
        at = len(nodes)
        nodes.append((axis, value, 0, 0))
        nodes[at] = (axis, value, grow(rows[left], parts // 2), grow(rows[~left], parts - parts // 2))
        return at

    grow(np.arange(len(points)), leaves)
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        axis, value, left, right = nodes[at]
        below = points[rows, axis] < value
        for child, part in ((left, rows[below]), (right, rows[~below])):
            if child < 0:
                out[part] = -1 - child
            elif len(part):
                todo.append((child, part))
    return out


def box_distances(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances between points and boxes, of either of which there may be one only."""
    out = np.maximum(np.maximum(low - points, points - high), 0)
    return (out * out).sum(axis=1)


class Block:
    """Vectors of one block in slabs: leaves of a kd-tree over their projections, each with its box."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        leaf = cell_of(points, kd_splits(points, -(-len(ids) // SLAB)))
        order = np.lexsort((rows, leaf))
        self.rows, self.ids, self.vectors, self.points = rows[order], ids[order], vectors[order], points[order]
        self.start = np.append(np.flatnonzero(np.diff(leaf[order], prepend=-1)), len(ids))
        self.low = np.minimum.reduceat(self.points, self.start[:-1])
        self.high = np.maximum.reduceat(self.points, self.start[:-1])
        self.squares = (self.points * self.points).sum(axis=1)
        self.verified = 0  # pairs of a query and a vector whose inner product was taken

    def search(
        self, own: np.ndarray, queries: np.ndarray, points: np.ndarray, limits: np.ndarray, k: int, longest: float, quantile: float,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, inner product) of the k nearest found of each query.

        Every query takes the slabs in order of their distance in the projection. Of a slab, only vectors are verified within the
        radius beyond which one as near as the k-th so far would not have been projected, with the wanted confidence; a query
        whose next slab lies beyond its radius has passed the stopping test. ``limits`` are squared k-th distances known
        from elsewhere. One matrix product serves all queries that are at the same slab; what may be among the k nearest by
        it is scored once more row by row, in one order of summation, so that equal vectors score equally wherever they lie."""
        n = len(queries)
        best, names = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        limits, lengths = limits.copy(), (queries * queries).sum(axis=1)
        margin = 1e-10 * np.sqrt(lengths * longest)
        away = np.stack([box_distances(low, high, points) for low, high in zip(self.low, self.high)], axis=1)
        order = np.argsort(away, axis=1, kind="stable")
        for at in range(order.shape[1]):
            for slab in np.unique(order[:, at]):
                asking = np.flatnonzero((order[:, at] == slab) & (away[:, slab] <= quantile * limits))
                for q in np.array_split(asking, -(-len(asking) // TOGETHER) or 1):
                    if len(q):
                        self._verify(q, slice(self.start[slab], self.start[slab + 1]), own, queries, points, quantile * limits, margin, best, names)
                        full = q[best[q, -1] > -np.inf]
                        reach = np.maximum(0.0, longest + lengths[full] - 2 * best[full, -1]) * (1 + 1e-9) + 1e-12 * (longest + lengths[full])
                        limits[full] = np.minimum(limits[full], reach)
        who, place = np.nonzero(best > -np.inf)
        return who, names[who, place], best[who, place]

    def _verify(self, q, slab, own, queries, points, radius, margin, best, names) -> None:
        """Lets the vectors of a slab within the radius of the queries numbered ``q`` into their k nearest."""
        k = best.shape[1]
        apart = self.squares[slab] + (points[q] * points[q]).sum(axis=1)[:, None] - 2 * points[q] @ self.points[slab].T
        near = (apart <= radius[q, None] * (1 + 1e-9)) & (self.rows[slab] != own[q, None])
        held = np.flatnonzero(near.any(axis=0))
        if not len(held):
            return
        near, held = near[:, held], held + slab.start
        self.verified += int(near.sum())
        rough = np.where(near, queries[q] @ self.vectors[held].T, -np.inf)
        least = best[q, -1]
        if len(held) > k:
            least = np.maximum(least, np.partition(rough, -k, axis=1)[:, -k])
        who, which = np.nonzero(near & (rough >= (least - 2 * margin[q])[:, None]))
        hit = np.unique(who)
        scores = (self.vectors[held[which]] * queries[q[who]]).sum(axis=1)
        who = np.concatenate([np.repeat(hit, k), who])
        scores = np.concatenate([best[q[hit]].ravel(), scores])
        ids = np.concatenate([names[q[hit]].ravel(), self.ids[held[which]]])
        by = np.lexsort((ids, -scores, who))
        who, scores, ids = who[by], scores[by], ids[by]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < k
        best[q[who[top]], place[top]], names[q[who[top]], place[top]] = scores[top], ids[top]


def usable(vector: Column) -> Column:
    """Vectors that can be near to anything: no null or non-finite component, and not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_every: int = 20, confidence: float = CONFIDENCE,
    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE, queries_at_once: int = QUERIES_AT_ONCE,
) -> DataFrame:
    """The ``k`` nearest found of each query by inner product: query_id, rank, vec_id, score (double precision).

    Queries are the rows whose id is divisible by ``query_every``, candidates all rows but the query's own. Vectors are lifted to
    equal length, projected by a Gaussian matrix to PROJECTIONS dimensions and dealt into cells by a kd-tree fitted on at most about
    ``sample`` of them; a cell of over ``block_rows`` is divided by hash. A query first searches its own block and those
    nearest to it in the projection, FIRST_BLOCKS in all. The distance of its k-th neighbour there and the chi-square quantile give
    the radius in the projection beyond which the stopping test holds, so only blocks within it are searched then, each in
    order of projected distance until the test holds. Equal scores are ranked by id.

    Null and unusable vectors (see ``usable``) and null ids take no part. Rows are told apart by their place: of repeated rows each is
    a query with a list of its own, and a candidate of the others under the id that they share. Only vectors of one length
    have an inner product, so tables of several lengths are searched length by length, with a few jobs each. Fewer than k
    candidates give fewer rows, none give none. Other columns are not read. Jobs run when this is called."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = given.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest"))
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for kind in widths.orderBy("width").collect():  # one row per length of vectors
        rows = given.where(F.size("v") == kind.width)
        found = found.unionByName(_nearest(rows, kind.width, kind.n, kind.longest, k, query_every, confidence, cell_rows, block_rows, sample, queries_at_once))
    return found


def _nearest(
    given: DataFrame, width: int, n: int, longest: float, k: int, query_every: int, confidence: float, cell_rows: int, block_rows: int, sample: int,
    queries_at_once: int,
) -> DataFrame:
    """``nearest`` for the ``n`` usable rows (id, v) of one width, ``longest`` being their largest squared length."""
    matrix, quantile = projection(width), chi_square_quantile(confidence, PROJECTIONS)
    flat = matrix[:width]  # a query is lifted by a zero

    def table(lists: pd.Series, size: int) -> np.ndarray:
        return np.array(lists.tolist(), float).reshape(-1, size)

    def project(rows: np.ndarray) -> np.ndarray:
        return lifted(rows, longest) @ matrix

    lucky = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))
    drawn = np.array([r.v for r in given.where(lucky).select("v").collect()], float).reshape(-1, width)
    nodes = kd_splits(project(drawn), max(1, min(-(-n // cell_rows), len(drawn) // SAMPLES_PER_CELL)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = project(table(batch["v"], width))
            yield pd.DataFrame({"row": batch["row"], "id": batch["id"], "v": batch["v"], "cell": cell_of(points, nodes), "p": list(points)})

    # the numbers of rows are written with them, so that no later stage can number anew
    placed = given.withColumn("row", F.monotonically_increasing_id()).mapInPandas(place, "row long, id long, v array<double>, cell long, p array<double>")
    placed = settle(placed, "near-vectors")
    edges = [f(F.get("p", j)).alias(f"{name}{j}") for j in range(PROJECTIONS) for name, f in (("low", F.min), ("high", F.max))]
    boxes = settle(placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"), *edges), "near-boxes")
    found_boxes = boxes.collect()  # one per cell
    cells = np.array([(r.cell, r.blocks) for r in found_boxes], np.int64).reshape(-1, 2)
    low, high = (np.array([[r[f"{name}{j}"] for j in range(PROJECTIONS)] for r in found_boxes], float).reshape(-1, PROJECTIONS) for name in ("low", "high"))
    placed = placed.join(F.broadcast(boxes.select("cell", "blocks")), "cell").withColumn(
        "block", F.pmod(F.xxhash64("row", F.lit(23)), F.col("blocks")).cast("int")).drop("blocks")
    queries = placed.where(F.col("id") % query_every == 0).select("row", F.col("id").alias("query_id"), F.col("v").alias("q"), "cell", "block")

    def route(first: bool):
        """Blocks of the first or of the second step: those in reach by their distance, the query's own before all others."""
        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row, name, v, cell, block, limit in zip(*(batch[c] for c in ("row", "query_id", "q", "cell", "block", "limit"))):
                    away = box_distances(low, high, (np.asarray(v, float) @ flat)[None, :])
                    away[cells[:, 0] == cell] = -1
                    near = np.argsort(away, kind="stable")
                    near = cells[near[away[near] <= quantile * limit]]
                    near = near[:FIRST_BLOCKS] if first else near
                    which = np.repeat(near[:, 0], near[:, 1])
                    number = np.arange(len(which)) - np.repeat(np.cumsum(near[:, 1]) - near[:, 1], near[:, 1])
                    number[:near[0, 1]] = (number[:near[0, 1]] + block) % near[0, 1]
                    which, number = (x[:FIRST_BLOCKS] if first else x[FIRST_BLOCKS:] for x in (which, number))
                    if len(which):
                        yield pd.DataFrame({"cell": which, "block": number.astype(np.int32), "row": row, "query_id": name, "q": [v] * len(which), "limit": limit})

        return visits

    def look(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({c: np.zeros(0, t) for c, t in (("row", int), ("query_id", int), ("vec_id", int), ("score", float))})
        index, q = Block(rows["row"].to_numpy(), rows["id"].to_numpy(), table(rows["v"], width), table(rows["p"], PROJECTIONS)), table(asked["q"], width)
        who, ids, scores = index.search(asked["row"].to_numpy(), q, q @ flat, asked["limit"].to_numpy(float), k, longest, quantile)
        return pd.DataFrame({"row": asked["row"].to_numpy()[who], "query_id": asked["query_id"].to_numpy()[who], "vec_id": ids, "score": scores})

    def step(asking: DataFrame, first: bool) -> DataFrame:
        visits = settle(asking.mapInPandas(route(first), "cell long, block int, row long, query_id long, q array<double>, limit double"), "near-visits")
        parts = settle(visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / queries_at_once).cast("int").alias("parts")), "near-parts")  # one per block
        asked = visits.join(parts, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
        held = placed.join(parts, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        key = ["cell", "block", "part"]
        return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(look, "row long, query_id long, vec_id long, score double")

    ranked = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    early = settle(step(queries.withColumn("limit", F.lit(float("inf"))), True).withColumn("rank", ranked).where(F.col("rank") <= k), "near-early")
    worst = early.where(F.col("rank") == k).select("row", "score")
    square = F.aggregate("q", F.lit(longest), lambda a, x: a + x * x)
    reach = F.greatest(square - 2 * F.col("score"), F.lit(0.0)) * (1 + 1e-9) + square * 1e-12
    later = step(queries.join(worst, "row", "left").withColumn("limit", F.coalesce(reach, F.lit(float("inf")))).drop("score"), False)
    both = early.drop("rank").unionByName(later)
    return both.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
