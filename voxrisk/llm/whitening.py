"""Whitening of embeddings by principal components, which contour integration finds interval by interval."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
EXACT = 1 << 53  # whole numbers up to here are exact as doubles
SLICE = 8  # components looked for in one interval
REACH = 4  # an interval's upper end over its lower one, about: a wide circle can't tell the small eigenvalues at its edge apart
NARROW = 1e-6  # eigenvalues closer than this share of the largest are kept in one interval
NODES = 8  # quadrature nodes on the half circle
ROUNDS = 20
EPS = np.finfo(float).eps


# --- eigenpairs of one symmetric matrix ----------------------------------------------
def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: the positive part of the inertia of matrix - shift * I, from a symmetric factorisation with
    pivots of one or two rows, the largest entry left deciding which."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal().copy()
        np.fill_diagonal(size, 0)
        i, (r, s) = int(diagonal.argmax()), divmod(int(size.argmax()), len(a))
        if diagonal[i] == 0 and size[r, s] == 0:
            break  # what is left equals the shift
        if diagonal[i] >= (1 + math.sqrt(17)) / 8 * size[r, s]:
            taken, above = [i], above + int(a[i, i] > 0)
        else:
            taken, above = [r, s], above + 1  # such a block has one eigenvalue of either sign
        rest = np.delete(np.arange(len(a)), taken)
        beside = a[np.ix_(rest, taken)]
        a = a[np.ix_(rest, rest)] - beside @ np.linalg.solve(a[np.ix_(taken, taken)], beside.T)
    return above


def _cut(matrix: np.ndarray, wanted: int, low: float, high: float) -> tuple[float, int]:
    """A place below the ``wanted`` largest eigenvalues, amid the gap to the next, and how many are above it: more than wanted where
    the next are almost the same."""
    gap, fine = NARROW * high, 1e-3 * (high - low)

    def edge(floor: float, ceiling: float, most: int) -> tuple[float, float]:
        """(floor, ceiling) drawn together; above the ceiling are at most ``most``, above the floor more."""
        while ceiling - floor > fine:
            middle = (floor + ceiling) / 2
            floor, ceiling = (floor, middle) if count_above(matrix, middle) <= most else (middle, ceiling)
        return floor, ceiling

    floor, ceiling = low, high
    while ceiling - floor > gap:
        middle = (floor + ceiling) / 2
        n = count_above(matrix, middle)
        if n == wanted:
            return (edge(low, middle, wanted)[1] + edge(middle, high, wanted - 1)[0]) / 2, wanted
        floor, ceiling = (middle, ceiling) if n > wanted else (floor, middle)
    n = count_above(matrix, floor)
    return (floor, n) if floor == low else _cut(matrix, n, low, floor)


def contour_pairs(matrix: np.ndarray, low: float, high: float, n: int, seed: int = 12) -> np.ndarray:
    """Vectors that span the eigenvectors of the ``n`` eigenvalues in (low, high).

    Complex shifted solves at quadrature nodes of the circle over the interval project a block of vectors onto that space; its
    Ritz pairs start the next round. It ends when as many of them as the inertia counts lie inside, all with small residuals; after ROUNDS
    without that the block is doubled."""
    d, scale = len(matrix), np.abs(matrix).sum(axis=1).max()
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (nodes + 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    luck = np.random.default_rng(seed)
    width, block = min(d, n + max(4, n // 2)), np.zeros((d, 0))
    while True:
        block = np.hstack([block, luck.standard_normal((d, width - block.shape[1]))])
        for _ in range(ROUNDS):
            projected = sum(
                w / 2 * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - matrix, block.astype(complex))).real for t, w in zip(turn, weights))
            base = np.linalg.qr(projected)[0]
            values, mix = np.linalg.eigh(base.T @ matrix @ base)
            block = base @ mix
            inside = (values > low) & (values < high)
            residual = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if inside.sum() == n and (residual <= 8 * d * EPS * scale).all():
                return block[:, inside]
        if width == d:
            raise ArithmeticError(f"{inside.sum()} of {n} components found between {low} and {high}")
        width = min(d, 2 * width)  # many eigenvalues lie close to an end: more vectors hold them


def principal_pairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of a covariance, largest first: the ``wanted`` largest, fewer where the others are zero.

    Inertia counts cut the spectrum into intervals of about SLICE eigenvalues and say how many each must yield. A last Ritz step over
    all intervals makes their vectors orthogonal to double precision."""
    d = len(matrix)
    top = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if top == 0:
        return np.zeros(0), np.zeros((d, 0))
    low, high = 8 * d * EPS * top, top * (1 + 1e-6)
    wanted = min(wanted, count_above(matrix, low))
    found, above, ceiling = [], 0, high
    while above < wanted:
        while (n := count_above(matrix, max(low, ceiling / REACH))) == above:  # nothing in the upper part
            ceiling /= REACH
        floor, n = _cut(matrix, min(above + SLICE, wanted, n), low, ceiling)
        found.append(contour_pairs(matrix, floor, ceiling, n - above))
        above, ceiling = n, floor
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    base = np.linalg.qr(np.hstack(found))[0]
    values, mix = np.linalg.eigh(base.T @ matrix @ base)
    vectors = (base @ mix)[:, ::-1][:, :wanted]
    heaviest = np.abs(vectors).argmax(axis=0)
    return values[::-1][:wanted], vectors * np.sign(vectors[heaviest, np.arange(vectors.shape[1])])


# --- exact sums over rows --------------------------------------------------------------
def whole_gram(rows: np.ndarray) -> np.ndarray:
    """rows' cross products as Python integers, exact for any size of the entries."""
    most = int(np.abs(rows).max(initial=0))
    if most * most * max(1, len(rows)) < EXACT:
        return (rows.T.astype(float) @ rows.astype(float)).astype(np.int64).astype(object)
    whole = rows.astype(object)
    return whole.T @ whole


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _pairs(table: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    i, j = np.triu_indices(len(table))
    return pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), table[i, j]


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them given, finite and small enough for whole numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c) < EXACT / SCALE, F.lit(False))), F.lit(False))


@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]  # of the scaled entries without SHIFT, which no result depends on
    variance: float  # trace of the covariance
    values: np.ndarray
    vectors: np.ndarray


def fit(vectors: DataFrame, width: int, components: int) -> Fit:
    """Covariance and components of whole-number vectors ``y``. Tasks give exact partial sums of products, which are added up by
    place, so (width + 1) * (width + 2) / 2 numbers reach the driver, however many the rows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0), width)
                part = whole_gram(np.hstack([y, np.ones((len(y), 1), np.int64)]))
                total = part if total is None else total + part
        if total is not None:
            i, j, p = _pairs(total)
            yield pa.RecordBatch.from_arrays([i, j, pa.array([Decimal(int(x)) for x in p], pa.decimal128(38, 0))], ["i", "j", "p"])

    sums = vectors.mapInArrow(partial, "i int, j int, p decimal(38,0)").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    gram = {(r.i, r.j): int(r.p) for r in sums}
    n = gram[width, width]
    s = [gram[i, width] for i in range(width)]
    covariance = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            covariance[i, j] = covariance[j, i] = (n * gram[i, j] - s[i] * s[j]) / (n * n)  # whole numbers until this division
    variance = sum(n * gram[i, i] - s[i] * s[i] for i in range(width)) / (n * n)
    return Fit(n, s, variance, *principal_pairs(covariance, components))


def centred(y: np.ndarray, fitted: Fit) -> np.ndarray:
    """n * y - sums, exactly; Python integers where 64 bits are too few for it."""
    reach = fitted.n * int(np.abs(y).max(initial=0)) + max(map(abs, fitted.sums))
    if reach < EXACT:
        return y * fitted.n - np.array(fitted.sums, np.int64)
    return y.astype(object) * fitted.n - np.array(fitted.sums, object)


def whitened(y: np.ndarray, fitted: Fit) -> np.ndarray:
    return centred(y, fitted).astype(float) / fitted.n @ fitted.vectors / np.sqrt(fitted.values)


def identity_error(vectors: DataFrame, width: int, fitted: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on all of them."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            z = np.hstack([whitened(_matrix(batch.column(0), width), fitted), np.ones((batch.num_rows, 1))])
            total += z.T @ z
        i, j, p = _pairs(total)
        yield pa.RecordBatch.from_arrays([i, j, pa.array(p)], ["i", "j", "p"])

    k = len(fitted.values)
    sums = {(r.i, r.j): r.p / fitted.n for r in vectors.mapInArrow(partial, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()}
    return max((abs(sums[i, j] - sums[i, k] * sums[j, k] - (i == j)) for i in range(k) for j in range(i, k)), default=0.0)


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all vectors: a row per vector and principal component.

    An entry c becomes the whole number floor(64 c) + 1000000. The covariance over all vectors (divisor n) comes from exact sums;
    ``principal_pairs`` finds its components. Returns the id, component (from 1, by falling variance), n, deviation (sum of
    (n x - S)^2 over the dimensions, exact), whitened, explained (share of the whole variance) and identity_error (see there).

    Vectors that are null, empty, or hold a null, a non-finite number or one of 2^47 or more are left out. Vectors of different
    widths have no common covariance and raise a ValueError. Components without variance can't be scaled and are left out: fewer
    rows where dimensions are constant or dependent, none if all vectors are equal. Null ids and repeated rows count like others;
    other columns are not read; an empty table gives no rows. Widths of a few thousand are the practical bound: the driver
    factorises one matrix of that width. Jobs run when this is called."""
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vector = embeddings[vector_col].cast("array<double>")
    rows = embeddings.select(embeddings[id_col].alias("id"), vector.alias("v")).where(usable(F.col("v"))).select(
        "id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("y"))
    least, width = rows.agg(F.min(F.size("y")), F.max(F.size("y"))).first()
    if width is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    if least != width:
        raise ValueError(f"vectors of {least} to {width} entries have no common covariance")
    fitted = fit(rows.select("y"), width, components)
    error = identity_error(rows.select("y"), width, fitted)
    k = len(fitted.values)
    explained = fitted.values / fitted.variance if k else np.zeros(0)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            y = _matrix(batch.column(1), width)
            off, b = centred(y, fitted), len(y)
            if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * width >= 1 << 63:
                off = off.astype(object)
            deviation = [Decimal(int(x)) for x in (off * off).sum(axis=1)]
            each = np.repeat(np.arange(b), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b)), pa.array(np.full(b * k, fitted.n, np.int64)),
                pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)), pa.array(whitened(y, fitted).ravel()), pa.array(np.tile(explained, b)),
                pa.array(np.full(b * k, error)),
            ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(coordinates, schema)
