"""Means and centred cross products of numeric columns in one pass, and the linear models that need nothing else.

A model is fitted from a matrix as wide as the columns, whatever the number of rows, and applied to rows as a column expression."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.session import settle

#: Columns that one matrix may have: 8 MB of it, and half a million sums that reach the driver.
MOST_COLUMNS = 1000
#: A direction that keeps less than this share of its column's own spread is taken as dependent on the others.
DEPENDENT = 1e-10


def numbers(columns: Sequence[str]) -> Column:
    """The columns as an array of doubles; null where one of them is missing or not finite."""
    x = F.array(*[F.col(name).cast("double") for name in columns])
    return F.when(F.forall(x, lambda c: F.coalesce(F.abs(c) < math.inf, F.lit(False))), x)


@dataclass(frozen=True)
class Moments:
    """Rows counted, their means, and sums of products of deviations from the means."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return self.cross / max(1, self.n)

    @property
    def spread(self) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.covariance.diagonal()))

    @property
    def correlation(self) -> np.ndarray:
        """A constant column has correlation 0 with others and 1 with itself."""
        scale = np.where(self.spread > 0, self.spread, 1.0)
        out = self.covariance / np.outer(scale, scale)
        np.fill_diagonal(out, 1.0)
        return out

    def part(self, columns: Sequence[int]) -> "Moments":
        at = list(columns)
        return Moments(self.n, self.mean[at], self.cross[np.ix_(at, at)])


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments of the rows in which all of the columns are given and finite.

    Each task centres its rows on its own mean, so no digits are lost to large values. The partial results, one per task and pair of
    columns, are written; their means give the common mean, and a second small grouping moves the products to it."""
    if not 0 < len(columns) <= MOST_COLUMNS:
        raise ValueError(f"1 to {MOST_COLUMNS} columns, not {len(columns)}")
    d = len(columns)
    i, j = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, cross = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                own, m = x.mean(axis=0), len(x)
                off = x - own
                away = own - mean
                cross += off.T @ off + np.outer(away, away) * (n * m / (n + m))
                mean += away * (m / (n + m))
                n += m
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (i.astype(np.int32), j.astype(np.int32), np.full(len(i), n), mean[i], mean[j], cross[i, j])],
                ["i", "j", "n", "mi", "mj", "c"])

    rows = df.select(numbers(columns).alias("x")).where("x IS NOT NULL")
    parts = settle(rows.mapInArrow(partial, "i int, j int, n long, mi double, mj double, c double"), "moments")
    own = parts.where("i = j").groupBy("i").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mi")) / F.sum("n")).alias("m")).collect()
    if not own:
        return Moments(0, np.zeros(d), np.zeros((d, d)))
    mean = np.array([r.m for r in sorted(own)])
    common = F.lit(mean.tolist())
    shifted = F.col("c") + F.col("n") * (F.col("mi") - F.get(common, F.col("i"))) * (F.col("mj") - F.get(common, F.col("j")))
    cross = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum(shifted).alias("c")).collect():
        cross[r.i, r.j] = cross[r.j, r.i] = r.c
    return Moments(int(own[0].n), mean, cross)


def linear(columns: Sequence[str], weights: Sequence[float], constant: float = 0.0) -> Column:
    """constant + sum of weights times columns; null where a column is."""
    total = F.lit(float(constant))
    for name, weight in zip(columns, weights):
        total = total + F.col(name).cast("double") * F.lit(float(weight))
    return total


# --- principal components ---------------------------------------------------------------
@dataclass(frozen=True)
class Components:
    columns: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    variances: np.ndarray
    axes: np.ndarray  # a column per component
    total: float

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total if self.total else self.variances

    def project(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """The rows with their coordinates ``pc1``, ``pc2`` ...; null where a column is."""
        weights = self.axes / self.scale[:, None]
        return df.withColumns({f"{prefix}{k + 1}": linear(self.columns, w, -float(self.mean @ w)) for k, w in enumerate(weights.T)})


def _signed(axes: np.ndarray) -> np.ndarray:
    """Axes turned so that the largest entry of each, the first of equals, is positive."""
    heaviest = np.abs(axes).round(12).argmax(axis=0)
    turn = np.sign(axes[heaviest, np.arange(axes.shape[1])])
    return axes * np.where(turn == 0, 1, turn)


def principal_components(df: DataFrame, columns: Sequence[str], k: int | None = None, scaled: bool = False, given: Moments | None = None) -> Components:
    """The ``k`` directions of largest variance (population), all by default; ``scaled`` works on columns brought to variance 1, constant
    ones staying as they are. Rows with a missing number take no part; without rows all variances are 0."""
    m = given or moments(df, columns)
    scale = np.where(m.spread > 0, m.spread, 1.0) if scaled else np.ones(len(columns))
    matrix = m.covariance / np.outer(scale, scale)
    values, axes = np.linalg.eigh(matrix)
    values, axes = np.maximum(0.0, values[::-1])[:k], axes[:, ::-1][:, :k]
    return Components(tuple(columns), m.mean, scale, values, _signed(axes), float(np.trace(matrix)))


# --- regression on several columns --------------------------------------------------------
def pivoted_solve(matrix: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(solution, columns used) of a symmetric system without negative eigenvalues.

    Columns are taken by the largest spread that the ones before leave unexplained. One that keeps less than DEPENDENT of its own is
    dependent on them, or constant, and gets 0."""
    d = len(matrix)
    rest, used = matrix.astype(float).copy(), []
    own = matrix.diagonal()
    while len(used) < d:
        share = np.array([rest[i, i] / own[i] if own[i] > 0 and i not in used else 0.0 for i in range(d)])
        best = int(share.argmax())
        if share[best] <= DEPENDENT:
            break
        used.append(best)
        rest = rest - np.outer(rest[:, best], rest[best]) / rest[best, best]
    out = np.zeros(d)
    if used:
        # Cholesky factor of the columns used, in the order taken; then forward and back substitution
        part = matrix[np.ix_(used, used)]
        low = np.zeros_like(part, dtype=float)
        for r in range(len(used)):
            for c in range(r + 1):
                left = part[r, c] - low[r, :c] @ low[c, :c]
                low[r, c] = math.sqrt(left) if r == c else left / low[c, c]
        half = np.zeros(len(used))
        for r in range(len(used)):
            half[r] = (right[used[r]] - low[r, :r] @ half[:r]) / low[r, r]
        for r in reversed(range(len(used))):
            half[r] = (half[r] - low[r + 1:, r] @ half[r + 1:]) / low[r, r]
        out[used] = half
    return out, sorted(used)


@dataclass(frozen=True)
class LinearModel:
    columns: tuple[str, ...]
    intercept: float
    coefficients: np.ndarray
    n: int
    r2: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, linear(self.columns, self.coefficients, self.intercept))

    def expression(self) -> str:
        return f"y={self.intercept:.4f}" + "".join(f"{'+' if w >= 0 else '-'}{abs(w):.4f}*{c}" for c, w in zip(self.columns, self.coefficients))


def _model(m: Moments, columns: Sequence[str], weights: np.ndarray) -> LinearModel:
    """The model with these weights and the intercept through the means; r2 is 1 minus unexplained over whole spread of y."""
    inner, beside, own = m.cross[:-1, :-1], m.cross[:-1, -1], m.cross[-1, -1]
    left = own - 2 * weights @ beside + weights @ inner @ weights
    return LinearModel(tuple(columns), float(m.mean[-1] - m.mean[:-1] @ weights), weights, m.n, float(1 - left / own) if own > 0 else math.nan)


def ridge_regression(df: DataFrame, columns: Sequence[str], target: str, penalty: float = 0.0, given: Moments | None = None) -> LinearModel:
    """Least squares on several columns; ``penalty`` times the squared weights of the standardised columns, per row, is added.

    Without a penalty this is plain linear regression. Constant columns and columns that depend on others get weight 0 (see
    ``pivoted_solve``). Rows with a missing number take no part; without rows all weights are 0 and r2 is not a number."""
    m = given or moments(df, [*columns, target])
    scale = np.where(m.spread[:-1] > 0, m.spread[:-1], 1.0)
    inner = m.covariance[:-1, :-1] / np.outer(scale, scale)
    inner = inner + penalty * np.diag(inner.diagonal() > 0)
    weights, _ = pivoted_solve(inner, m.covariance[:-1, -1] / scale)
    return _model(m, columns, weights / scale)


def partial_least_squares(df: DataFrame, columns: Sequence[str], target: str, components: int, given: Moments | None = None) -> LinearModel:
    """Regression on ``components`` directions of the standardised columns, each chosen for its covariance with what is left of the target.

    A direction's scores are never formed: its loadings and the deflation follow from the cross products, so no further pass over the
    rows is needed. It ends early when nothing of the target is left to covary with."""
    m = given or moments(df, [*columns, target])
    d = len(columns)
    scale = np.where(m.spread[:-1] > 0, m.spread[:-1], 1.0)
    whole = m.covariance[:-1, :-1] / np.outer(scale, scale)
    toward = m.covariance[:-1, -1] / scale
    start = float(np.linalg.norm(toward))
    weights, loadings, slopes = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros(0)
    left = whole.copy()
    for _ in range(min(components, d)):
        length = float(np.linalg.norm(toward))
        if length <= DEPENDENT * start or start == 0:
            break
        w = toward / length
        size = float(w @ left @ w)
        if size <= DEPENDENT:
            break
        p, q = left @ w / size, float(toward @ w) / size
        left = left - size * np.outer(p, p)
        toward = toward - size * q * p
        weights, loadings, slopes = np.column_stack([weights, w]), np.column_stack([loadings, p]), np.append(slopes, q)
    total = weights @ np.linalg.solve(loadings.T @ weights, slopes) if len(slopes) else np.zeros(d)
    return _model(m, columns, total / scale)


# --- factors ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Factors:
    columns: tuple[str, ...]
    loadings: np.ndarray  # a row per column, a column per factor
    communalities: np.ndarray
    rounds: int


def varimax(loadings: np.ndarray, rounds: int = 200, still: float = 1e-12) -> np.ndarray:
    """Loadings turned, two factors at a time, to the largest variance of their squares within each factor."""
    out = loadings.copy()
    for _ in range(rounds):
        turned = 0.0
        for a in range(out.shape[1]):
            for b in range(a):
                x, y = out[:, b].copy(), out[:, a].copy()
                u, v = x * x - y * y, 2 * x * y
                top = 2 * (u @ v) - 2 * u.sum() * v.sum() / len(u)
                under = (u @ u - v @ v) - (u.sum() ** 2 - v.sum() ** 2) / len(u)
                angle = math.atan2(top, under) / 4
                out[:, b], out[:, a] = x * math.cos(angle) + y * math.sin(angle), y * math.cos(angle) - x * math.sin(angle)
                turned = max(turned, abs(angle))
        if turned < still:
            break
    return out


def factor_analysis(
    df: DataFrame, columns: Sequence[str], factors: int, rounds: int = 500, still: float = 1e-10, rotate: bool = True, given: Moments | None = None,
) -> Factors:
    """Principal-axis factors of the correlation matrix, rotated by ``varimax``.

    Communalities start at the squared multiple correlation of each column with the others and are replaced by the sums of squared
    loadings until they stand still or ``rounds`` have passed; one that would pass 1 is held there. Constant columns load on nothing."""
    m = given or moments(df, columns)
    r = m.correlation
    varies = m.spread > 0
    shared = np.zeros(len(columns))
    for i in np.flatnonzero(varies):
        others = [k for k in range(len(columns)) if k != i]
        weights, _ = pivoted_solve(r[np.ix_(others, others)], r[others, i])
        shared[i] = min(1.0, max(0.0, float(weights @ r[others, i])))
    made, loadings = 0, np.zeros((len(columns), factors))
    for made in range(1, rounds + 1):
        reduced = r.copy()
        np.fill_diagonal(reduced, shared)
        values, axes = np.linalg.eigh(reduced)
        loadings = axes[:, ::-1][:, :factors] * np.sqrt(np.maximum(0.0, values[::-1][:factors]))
        now = np.minimum(1.0, (loadings ** 2).sum(axis=1)) * varies
        moved, shared = float(np.abs(now - shared).max(initial=0.0)), now
        if moved < still:
            break
    turned = varimax(loadings) if rotate and factors > 1 else loadings
    turned = turned[:, np.argsort(-(turned ** 2).sum(axis=0).round(12), kind="stable")]
    return Factors(tuple(columns), _signed(turned), shared, made)
