"""Operator 12: whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become integers x = floor(64 c) + 1,000,000. The fit list is each distinct vector
once. Its sums are exact; its scatter is added up from rows that are centred first, as one
matrix a partition, and those meet entry by entry. The covariance is factored by Cholesky
with the largest remaining diagonal entry as pivot; then pairs of columns of the triangular
factor are rotated until all are orthogonal (one-sided Jacobi). The squared norms of the
rotated columns are the eigenvalues, the columns divided by their norms the eigenvectors:
the covariance itself is never rotated, so small eigenvalues keep their digits.

Bounds: the driver and each task hold matrices of the dimensions squared; rows are read in
batches. The matrix of a partition counts as d (d + 1) / 2 rows behind the shuffle.

Defined cases: rows whose vector is null or holds null or non-finite entries take no part;
shorter vectors are filled up with zeros; entries are kept within 2**40 after scaling; a
null id stays null; repeated rows each have their rows. Components without variance (their
pivot is below ``SMALL`` of the largest) don't exist: equal vectors alone, or one row, give
no rows, as an empty table does. A deviation that fits no long is null. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracause.llm.shared import cut

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LIMIT = 1 << 40
SMALL = 1e-13
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def pivoted_cholesky(v: np.ndarray, small: float = SMALL) -> np.ndarray:
    """L (dimensions x rank) with L L' = v: rows stand in v's order, and in the order of their pivots the factor is lower triangular."""
    d = len(v)
    rest, factor = np.diag(v).astype(float).copy(), np.zeros((d, d))
    first = rest.max(initial=0.0)
    for k in range(d):
        p = int(rest.argmax())
        if rest[p] <= small * first or rest[p] <= 0:
            return factor[:, :k]
        column = (v[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(rest[p])
        column[rest == -np.inf] = 0
        factor[:, k] = column
        rest = rest - column * column
        rest[p] = -np.inf
    return factor


def one_sided_jacobi(factor: np.ndarray, most: int = 60) -> np.ndarray:
    """The factor's columns after rotations that make all of them orthogonal, longest first.

    A sweep takes all pairs of columns as a round of a tournament: pairs of a round are disjoint and rotate together.
    """
    a = factor.T.copy()
    k = len(a)
    seats = np.arange(k + k % 2)
    for _ in range(most):
        largest = 0.0
        for _ in range(len(seats) - 1):
            left, right = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            here = (left < k) & (right < k)
            p, q = left[here], right[here]
            alpha, beta, gamma = (a[p] * a[p]).sum(1), (a[q] * a[q]).sum(1), (a[p] * a[q]).sum(1)
            size = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > 1e-15 * size
            largest = max(largest, float((np.abs(gamma[turn]) / size[turn]).max(initial=0.0)))
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if largest <= 1e-15:
            break
    return a[np.argsort(-(a * a).sum(1), kind="stable")].T


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors as columns, of a covariance; its null space has none."""
    turned = one_sided_jacobi(pivoted_cholesky(v))
    norms = np.sqrt((turned * turned).sum(0))
    vectors = turned / norms
    # one sign for good: the largest entry is positive
    top = np.abs(vectors).argmax(0)
    return norms * norms, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def whole_numbers(df: DataFrame, vector: str = "embedding", extra: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``extra`` and x, the integer entries less ``SHIFT``, of the rows that take part."""
    v = F.col(vector)
    good = df.where(v.isNotNull()).select(*extra, F.transform(v, lambda c: c.cast("double")).alias("x"))
    good = good.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    wide = good.agg(F.max(F.size("x"))).first()[0] or 0
    near = lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * SCALE))).cast("long")
    return good.select(*extra, F.concat(F.transform("x", near), F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("x"))).alias("x"))


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of a partition, one row a dimension."""
    total = None
    for b in batches:
        if b.num_rows:
            part = rows_of(b.column(0)).sum(0).astype(object)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "total"])


class Fit:
    """Mean and components of a fit list."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        # x - S / n = (x - low) - rest / n with whole numbers low and rest
        self.low, self.rest = (np.array(a, np.int64) for a in zip(*[divmod(s, n) for s in sums], strict=True)) if sums else (np.zeros(0, np.int64),) * 2
        self.values, self.vectors, self.trace = np.zeros(0), np.zeros((len(sums), 0)), 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2 as exact longs; null where one fits no long."""
        about = (((x - self.low) * float(self.n) - self.rest) ** 2).sum(1)
        fits = about < 9.2e18
        whole = np.where(fits[:, None], (x - self.low) * self.n - self.rest, 0)
        return pa.array((whole * whole).sum(1), mask=~fits)


def _gram(of):
    """The sum over a partition of the outer products of ``of`` each row: upper triangle, and their sums as line -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = line = None
        for b in batches:
            if b.num_rows:
                w = of(rows_of(b.column(0)))
                total, line = (w.T @ w, w.sum(0)) if total is None else (total + w.T @ w, line + w.sum(0))
        if total is not None and len(line):
            i, j = np.triu_indices(len(line))
            d = np.arange(len(line))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.full(len(d), -1)).astype(np.int32)), pa.array(np.append(j, d).astype(np.int32)), pa.array(np.append(total[i, j], line))], ["i", "j", "v"])

    return run


def _matrix(lists: DataFrame, of, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of outer products, and sum, of ``of`` every row; size (size + 3) / 2 rows reach the driver."""
    g, line = np.zeros((size, size)), np.zeros(size)
    for r in lists.select("x").mapInArrow(_gram(of), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r.i < 0:
            line[r.j] = r.v
        else:
            g[r.i, r.j] = g[r.j, r.i] = r.v
    return g, line


def fit(distinct: DataFrame, components: int = COMPONENTS) -> tuple[Fit, float]:
    """Components of the rows ``x``, each of which counts once, and the largest entry of the whitened covariance less the identity."""
    n = distinct.count()
    sums = {r.i: int(r.total) for r in distinct.select("x").mapInArrow(_sums, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()}
    model = Fit(n, [sums[i] for i in range(len(sums))])
    if not sums:
        return model, 0.0
    spark = distinct.sparkSession
    held = spark.sparkContext.broadcast(model)
    # rows are centred before they are multiplied
    v = _matrix(distinct, lambda x: held.value.centred(x), len(sums))[0] / n
    values, vectors = principal(v)
    model.values, model.vectors, model.trace = values[:components], vectors[:, :components], float(np.trace(v))
    k = len(model.values)
    if not k:
        return model, 0.0
    again = spark.sparkContext.broadcast(model)
    g, line = _matrix(distinct, lambda x: again.value.whitened(x), k)
    return model, float(np.abs(g / n - np.outer(line, line) / n / n - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each row's whitened value for each component, with the component's share of variance and the fit's error."""
    spark = df.sparkSession
    rows = cut(whole_numbers(df.withColumn("vec_id", F.col("vec_id").cast("long"))), "op12-rows")
    model, error = fit(cut(rows.select("x").distinct(), "op12-distinct"), components)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.values)
        for b in batches:
            if b.num_rows and k:
                x = rows_of(b.column(1))
                row = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [b.column(0).take(row), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, m.n), m.deviations(x).take(row), m.whitened(x).ravel(), np.tile(m.values / m.trace, len(x)), np.full(len(x) * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)
