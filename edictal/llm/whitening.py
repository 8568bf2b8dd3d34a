"""Whitening of embeddings: rows become uncorrelated, with variance 1, along the eigenvectors of their covariance.

Entries are whole numbers.  Every distinct row is counted once; the covariance of whole numbers about a whole centre is a sum of whole
products, so tasks add up to the same matrix, to the last bit, however the rows are dealt.  What the centre lacks to the mean is a
correction of rank one.

The matrix, dimensions squared at any number of rows, is decomposed by refinement (Ogita and Aishima): eigenvectors in single precision
are corrected by products of matrices in higher precision, each step about doubling the digits.  Where eigenvalues lie so close together
that their vectors cannot be told apart at the accuracy reached, the matrix is compressed to the space they span, less their mean, and
that small problem is solved by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edictal.llm.common import trimmed
from edictal.session import stage

# Fixed values of the contract: entries are read as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
# Entries are read as no further from 0 than this, so that no sum of theirs overflows.
FURTHEST = float(1 << 19)
COMPONENTS = 16
# Rows of one product, and the largest whole numbers that a double holds exactly and that a sum may reach.
BLOCK, EXACT, LARGEST = 512, 1 << 53, 1 << 62
STEPS = 12


@dataclass
class Model:
    """n distinct rows with the sums of their entries; eigenvalues, falling, and vectors as columns; the trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None


def whole_numbers(rows: DataFrame, vector_col: str, columns: list[Column]) -> DataFrame:
    """``columns`` as __keep beside __x, the entries as whole numbers, of rows whose vector is not null and has only finite entries."""
    finite = lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  not so for NaN
    number = lambda v: F.floor(SCALE * F.least(F.greatest(v.cast("double"), F.lit(-FURTHEST)), F.lit(FURTHEST))).cast("long") + SHIFT
    fit = rows.filter(F.coalesce(F.forall(vector_col, finite), F.lit(False)))
    return fit.select(F.struct(*columns).alias("__keep"), F.transform(vector_col, number).alias("__x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of the distinct rows and the sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([batch.num_rows] * d), pa.array(matrix(batch.column(0), d).sum(axis=0))], names=["i", "n", "s"])

    # One row for each dimension reaches the driver.
    summed = fit.mapInArrow(trimmed(run), "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r.i: int(r.s) for r in summed}
    return summed[0].n, [sums[i] for i in range(d)]


def products(fit: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sums of the products of any two entries less their centre, exact."""
    d = len(centre)
    shared = fit.sparkSession.sparkContext.broadcast(centre)
    i, j = np.triu_indices(d)

    def row(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros((d, d), np.int64), 0
        for batch in batches:
            x = matrix(batch.column(0), d) - shared.value
            peak = int(np.abs(x).max(initial=0)) ** 2
            for k in range(0, len(x), BLOCK):
                if most + peak * BLOCK > LARGEST:
                    yield row(total)
                    total, most = np.zeros((d, d), np.int64), 0
                part = x[k : k + BLOCK]
                if peak * BLOCK < EXACT:
                    part = part.astype(np.float64)
                total += (part.T @ part).astype(np.int64)
                most += peak * BLOCK
        yield row(total)

    # One sum for each pair of dimensions reaches the driver.
    summed = fit.mapInArrow(trimmed(run), "i int, j int, s long").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = np.zeros((d, d), object)
    for r in summed:
        out[r.i, r.j] = out[r.j, r.i] = int(r.s)
    return out


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the distinct rows, divisor n, each entry rounded once to the precision of long double."""
    centre = [s // n for s in sums]
    rest = np.array([s - n * c for s, c in zip(sums, centre, strict=True)], object)
    # n * n * V is a whole number.
    scaled = n * products(fit, np.array(centre, np.int64)) - np.outer(rest, rest)
    return np.array([[long_double(v, n * n) for v in row] for row in scaled], np.longdouble).reshape(len(sums), len(sums))


def long_double(above: int, below: int) -> np.longdouble:
    """A quotient of whole numbers as a double and what the double lacks."""
    near = above / below
    p, q = near.as_integer_ratio()
    return np.longdouble(near) + np.longdouble((above * q - p * below) / (below * q))


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, from single precision on by refinement."""
    d = len(v)
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    a = np.asarray(v, np.longdouble)
    size = np.abs(a).max()
    if not size:
        return np.zeros(d), np.eye(d)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    solved: set[frozenset[int]] = set()
    for _ in range(STEPS):
        x, step, clusters = refined(a, x)
        fresh = [c for c in clusters if frozenset(c) not in solved]
        for cluster in fresh:
            # Vectors of a cluster span the right space by now; inside it the small problem tells them apart.
            x[:, cluster] = x[:, cluster] @ within(a, x[:, cluster])
            solved.add(frozenset(cluster))
        if not fresh and step < 1e-17 * d:
            break
    for _ in range(2):  # unit length and right angles, to the last digit
        x = x @ (3 * np.eye(d) - x.T @ x) / 2
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, list[list[int]]]:
    """One correction of approximate eigenvectors: the new ones, the size of the step, and clusters it could not separate."""
    d = len(a)
    r = np.eye(d) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    # Eigenvalues nearer than this are not told apart by what the vectors give now, or by a double at all.
    near = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64), 2) + np.linalg.norm(a.astype(np.float64), 2) * np.linalg.norm(r.astype(np.float64), 2))
    near = max(near, d * np.finfo(np.float64).eps * np.abs(values).max())
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(values)
    clusters, last = [], None
    for k in order.tolist():
        if last is not None and values[k] - values[last] <= near:
            if clusters and clusters[-1][-1] == last:
                clusters[-1].append(k)
            else:
                clusters.append([last, k])
        last = k
    return x + x @ e, float(np.abs(e).max()), clusters


def within(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How the vectors of a cluster have to be combined: eigenvectors of the matrix on their span, less its mean eigenvalue."""
    mean = (x * (a @ x)).sum() / (x * x).sum()
    small = x.T @ (a @ x - mean * x)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    return np.linalg.eigh((small / size if size else small).astype(np.float64))[1].astype(np.longdouble)


def projected(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, exact, and the rows whitened: x - S / n on every component, over the root of its eigenvalue; NaN where that is 0."""
    off = model.n * x - model.sums
    with np.errstate(divide="ignore", invalid="ignore"):
        return off, np.where(model.values > 0, (off / model.n) @ model.vectors / np.sqrt(model.values), np.nan)


def identity_error(fit: DataFrame, model: Model) -> float | None:
    """Largest entry of the covariance of the whitened distinct rows, less the identity; of components that have a variance."""
    k = int((model.values > 0).sum())
    if not k:
        return None
    shared = fit.sparkSession.sparkContext.broadcast(model)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = projected(matrix(batch.column(0), len(shared.value.sums)), shared.value)[1][:, :k]
            total += w.T @ w
            sums += w.sum(axis=0)
        first = np.concatenate([i, np.full(k, -1)])
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(np.concatenate([j, np.arange(k)]), pa.int32()), pa.array(np.concatenate([total[i, j], sums]))], names=["i", "j", "s"])

    summed = {(r.i, r.j): r.s / model.n for r in fit.mapInArrow(trimmed(run), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    # Whitened rows are centred already; what rounding leaves of their mean is taken off.
    return max(abs(s - summed[-1, a] * summed[-1, b] - (a == b)) for (a, b), s in summed.items() if a >= 0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model:
    """The model of rows of whole numbers (``whole_numbers``): of every distinct vector once.

    Vectors that are not as long as most (of equally frequent lengths, the longest) are left out here and have no result.  Equal vectors
    of a third of all rows are one row before they are shuffled.  A component without variance, as of one distinct row, has the eigenvalue
    0.  Without rows the model has no components.
    """
    lengths = rows.groupBy(F.size("__x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0].d:
        return Model(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    d = lengths[0].d
    distinct = stage(rows.filter(F.size("__x") == d).select("__x").distinct())
    n, sums = totals(distinct, d)
    v = covariance(distinct, n, sums)
    values, vectors = eigen(v)
    # What rounding leaves of an eigenvalue 0 is none.
    values = np.where(values > d * np.finfo(np.float64).eps * values.max(initial=0), values, 0)
    model = Model(n, np.array(sums, np.int64), values[:components], vectors[:, :components], float(np.trace(v)))
    model.identity_error = identity_error(distinct, model)
    return model


def square_sums(off: np.ndarray) -> list[Decimal]:
    """The sum of squares of every row, exact: products of halves, themselves summed by halves."""

    def total(part: np.ndarray) -> list[int]:
        return [(a << 32) + b for a, b in zip((part >> 32).sum(axis=1).tolist(), (part & 0xFFFFFFFF).sum(axis=1).tolist(), strict=True)]

    high, low = off >> 31, off & 0x7FFFFFFF
    return [Decimal((a << 62) + (b << 32) + c) for a, b, c in zip(total(high * high), total(high * low), total(low * low), strict=True)]


def whiten(rows: DataFrame, model: Model) -> DataFrame:
    """The columns kept of every row of whole numbers, once for each component: component (from 1), n, deviation, whitened, explained,
    identity_error.

    ``deviation`` is the sum over the dimensions of (n x - S) ** 2, exact.  ``whitened`` and ``explained`` of a component without variance
    are null and 0.  Rows that are repeated, also with equal ids, have each their own result.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    held = rows.filter(F.size("__x") == len(model.sums))
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            m = batch.num_rows
            off, white = projected(matrix(batch.column("__x"), len(model.sums)), model)
            each, flat = pa.array(np.repeat(np.arange(m), k)), white.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__keep").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(square_sums(off), pa.decimal128(38, 0)).take(each), pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(model.values / model.trace if model.trace else model.values, m)), pa.array([model.identity_error] * (m * k), pa.float64()),
                ],
                names=["__keep", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    added = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.DecimalType(38, 0)), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([held.schema["__keep"], *[T.StructField(n, t) for n, t in added]])
    return held.mapInArrow(trimmed(run), schema).select("__keep.*", *[n for n, _ in added])
