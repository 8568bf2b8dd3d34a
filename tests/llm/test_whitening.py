"""Whitening beside exact sums and numpy's own decomposition."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from edictal.llm import whitening as W
from edictal.llm.queries import QUERIES


def spectrum(values, seed=0):
    """A symmetric matrix with these eigenvalues."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    return (q * np.array(values, np.longdouble)) @ q.T


@pytest.mark.parametrize("values", [
    [5.0], [3, 2, 1], np.geomspace(1, 1e-6, 20), [4] * 6, [4, 4, 4, 1, 1, 0], [4, 4 - 1e-9, 4 - 2e-9, 1, 1 + 1e-12, 0.5], [1 + k * 1e-8 for k in range(12)],
    [1, 1, 1 + 1e-13, 1 - 1e-10, 2, 2 + 1e-7], [0.0, 0.0], np.linspace(1, 2, 64),
])
def test_eigenvectors(values):
    v = spectrum(values)
    found, x = W.eigen(v)
    assert np.allclose(found, np.sort(np.array(values, float))[::-1], rtol=0, atol=1e-15 * max(values) * 4)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14
    assert np.abs(np.asarray(v @ x - x * found, float)).max() <= 1e-14 * max(values)


def test_close_eigenvalues_are_told_apart():
    """Vectors of eigenvalues 1e-9 apart, which double precision alone finds to seven digits."""
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (np.eye(6) * 3 - q.T @ q) / 2
    values = np.array([2, 1 + 2e-9, 1 + 1e-9, 1, 0.5, 0.25], np.longdouble)
    x = W.eigen((q * values) @ q.T)[1]
    assert np.abs(np.abs((q * x).sum(axis=0).astype(float)) - 1).max() < 1e-15
    assert max(min(np.abs(x[:, k] - s * q[:, k].astype(float)).max() for s in (1, -1)) for k in range(6)) < 1e-9


def test_exact_quotients_and_squares():
    assert W.long_double(10**40 + 1, 3 * 10**39) == np.longdouble(10**40 + 1) / np.longdouble(3 * 10**39)
    rng = np.random.default_rng(2)
    off = rng.integers(-(1 << 57), 1 << 57, (5, 64))
    assert [int(d) for d in W.square_sums(off)] == [sum(int(v) ** 2 for v in r) for r in off]


def whole(v):
    return [int(np.floor(64 * np.float64(min(max(np.float64(c), -W.FURTHEST), W.FURTHEST)))) + 1_000_000 for c in v]


def held(rows):
    return [(i, whole(v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def plain(kept):
    """Distinct rows, their sums, and the exact covariance, rounded at the end."""
    distinct = [list(x) for x in sorted({tuple(x) for _, x in kept})]
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[k] for x in distinct) for k in range(d)]
    off = [[n * a - s for a, s in zip(x, sums, strict=True)] for x in distinct]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    return n, sums, v, off


def compare(got, rows, components=16):
    kept = held(rows)
    n, sums, v, off = plain(kept)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(sums))
    assert len(got) == len(kept) * k
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r)
    white = []
    for i, x in kept:
        row = by_row[i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))]
        mine = [row[c].pop() if len(row[c]) > 1 else row[c][0] for c in range(1, k + 1)]
        assert {r.n for r in mine} == {n} and {r.component for r in mine} == set(range(1, k + 1))
        white.append([r.whitened for r in mine])
        for c, r in enumerate(mine):
            assert abs(r.explained - values[c] / np.trace(v)) < 1e-9
    want = (np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in kept]) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    sign = np.sign((want * np.array(white)).sum(axis=0))
    assert np.abs(want * sign - np.array(white)).max() < 1e-7
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def some_rows(rng, n, d):
    rows = [(i, (rng.normal(size=d) * np.linspace(3, 0.5, d) + 7).astype(np.float32).tolist()) for i in range(n)]
    return rows + [rows[0], rows[0], (None, rows[1][1]), (n, None), (n + 1, [None] + rows[2][1][1:]), (n + 2, [float("nan")] + rows[2][1][1:]), (n + 3, [float("-inf")] * d), (n + 4, rows[3][1]), (n + 5, []), (n + 6, [1.0])]


def run(df, components=16):
    rows = W.whole_numbers(df, "embedding", [F.col("vec_id"), F.col("n").alias("kept_n")])
    model = W.fit(rows, components)
    return W.whiten(rows, model).select("vec_id", "component", F.expr("n"), "deviation", "whitened", "explained", "identity_error").collect()


def test_rows(frame, ready, tmp_path):
    rng = np.random.default_rng(3)
    rows = some_rows(rng, 90, 20)
    df = frame(rows, "vec_id long, embedding array<float>").repartition(5)
    short = [r for r in rows if r[1] is None or len(r[1]) == 20]
    compare(run(df), short)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op11_whitening"](ready, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(got.collect(), short)


def test_few_dimensions_and_far_entries(frame):
    rng = np.random.default_rng(4)
    rows = some_rows(rng, 40, 3)[:43]
    compare(run(frame(rows, "vec_id long, embedding array<double>"), components=2), rows, components=2)
    far = [(i, [1e300 * (-1) ** i, float(i), float(i * i)]) for i in range(600)]
    compare(run(frame(far, "vec_id long, embedding array<double>")), far)


def test_without_variance_and_without_rows(frame):
    got = run(frame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    assert len(got) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 and r.identity_error is None for r in got)
    flat = run(frame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>"))
    assert sorted((r.component, r.whitened is None) for r in flat) == [(1, False)] * 5 + [(2, True)] * 5 and flat[0].identity_error < 1e-12
    assert run(frame([], "vec_id long, embedding array<float>")) == [] and run(frame([(1, None), (2, [])], "vec_id long, embedding array<float>")) == []


def test_sums_do_not_depend_on_dealing(frame):
    rng = np.random.default_rng(5)
    df = frame(some_rows(rng, 50, 6)[:50], "vec_id long, embedding array<float>")
    told = []
    for parts in (1, 7):
        m = W.fit(W.whole_numbers(df.repartition(parts), "embedding", [F.col("vec_id")]))
        told.append((m.n, m.sums.tolist(), m.values.tolist(), m.vectors.tolist()))
    assert told[0] == told[1]
