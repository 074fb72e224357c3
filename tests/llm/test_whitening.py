"""Operator 12 against exact sums and an eigensolver."""

import math

import numpy as np
import pytest

from terracause.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_factor_and_rotations(d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(300, d)) * np.geomspace(1, 1e-4, d)
    v = x.T @ x / 300
    factor = whitening.pivoted_cholesky(v)
    np.testing.assert_allclose(factor @ factor.T, v, atol=1e-14 * v.max())
    pivots = np.argsort([np.flatnonzero(row)[-1] if row.any() else 0 for row in factor])
    assert np.allclose(np.triu(factor[pivots], 1), 0)
    values, vectors = whitening.principal(v)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-8)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    np.testing.assert_allclose(v @ vectors, vectors * values, atol=1e-14 * v.max())


def test_small_eigenvalues_keep_their_digits():
    """A graded diagonal matrix turned little: the smallest value is right to many digits."""
    v = np.diag([1.0, 1e-6, 1e-12])
    assert whitening.principal(v)[0] == pytest.approx([1.0, 1e-6, 1e-12], rel=1e-12)


def test_null_space_has_no_components():
    v = np.ones((4, 4))
    values, vectors = whitening.principal(v)
    assert values == pytest.approx([4.0]) and vectors[:, 0] == pytest.approx([0.5] * 4)
    assert whitening.principal(np.zeros((3, 3)))[0].size == 0


def expected(rows):
    wide = max(len(x) for _, x, _ in rows if x is not None and all(c is not None and math.isfinite(c) for c in x))
    good = [(v, [math.floor(64 * c) + 1_000_000 for c in [*x, *[0.0] * (wide - len(x))]]) for v, x, _ in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return good, n, sums, e[::-1], u[:, ::-1]


def test_rows_against_an_eigensolver(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (150, 20)) * np.linspace(2, 0.2, 20)
    rows = [(i, list(map(float, x)), 0) for i, x in enumerate(base)]
    rows += [(500 + i, rows[3][1], 0) for i in range(60)]  # copies count once
    rows += [(700, None, 0), (701, [float("nan")] * 20, 0), (702, [float("inf"), *[0.0] * 19], 0), (703, [None] * 20, 0), (704, [0.5] * 7, 0), (None, rows[5][1], 0), (3, rows[3][1], 0)]
    good, n, sums, e, u = expected(rows)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == 16 * len(good) and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-10
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    sign = None
    for v, x in good:
        mine = sorted(by[v], key=lambda r: r.component)[:: len(by[v]) // 16]
        assert [r.component for r in mine] == list(range(1, 17))
        assert {r.deviation for r in mine} == {sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))}
        want = (np.array(x) - np.array(sums) / n) @ u[:, :16] / np.sqrt(e[:16])
        found = np.array([r.whitened for r in mine])
        sign = np.sign(found * want) if sign is None else sign
        np.testing.assert_allclose(found * sign, want, atol=1e-8)
        np.testing.assert_allclose([r.explained for r in mine], e[:16] / e.sum(), rtol=1e-10)


def test_small_tables(spark):
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert run([]) == [] and run([(1, None, 0)]) == [] and run([(1, [], 0)]) == []
    assert run([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)]) == []
    two = run([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)])
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in two) == [(1, 1, 2, 64 * 64, 1.0, 1.0), (2, 1, 2, 64 * 64, 1.0, 1.0)]
    assert len({r.whitened for r in two}) == 2


def test_large_entries(spark):
    rows = [(i, [float(s) * 10.0**e, 0.1 * i], 0) for i, (s, e) in enumerate([(1, 300), (-1, 300), (1, 3), (0, 0)])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "x")).collect()
    assert {r.vec_id: r.deviation is None for r in got} == {0: True, 1: True, 2: False, 3: False}
    assert all(math.isfinite(r.whitened) for r in got)
