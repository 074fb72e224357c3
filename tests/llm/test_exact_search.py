"""Operator 11 against brute force: clusters, ties, equal vectors, crowded annuli, shared ids, awkward vectors."""

import math

import numpy as np
import pytest

from terracause.llm import pivotindex

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=20):
    good = [(i, v, [max(-(1 << 31), math.floor(64 * c)) for c in x]) for i, (v, x, _) in enumerate(rows) if v is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, q, x in good:
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), v, j) for j, v, y in good if j != i)[:k]
            out += [(q, n + 1, v, -s) for n, (s, v, _) in enumerate(near)]
    return sorted(out)


def run(spark, rows, **sizes):
    df = pivotindex.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()))


def clustered(n=400, dims=6, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, dims))
    x = centres[rng.integers(0, 9, n)] + rng.normal(0, 0.05, (n, dims))
    return [(i, list(map(float, v)), 0) for i, v in enumerate(x)]


def test_many_annuli_blocks_and_groups(spark):
    """Small sizes: many rounds, several blocks an annulus, several groups of queries."""
    rows = clustered()
    assert run(spark, rows, annulus_rows=10, block_rows=4, group_rows=5) == brute(rows)


def test_annuli_are_pruned():
    """On clusters most annuli can't reach the 21st best score, and none that can is left out."""
    x = np.floor(64 * np.array([r[1] for r in clustered(2000)])).astype(float)
    square = float((x * x).sum(1).max())
    index = pivotindex.plan(x, len(x), square, 20)
    key, d = index.key(x)
    index.annuli = np.unique(key)
    index.near, index.far = (np.array([f(d[key == a], axis=0) for a in index.annuli]) for f in (np.min, np.max))
    score = x[::20] @ x.T
    bound = np.sort(score, axis=1)[:, -21]
    asked = index.reach(x[::20]) >= bound[:, None]
    holds = np.array([[(score[q, key == a] >= bound[q]).any() for a in index.annuli] for q in range(len(bound))])
    assert not (holds & ~asked).any()
    assert asked.mean() < 0.5 and len(index.annuli) > 50


def test_equal_vectors_and_shared_ids(spark):
    """A third of all rows are one vector, which also asks often; ids repeat; all scores tie."""
    hot = [0.5, -0.25, 1.0]
    rows = [(i, hot if i % 3 == 0 else [i % 5 / 8, 0.1, 0.3], 0) for i in range(240)] + [(40, hot, 0), (40, [1.0, 1.0, 1.0], 0), (60, hot, 0)]
    assert run(spark, rows, annulus_rows=16, block_rows=8, group_rows=4) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.3, -0.7], 0), (20, [0.0, 0.0], 0), (1, None, 0), (2, [nan, 1.0], 0), (3, [inf, 1.0], 0), (4, [None, 1.0], 0), (None, [1.0, 1.0], 0), (5, [1.0], 0), (6, [], 0), (40, [], 0), (7, [2.0, 0.01], 0), (-20, [-0.01, 3.0], 0)]
    assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0], 0)]) == []
    assert run(spark, [(0, [], 0), (1, [], 0)]) == [(0, 1, 1, 0)]
    assert run(spark, [(1, [1.0], 0), (2, [2.0], 0)]) == []


@pytest.mark.parametrize("size", [1e3, 1e6, 1e300])
def test_large_components_are_exact(spark, size):
    """Sums beyond what doubles hold exactly; components beyond the bound are kept at it."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.integers(-1000, 1000, 4) / 1000 * size], 0) for i in range(45)]
    most = min((1 << 31) - 1, math.isqrt(((1 << 63) - 1) // 4))
    kept = [(v, [max(-most, min(most, math.floor(64 * c))) / 64 for c in x], 0) for v, x, _ in rows]
    assert run(spark, rows, annulus_rows=8) == brute(kept)


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(clustered(60), SCHEMA)
    extra = df.withColumns({"x": F.lit(1), "member": F.lit(2), "annulus": F.lit(3), "block": F.lit(0), "grp": F.lit(0), "rank": F.lit(9), "score": F.lit(0)})
    assert sorted(map(tuple, pivotindex.top_k(extra).collect())) == brute(clustered(60))
