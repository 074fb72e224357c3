"""Operator 5 on clustered vectors with many leaves: recall against brute force, and how many rows it compares."""

import numpy as np
import pytest

from terracause.llm import vectortree


def clustered(n=4_000, dims=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(80, dims))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return centres[rng.integers(0, 80, n)] + rng.normal(0, 0.12, (n, dims))


def best(x, q, k=20):
    score = x @ x[q]
    score[q] = -np.inf
    return set(np.argsort(-score, kind="stable")[:k].tolist())


def test_few_leaves_are_enough():
    """Calibrated visits reach the recall on other queries than those of the calibration, with under half of the rows compared."""
    x = clustered()
    square = float((x * x).sum(1).max())
    wide, tree, rng = vectortree.widened(x, square), vectortree.Tree(), np.random.default_rng(1)
    tree.grow(wide, 50, rng)
    visits = vectortree.calibrate(tree, x, square, 20, rng)
    assert tree.leaves > 60
    leaf, hit, compared = tree.assign(wide), [], []
    for q in range(3, len(x), 20):
        seen = np.isin(leaf, tree.visit(np.append(x[q], 0.0), visits))
        hit.append(len(best(x, q) & set(np.flatnonzero(seen).tolist())) / 20)
        compared.append(seen.mean())
    assert np.mean(hit) >= 0.95 and np.mean(compared) < 0.5


@pytest.mark.parametrize("leaf", [40])
def test_recall_of_the_search(spark, monkeypatch, leaf):
    monkeypatch.setattr(vectortree, "LEAF_SAMPLE", leaf)
    x = clustered(1_500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in vectortree.nearest(df).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(by[q] & best(x, q)) / 20 for q in range(0, 1_500, 20)]) >= 0.95


def test_the_wanted_recall_is_above_the_bound():
    assert vectortree.RECALL >= 0.9
