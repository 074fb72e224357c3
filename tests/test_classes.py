"""Classification, order and clusters on data with a known answer; refits of several series."""

import numpy as np
import pytest

from terracause.operators import holdout as H
from terracause.operators import landcover as N
from terracause.operators import solvers as S

FEATURES = ["f0", "f1", "f2"]


def samples(spark, n=240, seed=2):
    """Three classes that f0 and f1 tell apart; f2 is noise, and some f0 are missing."""
    rng = np.random.default_rng(seed)
    k = np.arange(n) % 3
    x = np.stack([np.array([0.0, 3.0, 0.0])[k], np.array([0.0, 0.0, 3.0])[k], np.zeros(n)], axis=1) + rng.normal(0, 0.4, (n, 3))
    rows = [(i // 20, i % 20, int(k[i]), f"b{i // 12}", None if i % 40 == 7 else float(x[i, 0]), float(x[i, 1]), float(x[i, 2])) for i in range(n)]
    return spark.createDataFrame(rows, "row int, col int, k int, block string, f0 double, f1 double, f2 double")


@pytest.mark.parametrize("kind", ["forest", "logistic"])
def test_held_out_blocks_are_told_apart(spark, kind):
    df = samples(spark)
    out = N.spatial_cv(df.join(N.spatial_folds(df, "k", "block", 3), "block"), FEATURES, "k", "fold", kind)
    m = N.confusion_metrics(out, "truth", "guess").first()
    assert m.n == 240 and m.accuracy > 0.93 and m.macro_f1 > 0.93
    assert {r.majority for r in out.select("majority").distinct().collect()} <= {0, 1, 2}


@pytest.mark.parametrize("kind", ["forest", "logistic"])
def test_noise_matters_least(spark, kind):
    got = {r.feature: r.importance for r in N.feature_importance(samples(spark), FEATURES, "k", kind).collect()}
    assert got["f2"] < 0.2 * min(got["f0"], got["f1"])
    if kind == "forest":
        assert sum(got.values()) == pytest.approx(1.0)


def test_order_along_the_first_component(spark):
    rng = np.random.default_rng(0)
    along = rng.normal(0, 3, 60)
    x = along[:, None] * np.array([-0.8, -0.6]) + rng.normal(0, 0.1, (60, 2))
    df = spark.createDataFrame([(i, 0, *map(float, v)) for i, v in enumerate(x)], "row int, col int, a double, b double")
    got = np.array([r.score for r in N.graph_order(df, ["a", "b"]).orderBy("row").collect()])
    u = np.linalg.svd(x - x.mean(0))[2][0]
    want = x @ (u * np.sign(u[np.abs(u).argmax()]))
    assert got == pytest.approx(want, abs=1e-9)


def test_clusters_apart(spark):
    rng = np.random.default_rng(1)
    k = np.arange(90) % 3
    x = np.array([[0, 0], [8, 0], [0, 9]])[k] + rng.normal(0, 0.3, (90, 2))
    df = spark.createDataFrame([(i, int(k[i]), *map(float, v)) for i, v in enumerate(x)], "row int, k int, a double, b double")
    out, score = N.graph_cluster(df, ["a", "b"], 3)
    pairs = {(r.k, r.cluster) for r in out.collect()}
    assert len(pairs) == 3 and len({c for _, c in pairs}) == 3 and score > 0.9


def test_refit_of_two_series_and_two_lags(spark):
    rng, x = np.random.default_rng(3), np.zeros((150, 2))
    for t in range(2, 150):
        x[t] = np.array([[0.4, 0.2], [-0.3, 0.5]]) @ x[t - 1] + np.array([[0.1, 0], [0, -0.2]]) @ x[t - 2] + rng.normal(size=2)
    df = spark.createDataFrame([(0, 0, 1990 + i // 12, i % 12 + 1, *map(float, v)) for i, v in enumerate(x)], "row int, col int, year int, month int, a double, b double")
    got = {(r.lag, r.parent, r.child): r.weight for r in S.var_refit(df, ["a", "b"], 2).collect()}
    c = x - x.mean(0)
    want = np.linalg.lstsq(np.concatenate([c[1:-1], c[:-2]], axis=1), c[2:], rcond=None)[0]
    for i, (lag, p) in enumerate((lag, p) for lag in (1, 2) for p in "ab"):
        for j, child in enumerate("ab"):
            assert got[lag, p, child] == pytest.approx(want[i, j])


def test_unknown_parents_are_refused(spark):
    panel = spark.createDataFrame([(0, 0, 2000, 1, 1.0, 2.0)], "row int, col int, year int, month int, a double, y double")
    edges = spark.createDataFrame([(0, 0, "z", 1.0)], "row int, col int, parent string, weight double")
    with pytest.raises(ValueError, match="doesn't have: z"):
        H.predict_level(panel, edges, "y", 1999)
