"""Forecasts of anomalies and their baselines against NumPy, pixel by pixel."""

import numpy as np
import pytest

from terracause.operators import holdout as H

PARENTS = {(0, 0): {"a": 0.7}, (0, 1): {"a": 0.4, "b": -0.3}, (1, 0): {"a": 0.2, "b": 0.5, "a_b": -0.6}, (1, 1): {"b": 0.0}}


def given(spark, least_months=7):
    """Seven training years and two to forecast; some values are missing, one month of one pixel has three rows."""
    rng, rows = np.random.default_rng(4), []
    for pixel in PARENTS:
        for year in range(1995, 1995 + least_months + 2):
            for month in range(1, 13):
                a, b, c = rng.normal([10, 200, 3], [2, 30, 1])
                b = 20 * a + rng.normal(0, 0.1)  # nearly the same: the penalty tells
                y = 0.5 * a + 0.02 * b - c + rng.normal()
                if pixel == (0, 0) and month == 3 and year < 1999:
                    continue
                if (year + month) % 11 == 5:
                    b = None
                if (year + 2 * month) % 13 == 4:
                    y = float("nan") if month % 2 else None
                rows.append((*pixel, year, month, a, b, c, y))
    rows = [tuple(None if v is None else v if isinstance(v, int) else float(v) for v in r) for r in rows]
    panel = spark.createDataFrame(rows, "row int, col int, year int, month int, a double, b double, a_b double, y double")
    edges = spark.createDataFrame([(*pixel, p, w) for pixel, ws in PARENTS.items() for p, w in ws.items()], "row int, col int, parent string, weight double")
    return rows, panel, edges


def expected(rows, train_end, least, alpha):
    names, out = ["a", "b", "a_b"], {}
    for pixel, weights in PARENTS.items():
        ps = [p for p, w in weights.items() if w]
        there = [(r[2], r[3], r[7], [r[4 + names.index(p)] for p in ps]) for r in rows if r[:2] == pixel]
        there = [t for t in there if all(v is not None and np.isfinite(v) for v in (t[2], *t[3]))]
        for year, month, y, x in there:
            train = [t for t in there if t[0] <= train_end and t[1] == month]
            if year <= train_end or len(train) < least:
                continue
            ty, tx = np.array([t[2] for t in train]), np.array([t[3] for t in train]).reshape(len(train), len(ps))
            dx = tx - tx.mean(0)
            # the penalty as more rows
            slopes = np.linalg.lstsq(np.vstack([dx, np.sqrt(alpha) * np.eye(len(ps))]), np.concatenate([ty - ty.mean(), np.zeros(len(ps))]), rcond=None)[0]
            away = np.array(x) - tx.mean(0)
            last = [t[2] for t in there if t[0] == year - 1 and t[1] == month]
            out[*pixel, year, month] = (y - ty.mean(), sum(weights[p] * v for p, v in zip(ps, away, strict=True)), float(slopes @ away), last[0] - ty.mean() if last else None)
    return out


@pytest.mark.parametrize("alpha", [1.0, 25.0, 0.0])
def test_response_and_its_baselines(spark, alpha):
    rows, panel, edges = given(spark)
    got = {(r.row, r.col, r.year, r.month): (r.observed, r.predicted, r.ridge, r.persistence) for r in H.predict_response(panel, edges, "y", 2001, 5, alpha).collect()}
    want = expected(rows, 2001, 5, alpha)
    assert set(got) == set(want) and {k[:2] for k in got} == set(PARENTS) and not [k for k in got if k[:2] == (0, 0) and k[3] == 3]
    assert any(v[3] is None for v in want.values())
    for k, v in want.items():
        assert got[k][3] is None if v[3] is None else got[k] == pytest.approx(v, rel=1e-6, abs=1e-6)
        assert got[k][:3] == pytest.approx(v[:3], rel=1e-6, abs=1e-6)


def test_one_parent_and_none(spark):
    rows, panel, edges = given(spark)
    one = H.predict_response(panel, edges.where("parent = 'a' and row = 0"), "y", 2001, 5)
    assert one.where("ridge <> 0").count() == one.count() > 0
    assert H.predict_response(panel, edges.where("weight > 9"), "y", 2001, 5).count() == 0


def test_ridge_is_the_shrunk_slope(spark):
    # departures of a: -1, 0, 1; of y: -3, 0, 3; slope 6 / (2 + 1)
    rows = [(0, 0, 1990 + i, 6, 10.0 + i, 5.0 + 3 * i) for i in range(3)] + [(0, 0, 1993, 6, 14.0, 6.0)]
    panel = spark.createDataFrame(rows, "row int, col int, year int, month int, a double, y double")
    edges = spark.createDataFrame([(0, 0, "a", 1.0)], "row int, col int, parent string, weight double")
    (got,) = H.predict_response(panel, edges, "y", 1992, 3).collect()
    assert (got.observed, got.predicted, got.ridge, got.persistence) == pytest.approx((-2.0, 3.0, 6.0, 3.0))
