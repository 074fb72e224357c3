"""Lagged graphs: recursions, counterfactual paths and their refusals against NumPy."""

import numpy as np
import pytest

from terracause.operators import interventions as I
from terracause.operators import lagged as L
from terracause.operators.graphmatrix import multipliers

NAMES = ["a", "b", "c"]
EDGE = "row int, col int, replicate int, lag int, parent string, child string, weight double"
PANEL = "row int, col int, year int, month int, a double, b double, c double"
B = np.array([[[0, 0, 0], [0.5, 0, 0], [0.3, -0.7, 0]], [[0.4, 0.1, 0], [0, 0.3, 0], [0.2, 0, -0.2]], [[0.1, 0, 0], [0, 0, 0.15], [0, 0, 0.2]]])


def long(b, replicate=0, row=0):
    return [(row, 0, replicate, lag, NAMES[p], NAMES[c], float(b[lag, c, p])) for lag in range(len(b)) for c in range(3) for p in range(3) if b[lag, c, p]]


def theta(b, horizon):
    first = np.linalg.inv(np.eye(3) - b[0])
    out = [first]
    for h in range(1, horizon + 1):
        out.append(sum(first @ b[lag] @ out[h - lag] for lag in range(1, min(h, len(b) - 1) + 1)))
    return np.array(out)


def simulate(b, history, shocks, held, duration):
    path = list(history)
    for t, e in enumerate(shocks):
        push = e + sum(b[lag] @ path[-lag] for lag in range(1, len(b)))
        m = np.eye(3) - b[0]
        if t < duration:
            for i, v in held.items():
                m[i], push[i] = np.eye(3)[i], v[t]
        path.append(np.linalg.solve(m, push))
    return np.array(path[len(history) :])


def series(n=40, seed=1):
    rng = np.random.default_rng(seed)
    return simulate(B, np.zeros((2, 3)), rng.normal(size=(n, 3)) + [3, 0, 1], {}, 0)


def panel(spark, x, row=0, skip=()):
    return spark.createDataFrame([(row, 0, 2000 + i // 12, i % 12 + 1, *map(float, v)) for i, v in enumerate(x) if i not in skip], PANEL)


def test_two_years_of_horizons(spark):
    wide = 3 * B  # unstable
    edges = spark.createDataFrame(long(B) + long(wide, 1), EDGE)
    got = L.dynamic_effects(edges, NAMES, 24, connected=False).collect()
    assert len(got) == 2 * 9 * 25
    for replicate, b in enumerate((B, wide)):
        want, first = theta(b, 24), np.linalg.inv(np.eye(3) - b[0])
        for r in (r for r in got if r.replicate == replicate):
            t, s, h = NAMES.index(r.target), NAMES.index(r.source), r.horizon
            assert r.effect == pytest.approx(want[h, t, s], abs=1e-9, rel=1e-9) and r.cumulative == pytest.approx(want[: h + 1, t, s].sum(), abs=1e-9, rel=1e-9)
            assert r.direct == pytest.approx(b[h, t, s] if h < 3 else 0)
            assert r.lag_slice == (None if h > 2 else pytest.approx((first @ (b[h] if h else np.eye(3)))[t, s], abs=1e-12))
    assert {r.replicate: r.stable for r in got} == {0: True, 1: False}


def test_plan_does_not_grow_with_the_horizon(spark):
    edges = spark.createDataFrame(long(B), EDGE)
    size = lambda h: len(L.dynamic_effects(edges, NAMES, h)._jdf.queryExecution().executedPlan().toString().splitlines())
    assert size(24) == size(2)


def test_unstable_replicates_are_dropped(spark):
    edges = spark.createDataFrame(long(B) + [e for r in range(1, 5) for e in long(B * (1 + 0.01 * r), r)] + long(3 * B, 5), EDGE)
    contrasts = spark.createDataFrame([(0, 0, n, v) for n, v in zip(NAMES, (1.0, 2.0, 4.0), strict=True)], "row int, col int, variable string, delta double")
    out = L.dynamic_table(L.dynamic_effects(edges, NAMES, 3, connected=False), contrasts, edges.select("row", "col", "replicate")).collect()
    want = [theta(B * (1 + 0.01 * r), 3) for r in range(5)]
    for r in out:
        t, s, h = NAMES.index(r.target), NAMES.index(r.source), r.horizon
        assert (r.n_stable, r.n_replicates) == (4, 5)
        assert r.effect_boot_mean == pytest.approx(np.mean([w[h, t, s] for w in want[1:]]), abs=1e-12)
        assert r.scaled == pytest.approx(want[0][h, t, s] * 2.0**s / 2.0**t, abs=1e-12)


def test_singular_graphs_have_no_rows(spark):
    loop = [(0, 0, 0, 0, "a", "b", 1.0), (0, 0, 0, 0, "b", "a", 1.0), (0, 1, 0, 0, "a", "b", 1.0)]
    got = L.dynamic_effects(spark.createDataFrame(loop, EDGE), NAMES, 1).collect()
    assert {r["col"] for r in got} == {1}
    assert multipliers(np.array([[[0, 0.5], [0.5, 0]]]))[0] == pytest.approx(np.linalg.inv(np.array([[1, -0.5], [-0.5, 1]])))


SCENARIOS = [
    I.Scenario("one", (I.Hard("a", I.Value("delta", 1.5)),)),
    I.Scenario("two", (I.Hard("b", I.Value("fixed", 2.0)), I.Hard("a", I.Value("scale", 0.5)))),
    I.Scenario("itself", (I.Hard("c", I.Value("delta", 0.0)),)),
]


def test_counterfactual_paths(spark):
    """Joint scenarios on inferred innovations equal a simulation; holding a variable at its own values gives the factual path."""
    x = series()
    edges = spark.createDataFrame(long(B) + long(0.9 * B, 1), EDGE)
    start, horizon, duration = 14, 5, 3
    got = L.var_paths(edges, panel(spark, x), NAMES, SCENARIOS, NAMES, horizon, duration, (2000 + start // 12, start % 12 + 1)).collect()
    assert len(got) == 2 * 3 * 3 * 6
    window = x[start : start + horizon + 1]
    for replicate, b in enumerate((B, 0.9 * B)):
        shocks = [x[t] - sum(b[lag] @ x[t - lag] for lag in range(3)) for t in range(start, start + horizon + 1)]
        assert simulate(b, x[start - 2 : start], shocks, {}, 0) == pytest.approx(window)
        held = {"one": {0: window[:, 0] + 1.5}, "two": {1: np.full(6, 2.0), 0: window[:, 0] * 0.5}, "itself": {2: window[:, 2]}}
        for name, h in held.items():
            want = simulate(b, x[start - 2 : start], shocks, h, duration)
            for i, target in enumerate(NAMES):
                mine = sorted((r for r in got if (r.replicate, r.scenario, r.target) == (replicate, name, target)), key=lambda r: r.horizon)
                assert [r.counterfactual for r in mine] == pytest.approx(want[:, i].tolist())
                assert [r.factual for r in mine] == pytest.approx(window[:, i].tolist())
                assert [r.cumulative for r in mine] == pytest.approx(np.cumsum(want[:, i] - window[:, i]).tolist(), abs=1e-9)
                assert [r.active for r in mine] == [t < duration for t in range(6)]
            if name == "itself":
                assert want == pytest.approx(window)


def test_mean_paths_start_from_zero(spark):
    edges = spark.createDataFrame(long(B), EDGE)
    got = L.var_paths(edges, panel(spark, series()), NAMES, SCENARIOS[:1], ["c"], 4, 1).collect()
    want = simulate(B, np.zeros((2, 3)), np.zeros((5, 3)), {0: [1.5]}, 1)
    assert [r.effect for r in sorted(got, key=lambda r: r.horizon)] == pytest.approx(want[:, 2].tolist())
    with pytest.raises(ValueError, match="start month"):
        L.var_paths(edges, panel(spark, series()), NAMES, [I.Scenario("x", (I.Hard("a", I.Value("climatology_mean")),))], ["c"], 4, 1)
    with pytest.raises(ValueError, match="unknown variables: z"):
        L.var_paths(edges, panel(spark, series()), NAMES, [I.Scenario("x", (I.Hard("z", I.Value("mean")),))], ["c"], 4, 1)


@pytest.mark.parametrize(("start", "skip", "error"), [((2010, 1), (), "no row for the start month"), ((2000, 2), (), "not enough months before the start"), ((2003, 3), (), "the horizon is beyond the series"), ((2001, 1), (15,), "months are missing"), ((2001, 1), (3,), None)])
def test_windows_that_are_not_there_are_error_rows(spark, start, skip, error):
    out = L.var_scenario_table(spark.createDataFrame(long(B), EDGE), panel(spark, series(), skip=skip), NAMES, SCENARIOS[:2], ["c"], 5, 1, start).collect()
    assert {r.error for r in out} == {error} and len(out) == (2 if error else 12)
