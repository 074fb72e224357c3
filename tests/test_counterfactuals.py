"""Counterfactual events against a numpy solve of the structural equations."""

import numpy as np
import pytest

from terracause.operators import interventions as I

NAMES = ["a", "b", "c"]
B = np.array([[0, 0, 0], [0.5, 0, 0], [0.3, -0.7, 0]])  # row: child, column: parent


def solve(before, after, x, means, hard):
    z = x - means
    e = z - before @ z
    out, left = np.zeros(3), [i for i in range(3) if i not in hard]
    for i, v in hard.items():
        out[i] = v - means[i]
    out[left] = np.linalg.solve(np.eye(len(left)) - after[np.ix_(left, left)], e[left] + after[np.ix_(left, list(hard))] @ out[list(hard)])
    return out - z


@pytest.mark.parametrize("hard", [None, "a", "b"])
@pytest.mark.parametrize("mechanism", [None, ("b", "c", "scale", 3.0), ("a", "b", "set", -1.0)])
def test_events_equal_the_solve(spark, hard, mechanism):
    x = np.random.default_rng(3).normal(size=(12, 3)) + [4, 5, 6]
    panel = spark.createDataFrame([(0, 0, 2000, i + 1, *map(float, v)) for i, v in enumerate(x)], "row int, col int, year int, month int, a double, b double, c double")
    graph = [(0, 0, 0, NAMES[p], NAMES[c], float(B[c, p])) for c in range(3) for p in range(3) if B[c, p]]
    edges = spark.createDataFrame(graph, "row int, col int, replicate int, parent string, child string, weight double")
    scenario = I.Scenario("s", (I.Hard(hard, I.Value("delta", 2.0)),) if hard else (), (I.Mechanism(*mechanism),) if mechanism else ())
    out = I.scenario_table(edges, panel, [scenario], NAMES, NAMES, "none").collect()
    if not hard and not mechanism:
        assert {r["error"] for r in out} == {"nothing changed"}
        return
    after = B.copy()
    if mechanism:
        p, c = NAMES.index(mechanism[0]), NAMES.index(mechanism[1])
        after[c, p] = B[c, p] * mechanism[3] if mechanism[2] == "scale" else mechanism[3]
    got = {(r["month"], r["target"]): r["effect"] for r in out}
    for i, v in enumerate(x):
        want = solve(B, after, v, x.mean(0), {NAMES.index(hard): v[NAMES.index(hard)] + 2.0} if hard else {})
        np.testing.assert_allclose([got.get((i + 1, n), 0.0) for n in NAMES], want, atol=1e-9)


def sem(before, after, z, held, aims):
    """Held variables at their distances from the mean, goals solved together (variable, target, value): z after, and after the mechanisms alone."""
    e = z - before @ z
    alone = np.linalg.solve(np.eye(3) - after, e)

    def under(held):
        m, rhs = np.eye(3) - after, e.copy()
        for i, v in held.items():
            m[i], rhs[i] = np.eye(3)[i], v
        return np.linalg.solve(m, rhs)

    if aims:
        zero = dict.fromkeys((v for v, _, _ in aims), 0.0)
        base = under(held | zero)
        k = np.array([[under(held | zero | {v: 1.0})[t] - base[t] for v, _, _ in aims] for _, t, _ in aims])
        found = np.linalg.solve(k, [value - base[t] for _, t, value in aims])
        held = held | {v: f for (v, _, _), f in zip(aims, found, strict=True)}
    return under(held), alone, held


@pytest.mark.parametrize("unit", ["none", "mean", "sum", "median"])
def test_goals_hard_values_and_mechanisms_together(spark, unit):
    """Effects equal a solve at every event, over events as asked; parts add up; goals are met."""
    x = np.random.default_rng(5).normal(size=(9, 3)) + [4, 5, 6]
    panel = spark.createDataFrame([(0, 0, 2000, i + 1, *map(float, v)) for i, v in enumerate(x)], "row int, col int, year int, month int, a double, b double, c double")
    graphs = {0: B, 1: B * 1.2}
    edges = spark.createDataFrame([(0, 0, r, NAMES[p], NAMES[c], float(b[c, p])) for r, b in graphs.items() for c in range(3) for p in range(3) if b[c, p]], "row int, col int, replicate int, parent string, child string, weight double")
    s = I.Scenario("s", (I.Hard("a", I.Value("delta", 2.0)),), (I.Mechanism("b", "c", "scale", 3.0), I.Mechanism("a", "b", "add", 0.25)), (I.Goal("b", "c", I.Value("scale", 1.1)),))
    means, want = x.mean(0), {}
    for r, b in graphs.items():
        after = b.copy()
        after[2, 1], after[1, 0] = b[2, 1] * 3, b[1, 0] + 0.25
        moved = []
        for v in x:
            z, alone, held = sem(b, after, v - means, {0: v[0] + 2 - means[0]}, [(1, 2, v[2] * 1.1 - means[2])])
            assert z[2] + means[2] == pytest.approx(v[2] * 1.1)
            moved.append((z - (v - means), alone - (v - means), held[1] + means[1]))
        want[r] = moved
    merge = {"mean": np.mean, "sum": np.sum, "median": np.median}.get(unit)
    out = I.scenario_table(edges, panel, [s], NAMES, NAMES, unit).collect()
    for i, target in enumerate(NAMES):
        effects = {r: np.array([m[0][i] for m in moved]) for r, moved in want.items()}
        mine = [r for r in out if r.target == target]
        if unit == "none":
            assert [r.effect for r in sorted(mine, key=lambda r: r.month)] == pytest.approx(effects[0].tolist(), abs=1e-9)
        else:
            assert [(r.effect, r.boot_mean) for r in mine] == [pytest.approx((merge(effects[0]), merge(effects[1])), abs=1e-9)]
    if unit == "median":
        return
    parts = I.intervention_components(edges, panel, s, "c", NAMES, 3, unit).collect()
    each = [i for i in range(9)] if unit == "none" else [None]
    for i in each:
        here = [p for p in parts if i is None or p.month == i + 1]
        total = sum(p.contribution for p in here if p.kind in ("mechanism", "hard", "goal"))
        effects = np.array([m[0][2] for m in want[0]])
        assert total == pytest.approx(merge(effects) if merge else effects[i], abs=1e-9)
        alone = np.array([m[1][2] for m in want[0]])
        assert sum(p.contribution for p in here if p.kind == "mechanism") == pytest.approx(merge(alone) if merge else alone[i], abs=1e-9)
        need = np.array([m[2] for m in want[0]])
        assert [p.contribution for p in here if p.kind == "required"] == [pytest.approx(merge(need) if merge else need[i], abs=1e-9)]


@pytest.mark.parametrize(
    ("scenario", "error"),
    [
        (I.Scenario("s", mechanisms=(I.Mechanism("c", "a", "set", 0.5),)), "no edge: c->a"),
        (I.Scenario("s", mechanisms=(I.Mechanism("a", "a", "set", 0.5),)), "self-loops: a"),
        (I.Scenario("s", goals=(I.Goal("c", "a", I.Value("mean")),)), "goals: singular"),
        (I.Scenario("s", (I.Hard("a", I.Value("mean")),), goals=(I.Goal("a", "b", I.Value("mean")),)), "set more than once: a"),
        (I.Scenario("s", goals=(I.Goal("b", "c", I.Value("mean")), I.Goal("a", "c", I.Value("mean")))), "goals: singular"),
        (I.Scenario("s", (I.Hard("z", I.Value("mean")),)), "unknown variables: z"),
    ],
)
def test_refused_scenarios_are_error_rows(spark, scenario, error):
    """Beside one that works; the graph of a replicate that refuses doesn't count."""
    panel = spark.createDataFrame([(0, 0, 2000, i + 1, float(i), float(i % 3), 1.0) for i in range(5)], "row int, col int, year int, month int, a double, b double, c double")
    edges = spark.createDataFrame([(0, 0, r, NAMES[p], NAMES[c], float(B[c, p])) for r in (0, 1) for c in range(3) for p in range(3) if B[c, p]], "row int, col int, replicate int, parent string, child string, weight double")
    fine = I.Scenario("fine", (I.Hard("a", I.Value("delta", 1.0)),))
    out = I.scenario_table(edges, panel, [scenario, fine], ["b"], NAMES).collect()
    assert {(r.scenario, r.error) for r in out} == {("s", error), ("fine", None)}


def test_new_edges_where_allowed(spark):
    panel = spark.createDataFrame([(0, 0, 2000, i + 1, float(i), float(i % 3), 1.0) for i in range(5)], "row int, col int, year int, month int, a double, b double, c double")
    edges = spark.createDataFrame([(0, 0, 0, "a", "b", 0.5)], "row int, col int, replicate int, parent string, child string, weight double")
    out = I.scenario_table(edges, panel, [I.Scenario("s", mechanisms=(I.Mechanism("a", "c", "set", 2.0, new=True),))], NAMES, NAMES, "none").collect()
    assert sorted((r.month, r.target, r.effect) for r in out) == [(i + 1, "c", 2.0 * (i - 2)) for i in range(5)]


def test_changes_of_edges_that_are_not_there(spark):
    """Only the graph that has the edge is changed; with ``new`` both; self-loops are refused at once."""
    schema = "row int, col int, replicate int, parent string, child string, weight double"
    edges = spark.createDataFrame([(0, 0, 0, "a", "b", 0.5), (0, 0, 0, "b", "c", 2.0), (0, 1, 0, "b", "c", 3.0)], schema)
    add = lambda **k: {(r["col"], r.parent, r.child): r.weight for r in I.change_mechanisms(edges, (I.Mechanism("a", "b", "add", 0.25, **k),)).collect()}
    assert add() == {(0, "a", "b"): 0.75, (0, "b", "c"): 2.0}
    assert add(new=True) == {(0, "a", "b"): 0.75, (0, "b", "c"): 2.0, (1, "a", "b"): 0.25, (1, "b", "c"): 3.0}
    refused = I.mechanism_refusals(edges, (I.Mechanism("a", "b", "add", 0.25),), NAMES).collect()
    assert [(r["col"], r.error) for r in refused] == [(1, "no edge: a->b")]
    with pytest.raises(ValueError, match="self-loops: a"):
        I.change_mechanisms(edges, (I.Mechanism("a", "a", "scale", 2.0),))
