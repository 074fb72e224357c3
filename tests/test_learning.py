"""Learning of lagged graphs and of pooled structures, whiteness by simulation, ranks: recovery and known answers."""

import numpy as np
import pytest

from terracause.operators import diagnostics as D
from terracause.operators import graphs as G
from terracause.operators import lagged as L
from terracause.operators import linalg
from terracause.operators import solvers as S
from terracause.operators.effects import quantile_contrast

NAMES = ["a", "b", "c"]
# true zeros at both lags; a -> b -> c at once
B = [np.array([[0, 0, 0], [0.8, 0, 0], [0, -0.7, 0]]), np.array([[0.5, 0, 0], [0, 0, 0], [0, 0.4, 0]]), np.array([[0, 0, 0.3], [0, 0, 0], [0, 0, 0]])]


def series(n=400, seed=3):
    rng, m, x = np.random.default_rng(seed), np.linalg.inv(np.eye(3) - B[0]), np.zeros((n + 50, 3))
    e = rng.uniform(-1, 1, x.shape)
    for t in range(2, len(x)):
        x[t] = m @ (e[t] + B[1] @ x[t - 1] + B[2] @ x[t - 2])
    return x[50:]


def panel(spark, pixels, names=NAMES):
    rows = [(p, 0, 1900 + i // 12, i % 12 + 1, *map(float, v)) for p, x in pixels.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row int, col int, year int, month int, " + ", ".join(f"{n} double" for n in names))


def test_lagged_graph_with_true_zeros(spark):
    got = {(r.lag, r.parent, r.child): r.weight for r in S.discover_lagged(panel(spark, {0: series(2000)}), NAMES, 2, "none").collect()}
    want = {(lag, NAMES[p], NAMES[c]): B[lag][c, p] for lag in range(3) for c in range(3) for p in range(3) if B[lag][c, p]}
    assert all(got[k] == pytest.approx(v, abs=0.12) for k, v in want.items())
    # of 16 places without an edge most are exactly empty, the rest weak; without pruning all lagged ones are filled
    assert len(got) <= len(want) + 4 and all(abs(v) < 0.12 for k, v in got.items() if k not in want)
    every = S.discover_lagged(panel(spark, {0: series()}), NAMES, 2, "none", prune=False).where("lag > 0").count()
    assert every == 18


def test_series_with_gaps_and_short_ones_have_no_graph(spark):
    p = panel(spark, {0: series(60), 1: series(60), 2: series(30)})
    out = S.discover_lagged(p.where("not (row = 1 and year = 1902 and month = 3)"), NAMES, 1)
    assert {r.row for r in out.select("row").distinct().collect()} == {0}


def test_replicates_of_lagged_graphs(spark):
    """Weights of all lags stay together; the same whatever the batches; consensus keeps the true edges and intervals hold the true effects."""
    p = panel(spark, {0: series()})
    e = S.lagged_graphs(p, NAMES, 40, 2, "none", batch=7).cache()
    again = S.lagged_graphs(p.repartition(3), NAMES, 40, 2, "none", batch=40)
    order = ["replicate", "lag", "parent", "child"]
    assert [tuple(r)[2:6] for r in e.orderBy(*order).collect()] == [tuple(r)[2:6] for r in again.orderBy(*order).collect()]
    assert {r.replicate for r in e.select("replicate").distinct().collect()} == set(range(41))
    kept = {(r.lag, r.parent, r.child) for r in G.consensus_edges(e, 0.8, 0.1, 0.05).collect()}
    want = {(lag, NAMES[c], NAMES[r]) for lag in range(3) for r in range(3) for c in range(3) if B[lag][r, c]}
    assert kept == want
    table = L.dynamic_table(L.dynamic_effects(e, NAMES, 4, connected=False), quantile_contrast(p, NAMES, 0.1, 0.9), e.select("row", "col", "replicate").distinct()).collect()
    truth, hit = linalg.dynamic_effects(B[0], B[1:], 4), []
    for r in table:
        true = truth[r.horizon][NAMES.index(r.target), NAMES.index(r.source)]
        assert r.n_stable == 40
        hit.append(r.effect_ci_low - 0.03 <= true <= r.effect_ci_high + 0.03)
    assert np.mean(hit) > 0.85


def test_whiteness_by_simulation(spark):
    """A VAR of one lag too few is found out, the right one isn't; the p is the same for any batches and partitions."""
    rng = np.random.default_rng(0)
    white, late = rng.normal(size=(200, 2)), np.zeros((200, 2))
    for t in range(2, 200):
        late[t] = 0.7 * late[t - 2] + rng.normal(size=2)
    p = panel(spark, {0: white, 1: late, 2: white[:9]}, ["a", "b"])
    run = lambda df, **k: {r.row: r for r in S.whiteness_bootstrap(df, ["a", "b"], 4, 1, 99, 10, **k).collect()}
    one, other = run(p, batch=25), run(p.repartition(5), batch=7)
    assert {k: r.p for k, r in one.items()} == {k: r.p for k, r in other.items()}
    assert one[0].p > 0.05 and one[1].p == 0.01 and one[2].p is None and one[2].q is None


def test_portmanteau_of_several_series(spark):
    x = np.random.default_rng(2).normal(size=(120, 3))
    out = {r.row: r for r in D.portmanteau(panel(spark, {0: x, 1: x[:4]}), NAMES, 5, 1).collect()}
    assert out[0].q == pytest.approx(linalg.portmanteau(x, 5).sum()) and (out[0].n, out[0].df) == (120, 36)
    assert out[0].p == pytest.approx(linalg.gamma_tail(18, out[0].q / 2)) and 0.001 < out[0].p < 1
    assert (out[1].n, out[1].q, out[1].df, out[1].p) == (4, None, None, None)
    each = linalg.portmanteau_each(np.stack([x, x[::-1]]), 5)
    assert each.tolist() == pytest.approx([linalg.portmanteau(x, 5).sum(), linalg.portmanteau(x[::-1], 5).sum()])


FIVE = ["a", "b", "c", "d", "e"]


def pooled(n=1500, seed=4):
    """a and b make c (a collider); c makes d; d and b make e."""
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 5))
    a, b = z[:, 0], z[:, 1]
    c = 0.8 * a - 0.7 * b + 0.6 * z[:, 2]
    d = 0.9 * c + 0.6 * z[:, 3]
    e = 0.8 * d + 0.7 * b + 0.6 * z[:, 4]
    return np.stack([a, b, c, d, e], axis=1)


def test_search_finds_skeleton_and_colliders():
    near, apart = linalg.separations(np.corrcoef(pooled(20_000).T), 20_000, 2.6)
    links = {(FIVE[i], FIVE[j]) for i in range(5) for j in range(i) if near[i, j]}
    assert links == {("c", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("e", "b")}
    assert apart[0, 1] == () and 2 in apart[0, 3]
    head = linalg.orientations(near, apart)
    arrows = {(FIVE[i], FIVE[j]) for i in range(5) for j in range(5) if head[i, j]}
    assert arrows == {("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "e")}


def test_rules_orient_what_follows():
    """A chain away from a collider, and a cycle that has to be avoided."""
    near = np.zeros((4, 4), bool)
    for i, j in ((0, 2), (1, 2), (2, 3)):
        near[i, j] = near[j, i] = True
    head = linalg.orientations(near, {(0, 1): (), (0, 3): (2,), (1, 3): (2,)})
    assert {tuple(x) for x in np.argwhere(head).tolist()} == {(0, 2), (1, 2), (2, 3)}
    chain = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], bool)
    assert not linalg.orientations(chain, {(0, 2): (1,)}).any()


def test_pooled_search_over_replicates(spark):
    """Most replicates agree on the structure; nulls don't count; the counts are the same for any partitions."""
    x = pooled()
    p = panel(spark, {i: x[i * 300 : (i + 1) * 300] for i in range(5)}, FIVE)
    out = G.pooled_search(p, FIVE, 40, 2.6).collect()
    again = G.pooled_search(p.repartition(7).unionByName(p.limit(3).selectExpr("row", "col", "year", "month", "null as a", "b", "c", "d", "e")), FIVE, 40, 2.6).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    assert all(sum(r.n for r in out if (r.a, r.b) == pair) == 40 for pair in {(r.a, r.b) for r in out})
    most = {(r.a, r.b): r.endpoint for r in sorted(out, key=lambda r: r.n)}
    assert most == {("a", "b"): "none", ("a", "c"): "-->", ("a", "d"): "none", ("a", "e"): "none", ("b", "c"): "-->", ("b", "d"): "none", ("b", "e"): "-->", ("c", "d"): "-->", ("c", "e"): "none", ("d", "e"): "-->"}


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_ranks_by_ranges(spark, ranges):
    from pyspark.sql import functions as F

    from terracause.operators.ranks import ranked

    rows = [(i, None if i % 50 == 0 else float(i * 37 % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(5)
    got = {r.id: r.k for r in ranked(df, [F.desc("v"), F.asc("id")], "k", ranges).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i for i, r in enumerate(want)}
    assert ranked(df.where("id < 0"), [F.asc("id")], "k", ranges).count() == 0
    plan = ranked(df, [F.asc("id")], "k", ranges)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_folds_hold_their_share_of_each_class(spark):
    from terracause.operators.landcover import spatial_folds

    rng = np.random.default_rng(1)
    rows = [(b, int(rng.choice(3, p=[[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.2, 0.7]][b % 3]))) for b in range(60) for _ in range(int(rng.integers(5, 40)))]
    df = spark.createDataFrame([(f"b{b}", k) for b, k in rows], "block string, k int")
    fold = {r.block: r.fold for r in spatial_folds(df, "k", "block", 4).collect()}
    assert len(fold) == 60 and set(fold.values()) == {0, 1, 2, 3}
    count = np.zeros((4, 3))
    for b, k in rows:
        count[fold[f"b{b}"], k] += 1
    share = count / count.sum(0)
    assert (np.abs(share - 0.25) < 0.06).all()
    blocks = np.bincount(list(fold.values()))
    assert blocks.max() - blocks.min() <= 1
