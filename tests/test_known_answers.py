"""Answers known in advance: small series, matrices and graphs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracause.functions import columns as C
from terracause.operators import effects as E
from terracause.operators import interventions as I
from terracause.operators import lagged as L
from terracause.operators import linalg
from terracause.operators import panel as P
from terracause.operators import residual as R
from terracause.operators import solvers as S
from terracause.operators.landcover import confusion_metrics
from terracause.sources import catalog as K
from terracause.sources import tables as T

EDGE = "row int, col int, replicate int, parent string, child string, weight double"


def seasonal(spark, skip=()):
    months = [3.0, 1.0, -2.0, 0.5, 4.0, -1.0, 2.0, 0.0, -3.0, 1.5, -0.5, 2.5]
    data = [(0, 0, 2000 + i // 12, i % 12 + 1, 10 + months[i % 12] + 0.25 * (i / 12)) for i in range(240) if i % 12 + 1 not in skip]
    return spark.createDataFrame(data, "row int, col int, year int, month int, signal double")


def triangle(spark):
    return spark.createDataFrame([(0, 0, 0, "a", "b", 0.5), (0, 0, 0, "b", "c", 0.4), (0, 0, 0, "a", "c", 0.3)], EDGE)


def test_calibrate_scale_offset_and_nodata(spark):
    df = spark.createDataFrame([(10.0,), (-1.0,)], "raw double").select(P.calibrate(F.col("raw"), F.lit(-1.0), F.lit(2.0), F.lit(5.0)).alias("v"))
    assert [r.v for r in df.collect()] == [25.0, None]


def test_seasonal_residual_is_zero(spark):
    r = R.residualize_monthly(seasonal(spark), ["signal"], 2019)
    assert r.agg(F.max(F.abs("signal_resid"))).first()[0] < 1e-10
    m = R.residual_models(seasonal(spark), "signal", 2019).first()
    assert (m.n_parameters, m.min_month_count, m.n_samples) == (13, 20, 240)
    assert math.isclose(m.trend * 12, 0.25, abs_tol=1e-9)


def test_absent_month_is_reported(spark):
    r = R.residualize_monthly(seasonal(spark, skip=(12,)), ["signal"], 2019)
    assert {x.signal_status for x in r.select("signal_status").distinct().collect()} == {"too_few_samples_in_calendar_month"}
    assert r.where("signal_resid is not null").count() == 0


def test_total_effects_of_a_triangle(spark):
    t = {(r.parent, r.child): r.effect for r in E.total_effects(triangle(spark), 3).collect()}
    assert t == pytest.approx({("a", "b"): 0.5, ("b", "c"): 0.4, ("a", "c"): 0.5})
    paths = {r.path: r["product"] for r in E.causal_paths(triangle(spark), "a", "c", 2, 5).collect()}
    assert paths == pytest.approx({"a->c": 0.3, "a->b->c": 0.2})


def test_cyclic_graph_goes_to_the_inverse(spark):
    e = spark.createDataFrame([(0, 0, 0, "a", "b", 0.5), (0, 0, 0, "b", "a", 0.4)], EDGE)
    t = {(r.parent, r.child): r.effect for r in E.total_effects(e, 2).collect()}
    m = np.linalg.inv(np.eye(2) - np.array([[0, 0.4], [0.5, 0]])) - np.eye(2)
    assert t[("a", "b")] == pytest.approx(m[1, 0]) and t[("a", "a")] == pytest.approx(m[0, 0])


def test_hard_intervention_cuts_incoming_edges(spark):
    values = spark.createDataFrame([(0, 0, 2.0, 3.0)], "row int, col int, baseline double, value double")
    d = {r.target: r.delta for r in I.hard_intervention(triangle(spark), values, "b", ["a", "c"], 3).collect()}
    assert d == pytest.approx({"c": 0.4})


def test_joint_goals(spark):
    e = spark.createDataFrame([(0, 0, 0, "a", "x", 2.0), (0, 0, 0, "b", "x", 1.0), (0, 0, 0, "b", "y", 4.0)], EDGE)
    got = {r.variable: r.change for r in I.goal_seek_joint(e, ["a", "b"], {"x": 3.0, "y": 4.0}, 4).collect()}
    assert got == pytest.approx({"a": 1.0, "b": 1.0})


def lagged(spark):
    rows = [(4, 9, 0, 0, "s", "t", 0.5), (4, 9, 0, 1, "s", "s", 0.2), (4, 9, 0, 1, "t", "t", 0.3)]
    return spark.createDataFrame(rows, "row int, col int, replicate int, lag int, parent string, child string, weight double")


def test_dynamic_effects_and_radius(spark):
    got = {(r.source, r.target, r.horizon): r.effect for r in L.dynamic_effects(lagged(spark), ["s", "t"], 2).collect()}
    want = {("s", "s", 0): 1.0, ("s", "t", 0): 0.5, ("t", "t", 0): 1.0, ("s", "s", 1): 0.2, ("s", "t", 1): 0.25, ("t", "t", 1): 0.3, ("s", "s", 2): 0.04, ("s", "t", 2): 0.095, ("t", "t", 2): 0.09}
    assert got == pytest.approx(want)
    assert L.stability_radius(lagged(spark), ["s", "t"]).first().radius == pytest.approx(0.3)
    theta = linalg.dynamic_effects(np.array([[0, 0], [0.5, 0]]), [np.diag([0.2, 0.3]) @ np.eye(2)], 2)
    assert theta[1] == pytest.approx(np.array([[0.2, 0], [0.25, 0.3]]))


def test_held_source_path(spark):
    got = {(r.horizon, r.variable): r.effect for r in L.var_intervention(lagged(spark), ["s", "t"], "s", 1.0, 1, 1).collect()}
    assert got == pytest.approx({(0, "s"): 1.0, (0, "t"): 0.5, (1, "s"): 0.2, (1, "t"): 0.25})


def test_discovery_recovers_a_known_graph(spark):
    rng = np.random.default_rng(0)
    n = 600
    e = rng.uniform(-1, 1, (n, 4))
    x = np.zeros((n, 4))
    x[:, 0] = e[:, 0]
    x[:, 1] = 0.8 * x[:, 0] + e[:, 1]
    x[:, 2] = -0.7 * x[:, 1] + e[:, 2]
    x[:, 3] = 0.9 * x[:, 0] + 0.6 * x[:, 2] + e[:, 3]
    data = [(0, 0, 1900 + i // 12, i % 12 + 1, *map(float, x[i])) for i in range(n)]
    panel = spark.createDataFrame(data, "row int, col int, year int, month int, a double, b double, c double, d double")
    got = {(r.parent, r.child): r.weight for r in S.discover_instant(panel, ["a", "b", "c", "d"]).collect()}
    want = {("a", "b"): 0.8, ("b", "c"): -0.7, ("a", "d"): 0.9, ("c", "d"): 0.6}
    assert all(got[k] == pytest.approx(v, abs=0.12) for k, v in want.items())
    assert all(abs(v) < 0.12 for k, v in got.items() if k not in want)


def test_chi_square_tail():
    assert linalg.gamma_tail(1.0, 1.0) == pytest.approx(math.exp(-1))
    assert linalg.gamma_tail(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)


def test_window_pool_has_nine_pixels_inside(spark):
    cells = spark.createDataFrame([(r, c, 2000, m, 1.0) for r in range(3) for c in range(3) for m in (1, 2)], "row int, col int, year int, month int, v double")
    n = {(r.centre_row, r.centre_col): r["count"] for r in P.window_pool(cells, 1, ["v"]).groupBy("centre_row", "centre_col").count().collect()}
    assert n[(1, 1)] == 18 and n[(0, 0)] == 8


def test_polygon_with_a_hole(spark):
    cells = spark.createDataFrame([(0.5, 0.5), (2.5, 2.5), (4.5, 0.5), (5.4, 2.5)], "x double, y double")
    outer, hole = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)], [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0)]
    assert {r.x for r in P.polygon_clip(cells, [outer, hole]).collect()} == {0.5, 4.5}
    assert {r.x for r in P.polygon_clip(cells, [outer], all_touched=True).collect()} == {0.5, 2.5, 4.5, 5.4}


def test_refusals(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "row int, col int, v double")
    with pytest.raises(ValueError, match="repeated keys"):
        P.checked_join(df, df, ["row", "col"])
    with pytest.raises(ValueError, match="missing columns: w"):
        T.panel_scan(df, ["row", "w"])
    with pytest.raises(ValueError, match="named twice"):
        P.shift(df, [P.Shifted("v"), P.Shifted("v", 1)])
    with pytest.raises(ValueError, match="unknown frequencies"):
        K.months(spark.createDataFrame([("q", "weekly", 2000, 1, "f")], "variable_name string, frequency string, year int, month int, file_name string"), {"q": "q"})


def test_predicate_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert df.where(C.predicate("v != 5")).count() == 1
    assert df.where(C.predicate("v == null")).count() == 1
    with pytest.raises(ValueError):
        C.predicate("v")


def test_partitions_do_not_matter(spark, sf_dir):
    from terracause.plans.fixtures import edges

    def rows():
        return sorted(tuple(r) for r in edges(spark, sf_dir).select("row", "col", "replicate", "parent", F.round("weight", 9)).collect())

    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_errors_become_rows(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, -1.0)], "row int, col int, v double")

    def root(g):
        import pandas as pd

        if g.v.iloc[0] < 0:
            raise ValueError("negative")
        return pd.DataFrame([(g.row.iloc[0], g["col"].iloc[0], g.v.iloc[0] ** 0.5)], columns=["row", "col", "r"])

    got = {r.col: (r.r, r.error) for r in S.map_pixels(df, root, "row int, col int, r double").collect()}
    assert got[0] == (1.0, None) and got[1][1] == "negative"


def test_confusion_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "t int, g int")
    m = confusion_metrics(df, "t", "g").first()
    assert (m.accuracy, m.balanced_accuracy) == (0.75, 0.75)
    assert m.macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 2)
