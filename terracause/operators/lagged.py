"""Dynamics of lagged graphs: edges have a lag (0 is instantaneous)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracause.operators.effects import fit_and_replicates, total_effects
from terracause.operators.graphmatrix import finite, graph_rows, impulse, keys_of, map_graphs, matrices, multipliers, radii, reduced
from terracause.operators.interventions import Scenario, Values

KEYS = ["row", "col"]
GRAPH = ["row", "col", "replicate"]
DYNAMIC = "row int, col int, replicate int, source string, target string, horizon int, direct double, lag_slice double, effect double, cumulative double, radius double, stable boolean"


def reduced_form(edges: DataFrame, variables: int) -> DataFrame:
    """A_l = (I - B0)^-1 B_l as long rows: the lagged edge, and its way on through the instantaneous graph."""
    now = total_effects(edges.where("lag = 0").drop("lag"), variables).select(*GRAPH, F.col("parent").alias("_m"), F.col("child").alias("_c"), F.col("effect").alias("_e"))
    past = edges.where("lag > 0").select(*GRAPH, "lag", "parent", "child", "weight")
    on = past.select(*GRAPH, "lag", "parent", F.col("child").alias("_m"), "weight").join(now, [*GRAPH, "_m"]).select(*GRAPH, "lag", "parent", F.col("_c").alias("child"), (F.col("weight") * F.col("_e")).alias("weight"))
    return past.unionByName(on).groupBy(*GRAPH, "lag", "parent", "child").agg(F.sum("weight").alias("weight"))


def dynamic_effects(edges: DataFrame, names: list[str], horizon: int, threshold: float = 1.0, connected: bool = True) -> DataFrame:
    """Theta_h of every ordered pair up to a horizon, with its running sum, from one small recursion a graph and replicate.

    ``direct`` is the edge at lag h (0 beyond the deepest lag), ``lag_slice`` the edge's way on
    through the instantaneous graph (at 0 the total effect; null beyond), ``radius`` the largest
    eigenvalue of the graph's dynamics, and ``stable`` whether it is below the threshold. Graphs
    that can't be inverted or whose effects aren't finite have no rows; with ``connected``,
    pairs without any effect up to the horizon have none either.
    """
    d = len(names)

    def work(batch):
        lags = batch.column(3).to_numpy()
        b = matrices(batch.column(4), d, int(lags.max(initial=0)))
        first, a = reduced(b)
        theta, radius = impulse(first, a, horizon), radii(a)
        total = np.cumsum(theta, axis=1)
        direct, piece = np.zeros(theta.shape), np.full(theta.shape, np.nan)
        deep = min(horizon, b.shape[1] - 1)
        direct[:, : deep + 1] = b[:, : deep + 1]
        piece[:, 0], piece[:, 1 : deep + 1] = theta[:, 0], a[:, :deep]
        keep = (np.isfinite(total).all((1, 2, 3)) & np.isfinite(radius))[:, None, None] & (np.ones((1, d, d), bool) if not connected else (theta != 0).any(1))
        graph, target, source = np.nonzero(keep)
        n, h = len(graph), np.tile(np.arange(horizon + 1, dtype=np.int32), len(graph))
        where = np.repeat(graph, horizon + 1)
        word = pa.array(names)
        wide = lambda x: finite(x[graph, :, target, source].ravel())
        return [*keys_of(batch, where), word.take(pa.array(np.repeat(source, horizon + 1))), word.take(pa.array(np.repeat(target, horizon + 1))), h[: n * (horizon + 1)], wide(direct), wide(piece), wide(theta), wide(total), radius[where], radius[where] < threshold]

    return map_graphs(graph_rows(edges, names), DYNAMIC, work)


def dynamic_table(effects: DataFrame, contrasts: DataFrame, graphs: DataFrame) -> DataFrame:
    """One row a pixel, pair and horizon: the fit's effects, also in contrasts of source and target, and intervals over stable replicates.

    ``effects`` has all pairs of :func:`dynamic_effects`, ``contrasts`` row, col, variable and delta, and
    ``graphs`` the row, col and replicate of all graphs. Matrices of a replicate stay together throughout.
    """
    pair = [*KEYS, "source", "target", "horizon"]
    src = contrasts.select(*KEYS, F.col("variable").alias("source"), F.col("delta").alias("_s"))
    tgt = contrasts.select(*KEYS, F.col("variable").alias("target"), F.col("delta").alias("_t"))
    scale = F.try_divide("_s", F.when(F.col("_t") != 0, F.col("_t")))
    each = effects.join(src, [*KEYS, "source"], "left").join(tgt, [*KEYS, "target"], "left").withColumn("scaled", F.col("effect") * scale).withColumn("scaled_cumulative", F.col("cumulative") * scale).drop("_s", "_t")
    sizes = graphs.where("replicate > 0").groupBy(*KEYS).agg(F.countDistinct("replicate").alias("n_replicates"))
    fit = ["direct", "lag_slice", "effect", "cumulative", "radius", "stable", "scaled", "scaled_cumulative"]
    out = fit_and_replicates(each, pair, fit, ["effect", "cumulative", "scaled"], F.col("stable"))
    return out.withColumnRenamed("n_counted", "n_stable").join(sizes, KEYS, "left")


def stability_radius(edges: DataFrame, names: list[str]) -> DataFrame:
    """Largest absolute eigenvalue of the companion matrix of each graph and replicate; null where the graph has no inverse."""
    d = len(names)

    def work(batch):
        b = matrices(batch.column(4), d, int(batch.column(3).to_numpy().max(initial=0)))
        return [*keys_of(batch, np.arange(len(b))), finite(radii(reduced(b)[1]))]

    return map_graphs(graph_rows(edges, names), "row int, col int, replicate int, radius double", work)


def stability_summary(radius: DataFrame) -> DataFrame:
    """Radius of the fit, and over replicates the stable share, median, 95th percentile and maximum."""
    boot = F.when(F.col("replicate") > 0, F.col("radius"))
    return radius.groupBy(*KEYS).agg(F.max(F.when(F.col("replicate") == 0, F.col("radius"))).alias("radius"), F.avg((boot < 1).cast("int")).alias("stable_fraction"), F.percentile(boot, 0.5).alias("median"), F.percentile(boot, 0.95).alias("q95"), F.max(boot).alias("most"))


def structural_innovations(panel: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """e_t = (I - B0) x_t - sum of B_l x_{t-l}, row lags, of the fit; the first rows have none."""
    deepest = edges.agg(F.max("lag")).first()[0] or 0
    order = Window.partitionBy(*KEYS).orderBy("year", "month")
    rows = panel.select(*KEYS, "year", "month", *names, *[F.lag(v, k).over(order).alias(f"_{k}_{v}") for v in names for k in range(1, deepest + 1)])
    past = F.array(*[F.struct(F.lit(k).alias("lag"), F.lit(v).alias("parent"), F.col(v if k == 0 else f"_{k}_{v}").alias("_x")) for k in range(deepest + 1) for v in names])
    long = rows.select(*KEYS, "year", "month", F.inline(past))
    fit = edges.where("replicate = 0").select(*KEYS, "lag", "parent", "child", "weight")
    # null as soon as one needed value is
    pull = long.join(fit, [*KEYS, "lag", "parent"]).groupBy(*KEYS, "year", "month", F.col("child").alias("variable")).agg(F.when(F.count("_x") == F.count("*"), F.sum(F.col("_x") * F.col("weight"))).alias("_s"))
    own = rows.select(*KEYS, "year", "month", F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("_v")) for v in names])))
    has = fit.select(*KEYS, F.col("child").alias("variable")).distinct().withColumn("_h", F.lit(True))
    j = own.join(pull, [*KEYS, "year", "month", "variable"], "left").join(has, [*KEYS, "variable"], "left")
    return j.select(*KEYS, "year", "month", "variable", F.when(F.col("_h"), F.col("_v") - F.col("_s")).otherwise(F.col("_v")).alias("innovation"))


def var_intervention(edges: DataFrame, names: list[str], variable: str, value: float, duration: int, horizon: int) -> DataFrame:
    """Path of all variables, in centred units from a state of zero, when one is held at a value for some steps.

    One small simulation a graph and replicate.
    """
    import numpy as np
    import pandas as pd

    d, v = len(names), names.index(variable)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        lags = int(g["lag"].max())
        b = [np.zeros((d, d)) for _ in range(lags + 1)]
        for lag, p, c, w in zip(g["lag"], g.parent, g.child, g.weight, strict=True):
            b[int(lag)][names.index(c), names.index(p)] = w
        held = b[0].copy()
        held[v] = 0
        free, fixed = np.linalg.inv(np.eye(d) - b[0]), np.linalg.inv(np.eye(d) - held)
        path: list[np.ndarray] = []
        for t in range(horizon + 1):
            push = sum((b[k] @ path[t - k] for k in range(1, lags + 1) if t - k >= 0), np.zeros(d))
            if t < duration:
                push[v] = value
                path.append(fixed @ push)
            else:
                path.append(free @ push)
        f, total = g.iloc[0], np.cumsum(path, axis=0)
        rows = [(int(f["row"]), int(f["col"]), int(f["replicate"]), t, n, float(path[t][i]), float(total[t][i])) for t in range(horizon + 1) for i, n in enumerate(names)]
        return pd.DataFrame(rows, columns=["row", "col", "replicate", "horizon", "variable", "effect", "cumulative"])

    return edges.groupBy(*GRAPH).applyInPandas(run, "row int, col int, replicate int, horizon int, variable string, effect double, cumulative double")


PATHS = "row int, col int, replicate int, scenario string, target string, horizon int, active boolean, factual double, counterfactual double, effect double, cumulative double, stable boolean"


def var_windows(panel: DataFrame, names: list[str], scenarios: list[Scenario], start: tuple[int, int] | None, lags: int, horizon: int) -> DataFrame:
    """One row a pixel: its path from ``lags`` months before the start to the horizon, the set values of each step, and an error where there is none.

    Without a start month the path is one of zeros (the mean), and set values count from there.
    """
    asks = [(h.variable, h.value) for s in scenarios for h in s.hard]
    values = Values()
    series = panel.na.drop(subset=names)
    if start is None:
        if any("climatology" in v.kind for _, v in asks):
            raise ValueError("a climatology needs a start month")
        columns = [values.column(v, spec, F.lit(0.0)).cast("double") for v, spec in asks]
        rows = values.joined(series.select(*KEYS).distinct(), series)
        zeros = F.array_repeat(F.lit(0.0), (lags + horizon + 1) * len(names))
        return rows.select(*KEYS, zeros.alias("path"), F.flatten(F.array_repeat(F.array(*columns), horizon + 1)).alias("set"), F.lit(None).cast("string").alias("error"))
    columns = [values.column(v, spec).cast("double") for v, spec in asks]
    own = Window.partitionBy(*KEYS)
    here = (F.col("year") == start[0]) & (F.col("month") == start[1])
    rows = series.withColumn("_i", F.row_number().over(own.orderBy("year", "month"))).withColumn("_s", F.max(F.when(here, F.col("_i"))).over(own)).withColumn("_n", F.count("*").over(own))
    step = F.col("_i") - F.col("_s")
    inside = values.joined(rows.where(step.between(-lags, horizon)), series)
    one = F.struct(step.alias("step"), (F.col("year") * 12 + F.col("month")).alias("ym"), F.array(*[F.col(v).cast("double") for v in names]).alias("x"), F.array(*columns).alias("v"))
    held = inside.groupBy(*KEYS).agg(F.sort_array(F.collect_list(one)).alias("_w"))  # lags + horizon + 1 rows
    pixels = rows.groupBy(*KEYS).agg(F.max("_s").alias("_s"), F.max("_n").alias("_n")).join(held, KEYS, "left")
    whole = F.element_at("_w", -1)["ym"] - F.element_at("_w", 1)["ym"] == lags + horizon
    error = F.when(F.col("_s").isNull(), "no row for the start month").when(F.col("_s") <= lags, "not enough months before the start").when(F.col("_s") + horizon > F.col("_n"), "the horizon is beyond the series").when(~whole, "months are missing")
    return pixels.select(*KEYS, F.flatten(F.col("_w.x")).alias("path"), F.flatten(F.slice(F.col("_w.v"), lags + 1, horizon + 1)).alias("set"), error.alias("error"))


def var_paths(edges: DataFrame, panel: DataFrame, names: list[str], scenarios: list[Scenario], targets: list[str], horizon: int, duration: int, start: tuple[int, int] | None = None, threshold: float = 1.0) -> DataFrame:
    """Path of each target when a scenario's variables are held for ``duration`` steps: factual, counterfactual, effect and its running sum.

    With a start month (year, month) the pixel's own innovations are inferred from its series,
    e_t = x_t - sum of B_l x_{t-l}, and run again with the equations of the set variables
    replaced while they are held; all of them are held together. Without one the path starts from
    a state of zero and has no innovations. Matrices of a graph and replicate stay together; a batch of
    them is simulated at once. Graphs that can't be inverted have no rows.
    """
    if any(s.mechanisms or s.goals for s in scenarios):
        raise ValueError("lagged scenarios set variables only")
    problems = {s.name: s.problem(names) for s in scenarios}
    if any(problems.values()):
        raise ValueError("; ".join(f"{n}: {p}" for n, p in problems.items() if p))
    d = len(names)
    # one number
    lags = edges.agg(F.max("lag")).first()[0] or 0
    windows = var_windows(panel, names, scenarios, start, lags, horizon)
    rows = graph_rows(edges, names).join(windows.where("error is null").drop("error"), KEYS).select(*GRAPH, "lags", "cells", "path", "set")
    held = [[names.index(h.variable) for h in s.hard] for s in scenarios]
    aims = [names.index(t) for t in targets]

    def work(batch):
        b = matrices(batch.column(4), d, lags)
        n = len(b)
        x = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(n, lags + horizon + 1, d)
        set_ = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(n, horizon + 1, -1)
        free, a = reduced(b)
        radius = radii(a)
        shocks = x[:, lags:] - sum(np.einsum("nij,ntj->nti", b[:, lag], x[:, lags - lag : x.shape[1] - lag]) for lag in range(lags + 1))
        if start is None:
            shocks = np.zeros_like(shocks)
        out, first = [], 0
        for s, j in zip(scenarios, held, strict=True):
            bound = b[:, 0].copy()
            bound[:, j] = 0
            fixed = multipliers(bound)
            y = x.copy()
            for t in range(horizon + 1):
                push = shocks[:, t].copy()
                for lag in range(1, lags + 1):
                    push += np.einsum("nij,nj->ni", b[:, lag], y[:, lags + t - lag])
                if t < duration:
                    push[:, j] = set_[:, t, first : first + len(j)]
                y[:, lags + t] = np.einsum("nij,nj->ni", fixed if t < duration else free, push)
            first += len(j)
            for i, target in zip(aims, targets, strict=True):
                before, after = x[:, lags:, i], y[:, lags:, i]
                out.append((s.name, target, before, after, after - before, np.cumsum(after - before, axis=1)))
        good = np.flatnonzero(np.isfinite(np.stack([o[3] for o in out])).all((0, 2)))
        k = len(good) * (horizon + 1)
        take = np.tile(np.repeat(good, horizon + 1), len(out))
        step = np.tile(np.arange(horizon + 1, dtype=np.int32), len(good) * len(out))
        wide = lambda place: finite(np.concatenate([o[place][good].ravel() for o in out]))
        text = lambda place: pa.array(np.repeat([o[place] for o in out], k), pa.string())
        return [*keys_of(batch, take), text(0), text(1), step, step < duration, wide(2), wide(3), wide(4), wide(5), radius[take] < threshold]

    return map_graphs(rows, PATHS, work)


def var_scenario_table(edges: DataFrame, panel: DataFrame, names: list[str], scenarios: list[Scenario], targets: list[str], horizon: int, duration: int, start: tuple[int, int] | None = None, threshold: float = 1.0) -> DataFrame:
    """Scenarios x targets x horizons of the fit, with intervals over stable replicates; a pixel without the window asked for has an error row a scenario."""
    paths = var_paths(edges, panel, names, scenarios, targets, horizon, duration, start, threshold)
    keys = [*KEYS, "scenario", "target", "horizon"]
    out = fit_and_replicates(paths, keys, ["active", "factual", "counterfactual", "effect", "cumulative", "stable"], ["effect", "cumulative"], F.col("stable"))
    gone = [f"{v}_{c}" for v in ("effect", "cumulative") for c in ("boot_sd", "p_positive")]
    out = out.drop(*gone).withColumnRenamed("n_counted", "n_stable").withColumn("error", F.lit(None).cast("string"))
    deepest = edges.agg(F.max("lag")).first()[0] or 0
    wrong = var_windows(panel, names, scenarios, start, deepest, horizon).where("error is not null").select(*KEYS, F.explode(F.array(*[F.lit(s.name) for s in scenarios])).alias("scenario"), "error")
    return out.unionByName(wrong, allowMissingColumns=True)
