"""Interventions and counterfactuals on instantaneous linear graphs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracause.operators.effects import causal_paths, total_effects
from terracause.operators.graphmatrix import finite, graph_rows, inverses, keys_of, map_graphs, matrices, multipliers

KEYS = ["row", "col"]
GRAPH = ["row", "col", "replicate"]


@dataclass(frozen=True)
class Value:
    """A value for a variable: fixed, mean, median, quantile, climatology_mean, climatology_median, climatology_quantile, delta, scale, qdelta, zdelta or fraction_to.

    ``by`` names the columns that a climatology goes by; ``reference`` is what ``fraction_to`` goes
    towards, by the name of a kind or as a value of its own, ``fraction_to`` included.
    """

    kind: str
    amount: float = 0.0
    reference: str | Value | None = None
    by: tuple[str, ...] = ("month",)


@dataclass(frozen=True)
class Hard:
    variable: str
    value: Value


@dataclass(frozen=True)
class Mechanism:
    """A change of an edge: ``scale``, ``set`` or ``add`` its weight; a new edge only if ``new`` allows it."""

    parent: str
    child: str
    how: str
    amount: float
    new: bool = False


@dataclass(frozen=True)
class Goal:
    """Set ``variable`` to whatever brings ``target`` to a value; the goals of a scenario are met together."""

    variable: str
    target: str
    value: Value


@dataclass(frozen=True)
class Scenario:
    name: str
    hard: tuple[Hard, ...] = ()
    mechanisms: tuple[Mechanism, ...] = ()
    goals: tuple[Goal, ...] = ()

    def variables(self) -> list[str]:
        return [h.variable for h in self.hard] + [v for m in self.mechanisms for v in (m.parent, m.child)] + [v for g in self.goals for v in (g.variable, g.target)]

    def problem(self, known: list[str]) -> str | None:
        """Why the scenario can't be worked out for any pixel."""
        gone = sorted({v for v in self.variables() if v not in known})
        held = [h.variable for h in self.hard] + [g.variable for g in self.goals]
        loops = [m.child for m in self.mechanisms if m.parent == m.child]
        if gone:
            return f"unknown variables: {', '.join(gone)}"
        if not self.variables():
            return "nothing changed"
        if loops:
            return f"self-loops: {', '.join(loops)}"
        return f"set more than once: {', '.join(sorted({v for v in held if held.count(v) > 1}))}" if len(set(held)) < len(held) else None


class Values:
    """Columns for value specifications, and the statistics of a pixel's series that they need."""

    def __init__(self, q_low: float = 0.1, q_high: float = 0.9):
        self.span, self.own, self.clim = (q_low, q_high), {}, {}

    def _stat(self, make: Column, label: str, by: tuple[str, ...] | None = None) -> Column:
        into = self.own if by is None else self.clim.setdefault(by, {})
        name = "_" + (label if by is None else f"{'_'.join(by)}_{label}").replace(".", "_")
        into[name] = make.alias(name)
        return F.col(name)

    def column(self, variable: str, spec: Value, base: Column | None = None) -> Column:
        """The value of a row, whose own is ``base`` (the variable's, unless given)."""
        x, k, a = F.col(variable) if base is None else base, spec.kind, spec.amount
        part = min(max(a, 0.0), 1.0)
        if k in ("delta", "scale", "fixed"):
            return {"delta": x + a, "scale": x * a, "fixed": F.lit(float(a))}[k]
        if k in ("mean", "median", "quantile"):
            return self._stat({"mean": F.avg(variable), "median": F.percentile(variable, 0.5), "quantile": F.percentile(variable, part)}[k], f"{k}_{part if k == 'quantile' else ''}_{variable}")
        if k == "zdelta":
            return x + a * self._stat(F.stddev_samp(variable), f"sd_{variable}")
        if k == "qdelta":
            return x + a * self._stat(F.percentile(variable, self.span[1]) - F.percentile(variable, self.span[0]), f"span_{variable}")
        if k == "fraction_to":
            aim = spec.reference if isinstance(spec.reference, Value) else Value(spec.reference or "mean", by=spec.by)
            return x + a * (self.column(variable, aim, base) - x)
        if k.startswith("climatology_"):
            of = k.removeprefix("climatology_")
            make = {"mean": F.avg(variable), "median": F.percentile(variable, 0.5), "quantile": F.percentile(variable, part)}[of]
            return self._stat(make, f"{of}_{part if of == 'quantile' else ''}_{variable}", tuple(spec.by))
        raise ValueError(f"unknown kind of value: {k}")

    def joined(self, rows: DataFrame, panel: DataFrame) -> DataFrame:
        """``rows`` beside the statistics of the panel's series."""
        if self.own:
            rows = rows.join(panel.groupBy(*KEYS).agg(*self.own.values()), KEYS)
        for by, stats in self.clim.items():
            rows = rows.join(panel.groupBy(*KEYS, *by).agg(*stats.values()), [*KEYS, *by])
        return rows


def value_spec(panel: DataFrame, variable: str, spec: Value, q_low: float = 0.1, q_high: float = 0.9) -> DataFrame:
    """Each row's value under a specification, from the pixel's own series (climatologies by the columns they name); ``qdelta`` counts in spans from ``q_low`` to ``q_high``."""
    values = Values(q_low, q_high)
    value = values.column(variable, spec)
    return values.joined(panel, panel).select(*KEYS, "year", "month", F.col(variable).alias("baseline"), value.alias("value"))


def cut_incoming(edges: DataFrame, variables: list[str]) -> DataFrame:
    return edges.where(~F.col("child").isin(*variables))


def change_mechanisms(edges: DataFrame, changes: tuple[Mechanism, ...]) -> DataFrame:
    """Edge weights after the changes, in order; graphs that would get an edge that ``new`` doesn't allow have none left (see ``mechanism_refusals``)."""
    loops = [m.parent for m in changes if m.parent == m.child]
    if loops:
        raise ValueError(f"self-loops: {', '.join(loops)}")
    out = edges
    for m in changes:
        here = (F.col("parent") == m.parent) & (F.col("child") == m.child)
        w = {"scale": F.col("weight") * m.amount, "set": F.lit(m.amount), "add": F.col("weight") + m.amount}[m.how]
        changed = out.withColumn("weight", F.when(here, w).otherwise(F.col("weight")))
        if m.new and m.how != "scale":
            lacking = out.select(*GRAPH).distinct().join(out.where(here).select(*GRAPH), GRAPH, "left_anti")
            changed = changed.unionByName(lacking.select(*GRAPH, F.lit(m.parent).alias("parent"), F.lit(m.child).alias("child"), F.lit(m.amount).alias("weight")))
        elif m.how != "scale" and m.amount:
            changed = changed.join(out.where(here & (F.col("weight") != 0)).select(*GRAPH).distinct(), GRAPH, "left_semi")
        out = changed
    return out


def hard_intervention(edges: DataFrame, values: DataFrame, variable: str, targets: list[str], variables: int) -> DataFrame:
    """Change of each target when one variable is set: response in the cut graph times (value - baseline).

    ``values`` has one row an event with row, col, baseline and value.
    """
    response = total_effects(cut_incoming(edges, [variable]), variables).where((F.col("parent") == variable) & F.col("child").isin(*targets)).select(*GRAPH, F.col("child").alias("target"), F.col("effect").alias("response"))
    return values.join(response, KEYS).withColumn("delta", F.col("response") * (F.col("value") - F.col("baseline")))


def mechanism_change(edges: DataFrame, panel: DataFrame, changes: tuple[Mechanism, ...], targets: list[str], variables: int) -> DataFrame:
    """Change of targets at each event when edges change and the event's disturbances stay: row, col, replicate, year, month, target, delta.

    Graphs that refuse a change have no rows. The sum over changed edges of (new - old weight) x the parent's distance from its pixel's mean x
    the response of the target to the child in the changed graph.
    """
    new = change_mechanisms(edges, changes)
    diff = new.alias("n").join(edges.alias("o"), [*GRAPH, "parent", "child"], "left").select(*GRAPH, "parent", "child", (F.col("n.weight") - F.coalesce("o.weight", F.lit(0.0))).alias("_d")).where("_d <> 0")
    names = sorted({m.parent for m in changes})
    means = panel.groupBy(*KEYS).agg(*[F.avg(n).alias(f"_{n}") for n in names])
    away = panel.join(means, KEYS).select(*KEYS, "year", "month", F.inline(F.array(*[F.struct(F.lit(n).alias("parent"), (F.col(n) - F.col(f"_{n}")).alias("_z")) for n in names])))
    reach = total_effects(new, variables).where(F.col("child").isin(*targets)).select(*GRAPH, F.col("parent").alias("child"), F.col("child").alias("target"), F.col("effect").alias("_r"))
    itself = diff.where(F.col("child").isin(*targets)).select(*GRAPH, "parent", F.col("child").alias("target"), F.col("_d").alias("_w"))
    # one weight a graph, parent and target before the events are joined
    weights = diff.join(reach, [*GRAPH, "child"]).select(*GRAPH, "parent", "target", (F.col("_d") * F.col("_r")).alias("_w")).unionByName(itself).groupBy(*GRAPH, "parent", "target").agg(F.sum("_w").alias("_w"))
    return away.join(weights, [*KEYS, "parent"]).groupBy(*GRAPH, "year", "month", "target").agg(F.sum(F.col("_w") * F.col("_z")).alias("delta"))


def goal_seek(edges: DataFrame, panel: DataFrame, variable: str, target: str, goal_delta: float, variables: int) -> DataFrame:
    """The mean value of a variable that moves a target by ``goal_delta``; null where the target doesn't respond."""
    response = total_effects(cut_incoming(edges, [variable]), variables).where((F.col("parent") == variable) & (F.col("child") == target)).select(*GRAPH, F.col("effect").alias("response"))
    means = panel.groupBy(*KEYS).agg(F.avg(variable).alias("baseline"))
    return response.join(means, KEYS).withColumn("required", F.col("baseline") + F.try_divide(F.lit(goal_delta), F.when(F.abs("response") > 1e-12, F.col("response"))))


def goal_seek_joint(edges: DataFrame, controls: list[str], goals: dict[str, float], variables: int) -> DataFrame:
    """Changes of k variables that move k targets by their goals together: one k x k solve a graph."""
    import pandas as pd

    from terracause.operators.linalg import solve

    names = list(goals)
    response = total_effects(cut_incoming(edges, controls), variables).where(F.col("parent").isin(*controls) & F.col("child").isin(*names))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((len(names), len(controls)))
        for p, c, e in zip(g.parent, g.child, g.effect, strict=True):
            a[names.index(c), controls.index(p)] = e
        x = solve(a, np.array(list(goals.values()))) if a.shape[0] == a.shape[1] else np.full(len(controls), np.nan)
        f = g.iloc[0]
        return pd.DataFrame([(int(f["row"]), int(f["col"]), int(f["replicate"]), c, None if np.isnan(v) else float(v)) for c, v in zip(controls, x, strict=True)], columns=["row", "col", "replicate", "variable", "change"])

    return response.groupBy(*GRAPH).applyInPandas(run, "row int, col int, replicate int, variable string, change double")


WEIGHTS = "row int, col int, replicate int, scenario string, part string, name string, target string, quantity string, weight double, error string"


def changed_matrices(b: np.ndarray, mechanisms: tuple[Mechanism, ...], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (graphs x child x parent) after the changes, in order, and for each graph which change it refuses (-1: none): one that would make an edge it isn't allowed to."""
    out, refused = b.copy(), np.full(len(b), -1)
    for i, m in enumerate(mechanisms):
        p, c = names.index(m.parent), names.index(m.child)
        old = out[:, c, p]
        new = {"scale": old * m.amount, "set": np.full(len(b), float(m.amount)), "add": old + m.amount}[m.how]
        if not m.new:
            refused = np.where((refused < 0) & (old == 0) & (new != 0), i, refused)
        out[:, c, p] = new
    return out, refused


def mechanism_refusals(edges: DataFrame, changes: tuple[Mechanism, ...], names: list[str]) -> DataFrame:
    """Error rows of the graphs that refuse a change: row, col, replicate, error. Self-loops are refused by all."""

    def work(batch):
        b = matrices(batch.column(4), len(names), 0)[:, 0]
        loops = [i for i, m in enumerate(changes) if m.parent == m.child]
        refused = np.full(len(b), loops[0]) if loops else changed_matrices(b, changes, names)[1]
        at = np.flatnonzero(refused >= 0)
        return [*keys_of(batch, at), pa.array([_refusal(changes[refused[i]]) for i in at], pa.string())]

    return map_graphs(graph_rows(edges, names), "row int, col int, replicate int, error string", work)


def _refusal(m: Mechanism) -> str:
    return f"self-loop: {m.parent}" if m.parent == m.child else f"no edge: {m.parent}->{m.child}"


def scenario_weights(edges: DataFrame, names: list[str], scenarios: list[Scenario], targets: list[str]) -> DataFrame:
    """What a scenario does in each graph, as weights of an event's quantities; one pass over the graphs for all scenarios.

    With z the event's distances from the pixel's means and e = (I - B) z its disturbances, which
    stay: the changed mechanisms alone move all variables by (I - B')^-1 (B' - B) z. Set variables
    and those of goals then move the rest through B' without their own equations, each from where
    the mechanisms left it; goals solve one small system together. All of it is linear in the
    quantities ``z:variable``, ``d:variable`` (set value less baseline) and ``g:target`` (goal less
    baseline). Parts are mechanism, hard and goal (effects on a target; ``name`` is the change), and
    required (the change of a goal's variable). A graph that refuses a change or whose system is
    singular has an error row.
    """
    d, at = len(names), {n: i for i, n in enumerate(names)}

    def one(b: np.ndarray, s: Scenario) -> tuple[list, np.ndarray]:
        n = len(b)
        after, refused = changed_matrices(b, s.mechanisms, names)
        error = np.array([None if r < 0 else _refusal(s.mechanisms[r]) for r in refused], object)
        quantities = [f"z:{v}" for v in names] + [f"d:{h.variable}" for h in s.hard] + [f"g:{g.target}" for g in s.goals]
        k = len(quantities)
        form = np.zeros((n, d, k))  # how the mechanisms alone move each variable
        form[:, :, :d] = multipliers(after) @ (after - b)
        held = [at[h.variable] for h in s.hard] + [at[g.variable] for g in s.goals]
        cut = after.copy()
        cut[:, held] = 0
        reach = multipliers(cut)[:, :, held]  # variable x held
        h = len(s.hard)
        moved = np.zeros((n, len(held), k))
        for i, change in enumerate(s.hard):
            moved[:, i] = -form[:, at[change.variable]]
            moved[:, i, d + i] += 1
        if s.goals:
            aims = [at[g.target] for g in s.goals]
            gap = -form[:, aims] - reach[:, aims, :h] @ moved[:, :h]
            for i in range(len(aims)):
                gap[:, i, d + h + i] += 1
            system = reach[:, aims, h:]
            # a target that no control reaches leaves a system without an inverse
            size = np.abs(system).max((1, 2))
            solved = inverses(np.where(np.isfinite(system), system, 0))
            bad = ~np.isfinite(solved).all((1, 2)) | (np.abs(solved).max((1, 2)) * size > 1e12)
            error = np.where(bad & (error == None), "goals: singular", error)  # noqa: E711
            moved[:, h:] = np.where(bad[:, None, None], 0, solved) @ gap
        lost = ~(np.isfinite(form).all((1, 2)) & np.isfinite(reach).all((1, 2)))
        error = np.where(lost & (error == None), "graph: singular", error)  # noqa: E711
        lines = []
        if s.mechanisms:
            lines += [("mechanism", "mechanisms", t, form[:, at[t]]) for t in targets]
        for i, change in enumerate([*s.hard, *s.goals]):
            kind = "hard" if i < h else "goal"
            lines += [(kind, change.variable, t, reach[:, at[t], i, None] * moved[:, i]) for t in targets]
            if kind == "goal":
                lines.append(("required", change.variable, None, moved[:, i] + form[:, at[change.variable]]))
        return [(part, name, target, quantities, w) for part, name, target, w in lines], error

    def work(batch):
        b = matrices(batch.column(4), d, 0)[:, 0]
        columns, take, values = [[] for _ in range(6)], [], []
        for s in scenarios:
            lines, error = one(b, s)
            wrong = np.flatnonzero(error != None)  # noqa: E711
            take.append(wrong)
            for c, v in zip(columns, (s.name, None, None, None, None, None), strict=True):
                c += [v] * len(wrong)
            errors = columns[5]
            errors[len(errors) - len(wrong) :] = list(error[wrong])
            good = error == None  # noqa: E711
            for part, name, target, quantities, w in lines:
                for q, quantity in enumerate(quantities):
                    some = np.flatnonzero(good & (w[:, q] != 0))
                    take.append(some)
                    for c, v in zip(columns, (s.name, part, name, target, quantity, None), strict=True):
                        c += [v] * len(some)
                    values.append((len(columns[0]) - len(some), w[some, q]))
        weight = np.full(len(columns[0]), np.nan)
        for start, w in values:
            weight[start : start + len(w)] = w
        text = [pa.array(c, pa.string()) for c in columns]
        return [*keys_of(batch, np.concatenate(take).astype(np.int64)), *text[:5], finite(weight), text[5]]

    return map_graphs(graph_rows(edges, names), WEIGHTS, work)


def event_quantities(panel: DataFrame, scenarios: list[Scenario], unit: str = "none", events: Column | None = None) -> DataFrame:
    """The quantities that ``scenario_weights`` names, at every complete event: row, col, year, month, scenario, quantity, value.

    Events are all rows, or those that meet the condition ``events``; means and other statistics are of all rows anyway.

    Effects are linear, so for ``mean`` and ``sum`` one event a pixel and scenario is enough (year and month null).
    """
    values = Values()
    columns: dict[str, dict[str, Column]] = {}
    for s in scenarios:
        columns[s.name] = {f"d:{h.variable}": values.column(h.variable, h.value) - F.col(h.variable) for h in s.hard} | {f"g:{g.target}": values.column(g.target, g.value) - F.col(g.target) for g in s.goals}
    used = sorted({v for s in scenarios for v in s.variables()})
    parents = sorted({m.parent for s in scenarios for m in s.mechanisms})
    means = [values._stat(F.avg(v), f"mean__{v}") for v in parents]
    complete = panel.na.drop(subset=used)
    rows = values.joined(complete if events is None else complete.where(events), complete)
    for v, mean in zip(parents, means, strict=True):
        for s in scenarios:
            if any(m.parent == v for m in s.mechanisms):
                columns[s.name][f"z:{v}"] = F.col(v) - mean
    every = [(s.name, q, c) for s in scenarios for q, c in columns[s.name].items()]
    if unit in ("mean", "sum"):
        merge = F.avg if unit == "mean" else F.sum
        rows = rows.groupBy(*KEYS).agg(*[merge(c).alias(f"_{i}") for i, (_, _, c) in enumerate(every)]).select("*", F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("month"))
        every = [(s, q, F.col(f"_{i}")) for i, (s, q, _) in enumerate(every)]
    out = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(q).alias("quantity"), c.cast("double").alias("value")) for s, q, c in every])
    return rows.select(*KEYS, "year", "month", F.inline(out))


def scenario_parts(edges: DataFrame, panel: DataFrame, scenarios: list[Scenario], targets: list[str], names: list[str], unit: str = "none", events: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Effect of each part of each scenario (row, col, replicate, year, month, scenario, part, name, target, effect), and error rows of graphs."""
    weights = scenario_weights(edges, names, scenarios, targets)
    at = event_quantities(panel, scenarios, unit, events)
    good = weights.where("error is null").drop("error")
    effect = at.join(good, [*KEYS, "scenario", "quantity"]).groupBy(*GRAPH, "year", "month", "scenario", "part", "name", "target").agg(F.sum(F.col("weight") * F.col("value")).alias("effect"))
    return effect, weights.where("error is not null").select(*GRAPH, "scenario", "error")


def scenario_table(edges: DataFrame, panel: DataFrame, scenarios: list[Scenario], targets: list[str], names: list[str], unit: str = "mean", events: Column | None = None) -> DataFrame:
    """Scenarios x targets with the fit's change and its bootstrap interval: the ``mean``, ``median`` or ``sum`` over events, or each event (``none``, with year and month). ``events`` says which rows are events.

    A scenario that can't be worked out gives an error row a pixel instead of failing all; so does a
    fitted graph that refuses one of its changes or whose goals have no solution. Replicates that do
    so don't count.
    """
    when = ["year", "month"] if unit == "none" else []
    problems = {s.name: s.problem([n for n in names if n in panel.columns]) for s in scenarios}
    fine = [s for s in scenarios if problems[s.name] is None]
    none = lambda *cs: [F.lit(None).cast("double").alias(c) for c in cs]
    wrong = [F.struct(F.lit(s).alias("scenario"), F.lit(p).alias("error")) for s, p in problems.items() if p]
    empty = [*[F.lit(None).cast("int").alias(c) for c in when]]
    shape = lambda df: df.select(*KEYS, *empty, "scenario", F.lit(None).cast("string").alias("target"), *none("effect", "boot_mean", "ci_low", "ci_high"), "error")
    out = shape(panel.select(*KEYS).distinct().select(*KEYS, F.inline(F.array(*wrong)))) if wrong else None
    if fine:
        effects, errors = scenario_parts(edges, panel, fine, targets, names, unit, events)
        each = effects.where("part <> 'required'").groupBy(*GRAPH, "scenario", "target", "year", "month").agg(F.sum("effect").alias("effect"))
        if unit == "median":
            each = each.groupBy(*GRAPH, "scenario", "target").agg(F.percentile("effect", 0.5).alias("effect"))
        keys = [*KEYS, "scenario", "target", *when]
        # the fit and its replicates side by side, in one aggregation
        boot = F.when(F.col("replicate") > 0, F.col("effect"))
        part = each.groupBy(*keys).agg(F.max(F.when(F.col("replicate") == 0, F.col("effect"))).alias("effect"), F.avg(boot).alias("boot_mean"), F.percentile(boot, [0.025, 0.975]).alias("_q"), F.max((F.col("replicate") == 0).cast("int")).alias("_has"))
        part = part.where("_has = 1").select(*KEYS, *when, "scenario", "target", "effect", "boot_mean", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), F.lit(None).cast("string").alias("error"))
        part = part.unionByName(shape(errors.where("replicate = 0")))
        out = part if out is None else out.unionByName(part)
    return out


def required_values(edges: DataFrame, panel: DataFrame, scenarios: list[Scenario], names: list[str], unit: str = "mean") -> DataFrame:
    """What the variables of goals have to be: row, col, replicate, scenario, name, baseline, change, required and error, over events by ``mean``, or each (``none``, with year and month)."""
    effects, errors = scenario_parts(edges, panel, scenarios, [names[0]], names, unit)
    when = ["year", "month"] if unit == "none" else []
    change = effects.where("part = 'required'").select(*GRAPH, *when, "scenario", "name", F.col("effect").alias("change"))
    used = sorted({v for s in scenarios for v in s.variables()})
    goals = sorted({g.variable for s in scenarios for g in s.goals})
    complete = panel.na.drop(subset=used)
    own = complete.select(*KEYS, "year", "month", F.inline(F.array(*[F.struct(F.lit(g).alias("name"), F.col(g).cast("double").alias("baseline")) for g in goals])))
    if unit != "none":
        own = own.groupBy(*KEYS, "name").agg((F.avg if unit == "mean" else F.sum)("baseline").alias("baseline"))
    good = change.join(own, [*KEYS, "name", *when]).select(*GRAPH, *when, "scenario", "name", "baseline", "change", (F.col("baseline") + F.col("change")).alias("required"), F.lit(None).cast("string").alias("error"))
    bad = errors.select(*GRAPH, *[F.lit(None).cast("int").alias(c) for c in when], "scenario", F.lit(None).cast("string").alias("name"), *[F.lit(None).cast("double").alias(c) for c in ("baseline", "change", "required")], "error")
    return good.unionByName(bad)


def intervention_components(edges: DataFrame, panel: DataFrame, scenario: Scenario, target: str, names: list[str], top: int, unit: str = "mean") -> DataFrame:
    """Rows of the fit for one target: what the mechanisms, each set variable and each goal contribute (these add up to the
    scenario's effect), each goal's required value, and the strongest paths from set variables in the cut graph.

    Over events by ``mean`` or ``sum``, or each event (``none``, with year and month).
    """
    fit, when = edges.where("replicate = 0"), ["year", "month"] if unit == "none" else []
    held = [*[h.variable for h in scenario.hard], *[g.variable for g in scenario.goals]]
    effects, _ = scenario_parts(fit, panel, [scenario], sorted({target, *held}), names, unit)
    kind = lambda text: F.lit(text).alias("kind")
    out = effects.where((F.col("part") != "required") & (F.col("target") == target)).select(*KEYS, *when, F.col("part").alias("kind"), "name", F.col("effect").alias("contribution"))
    if scenario.goals:
        need = required_values(fit, panel, [scenario], names, unit).where("error is null")
        out = out.unionByName(need.select(*KEYS, *when, kind("required"), "name", F.col("required").alias("contribution")))
    cut = cut_incoming(change_mechanisms(fit, scenario.mechanisms), held)
    for h in scenario.hard:
        # how far the variable is moved, from where the mechanisms leave it
        moved = effects.where((F.col("part") == "hard") & (F.col("name") == h.variable) & (F.col("target") == h.variable)).select(*KEYS, *when, F.col("effect").alias("_x"))
        paths = causal_paths(cut, h.variable, target, len(names) - 1, top).join(moved, KEYS)
        out = out.unionByName(paths.select(*KEYS, *when, kind("path"), F.col("path").alias("name"), (F.col("product") * F.col("_x")).alias("contribution")))
    return out
