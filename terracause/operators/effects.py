"""Effects read from graphs: direct, total, paths, drivers, processes and backdoor estimates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracause.operators.graphmatrix import finite, inverses, keys_of, map_graphs
from terracause.operators.residual import grouped_ols
from terracause.operators.sampling import draw

KEYS = ["row", "col"]
GRAPH = ["row", "col", "replicate"]


def direct_effects(edges: DataFrame, target: str, how: str = "raw") -> DataFrame:
    """Weights of the edges into a target: of the fit, or the mean over replicates."""
    rows = edges.where(F.col("child") == target)
    if how == "raw":
        return rows.where("replicate = 0").select(*KEYS, F.col("parent").alias("source"), F.col("weight").alias("effect"))
    if how == "mean":
        return rows.where("replicate > 0").groupBy(*KEYS, F.col("parent").alias("source")).agg(F.avg("weight").alias("effect"))
    raise ValueError(f"unknown choice: {how}")


def total_effects(edges: DataFrame, variables: int) -> DataFrame:
    """Sum over all directed walks, (I - B)^-1 - I, in one pass over the graphs: powers of the weights up to ``variables`` - 1 for acyclic graphs.

    Pairs that no walk joins have no row. A graph that still has walks of that length and one more is
    cyclic: it goes to the matrix inverse and has rows for all pairs of its variables, null where there is
    no inverse. A graph's edges are one row; many graphs are worked on at once.
    """
    names = F.sort_array(F.array_distinct(F.concat(F.collect_set("parent"), F.collect_set("child"))))
    own = edges.groupBy(*GRAPH).agg(names.alias("_names"), F.collect_list(F.struct("parent", "child", F.col("weight").cast("double").alias("weight"))).alias("_e"))
    place = lambda e: F.struct((F.array_position("_names", e["parent"]) - 1).cast("int").alias("p"), (F.array_position("_names", e["child"]) - 1).cast("int").alias("c"), e["weight"].alias("w"))
    rows = own.select(*GRAPH, "_names", F.transform("_e", place).alias("cells"))

    def work(batch):
        lists, cells = batch.column(3), batch.column(4)
        sizes = np.diff(lists.offsets.to_numpy())
        n, d = len(sizes), int(sizes.max())
        flat, owner = cells.flatten(), np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
        p, c, w = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("p", "c", "w"))
        b, link = np.zeros((n, d, d)), np.zeros((n, d, d), bool)
        np.add.at(b, (owner, c, p), w)
        link[owner, c, p] = True
        total, power, reach, way = b.copy(), b, link.copy(), link
        for _ in range(max(variables, d) - 2):
            power, way = power @ b, (way.astype(np.float32) @ link) > 0
            total, reach = total + power, reach | way
        cyclic = ((way.astype(np.float32) @ link) > 0).any((1, 2)) & (((power @ b) != 0) | ~np.isfinite(power)).any((1, 2))
        for i in np.flatnonzero(cyclic):
            k = sizes[i]
            total[i, :k, :k] = inverses(np.eye(k)[None] - b[i : i + 1, :k, :k])[0] - np.eye(k)
            reach[i] = (np.arange(d) < k)[:, None] & (np.arange(d) < k)
        graph, child, parent = np.nonzero(reach)
        first, words = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0], lists.flatten()
        return [*keys_of(batch, graph), words.take(pa.array(first[graph] + parent)), words.take(pa.array(first[graph] + child)), finite(total[graph, child, parent])]

    return map_graphs(rows, "row int, col int, replicate int, parent string, child string, effect double", work)


def quantile_contrast(panel: DataFrame, variables: list[str], low: float, high: float) -> DataFrame:
    """Low and high quantile of each variable per pixel, and their difference."""
    g = panel.groupBy(*KEYS).agg(*[F.percentile(v, [low, high]).alias(v) for v in variables])
    return g.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v)[0].alias("q_low"), F.col(v)[1].alias("q_high")) for v in variables]))).withColumn("delta", F.col("q_high") - F.col("q_low"))


def scaled_effects(effects: DataFrame, contrasts: DataFrame, target: str) -> DataFrame:
    """Effects in units of the target's contrast per contrast of the source; null where the target has none."""
    src = contrasts.select(*KEYS, F.col("variable").alias("source"), F.col("delta").alias("_s"))
    tgt = contrasts.where(F.col("variable") == target).select(*KEYS, F.col("delta").alias("_t"))
    return effects.join(src, [*KEYS, "source"]).join(tgt, KEYS).withColumn("scaled", F.try_divide(F.col("effect") * F.col("_s"), F.when(F.col("_t") != 0, F.col("_t")))).drop("_s", "_t")


def bootstrap_summary(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean, median, deviation, interval and signs over replicates (1 and up)."""
    a, v = (1 - level) / 2, F.col(value)
    g = df.where((F.col("replicate") > 0) & v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("boot_n"), F.avg(v).alias("boot_mean"), F.stddev_samp(v).alias("boot_sd"), F.percentile(v, [0.5, a, 1 - a]).alias("_q"), F.avg((v > 0).cast("int")).alias("p_positive"), F.avg((v < 0).cast("int")).alias("p_negative")
    )
    return g.select(*keys, "boot_n", "boot_mean", F.col("_q")[0].alias("boot_median"), "boot_sd", F.col("_q")[1].alias("ci_low"), F.col("_q")[2].alias("ci_high"), (F.col("_q")[2] - F.col("_q")[1]).alias("ci_width"), "p_positive", "p_negative", ((F.col("_q")[1] > 0) | (F.col("_q")[2] < 0)).alias("excludes_zero"))


def fit_and_replicates(df: DataFrame, keys: list[str], fit: list[str], values: list[str], counts: Column, level: float = 0.95) -> DataFrame:
    """One row a key with a fit (replicate 0), from one aggregation: the fit's columns, and for each value mean, deviation, interval and signs over the replicates (1 and up) that count.

    ``n_counted`` is how many replicates those are.
    """
    a, used = (1 - level) / 2, (F.col("replicate") > 0) & counts
    first = F.col("replicate") == 0
    parts = [F.max(first.cast("int")).alias("_has"), F.sum(used.cast("int")).alias("n_counted"), *[F.max(F.when(first, F.col(c))).alias(c) for c in fit]]
    out = [F.col(k) for k in keys] + [F.col(c) for c in [*fit, "n_counted"]]
    for v in values:
        x = F.when(used, F.col(v))
        parts += [F.avg(x).alias(f"{v}_boot_mean"), F.stddev_samp(x).alias(f"{v}_boot_sd"), F.percentile(x, [a, 1 - a]).alias(f"_q_{v}"), F.avg((x > 0).cast("int")).alias(f"{v}_p_positive")]
        low, high = F.col(f"_q_{v}")[0], F.col(f"_q_{v}")[1]
        out += [F.col(f"{v}_boot_mean"), F.col(f"{v}_boot_sd"), low.alias(f"{v}_ci_low"), high.alias(f"{v}_ci_high"), F.col(f"{v}_p_positive"), ((low > 0) | (high < 0)).alias(f"{v}_excludes_zero")]
    return df.groupBy(*keys).agg(*parts).where("_has = 1").select(*out)


def effect_table(edges: DataFrame, panel: DataFrame, sources: list[str], target: str, variables: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """One row a pixel and source: total effect, scaled, with bootstrap interval."""
    total = total_effects(edges, len(variables)).where((F.col("child") == target) & F.col("parent").isin(*sources)).withColumnRenamed("parent", "source").drop("child")
    point = total.where("replicate = 0").drop("replicate")
    scaled = scaled_effects(point, quantile_contrast(panel, variables, low, high), target)
    return scaled.join(bootstrap_summary(total, [*KEYS, "source"], "effect"), [*KEYS, "source"], "left")


def causal_paths(edges: DataFrame, source: str, target: str, longest: int, top: int) -> DataFrame:
    """Simple directed paths with the product of their weights; the strongest ``top`` of each graph."""
    b = edges.where("weight <> 0").select(*GRAPH, F.col("parent").alias("_p"), F.col("child").alias("_c"), F.col("weight").alias("_w"))
    live = b.where(F.col("_p") == source).select(*GRAPH, F.array("_p", "_c").alias("nodes"), F.col("_w").alias("product"))
    found = live.where(F.element_at("nodes", -1) == target)
    for _ in range(longest - 1):
        live = live.where(F.element_at("nodes", -1) != target)
        live = live.join(b, GRAPH).where((F.element_at("nodes", -1) == F.col("_p")) & ~F.array_contains("nodes", F.col("_c"))).select(*GRAPH, F.concat("nodes", F.array("_c")).alias("nodes"), (F.col("product") * F.col("_w")).alias("product"))
        found = found.unionByName(live.where(F.element_at("nodes", -1) == target))
    path = F.array_join("nodes", "->")
    order = Window.partitionBy(*GRAPH).orderBy(F.desc(F.abs("product")), path)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*GRAPH, path.alias("path"), F.size("nodes").alias("n_nodes"), "product", "rank")


def path_bootstrap(edges: DataFrame, source: str, target: str, longest: int, top: int) -> DataFrame:
    """The fit's strongest paths with their product on every replicate, a missing edge being 0, summarised."""
    paths = causal_paths(edges.where("replicate = 0"), source, target, longest, top).select(*KEYS, "path", "product")
    steps = paths.withColumn("_n", F.split("path", "->")).select(*KEYS, "path", F.posexplode(F.slice("_n", 2, 1000)).alias("_i", "child"), "_n").select(*KEYS, "path", F.col("_n")[F.col("_i")].alias("parent"), "child")
    sizes = steps.groupBy(*KEYS, "path").agg(F.count("*").alias("_k"))
    reps = edges.where("replicate > 0").select(*GRAPH).distinct()
    have = steps.join(edges.where("replicate > 0"), [*KEYS, "parent", "child"]).groupBy(*GRAPH, "path").agg(F.count("*").alias("_h"), F.aggregate(F.collect_list("weight"), F.lit(1.0), lambda a, w: a * w).alias("_v"))
    every = sizes.join(reps, KEYS).join(have, [*GRAPH, "path"], "left").withColumn("value", F.when(F.col("_h") == F.col("_k"), F.col("_v")).otherwise(0.0))
    return paths.join(bootstrap_summary(every, [*KEYS, "path"], "value"), [*KEYS, "path"])


def _winner(df: DataFrame, keys: list[str], sources: list[str]) -> DataFrame:
    """The source with the largest absolute effect; the first named wins ties; graphs with a missing effect give none."""
    place = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    g = df.where(F.col("source").isin(*sources)).groupBy(*keys).agg(F.max_by("source", F.struct(F.abs("effect"), -place)).alias("driver"), F.count("effect").alias("_n"))
    return g.where(F.col("_n") == len(sources)).drop("_n")


def dominant_driver(total: DataFrame, sources: list[str]) -> DataFrame:
    """Per pixel the fit's strongest source, the share of replicates it wins, and the commonest winner.

    ``total`` has row, col, replicate, source, effect.
    """
    point = _winner(total.where("replicate = 0"), KEYS, sources)
    boot = _winner(total.where("replicate > 0"), GRAPH, sources)
    share = boot.groupBy(*KEYS, "driver").agg(F.count("*").alias("_k"))
    all_ = share.groupBy(*KEYS).agg(F.sum("_k").alias("_n"), F.max_by("driver", F.struct("_k", -F.array_position(F.array(*map(F.lit, sources)), F.col("driver")))).alias("mode_driver"))
    own = share.select(*KEYS, "driver", "_k")
    return point.join(all_, KEYS, "left").join(own, [*KEYS, "driver"], "left").select(*KEYS, "driver", F.coalesce(F.try_divide(F.coalesce("_k", F.lit(0)), "_n"), F.lit(None)).alias("support"), "mode_driver")


def two_source_label(a: Column, b: Column, least: float, ratio: float) -> Column:
    """neither, source_a, source_b or roughly_equal; equal needs both above the threshold."""
    x, y = F.abs(a), F.abs(b)
    big, small = F.greatest(x, y), F.least(x, y)
    equal = (small >= least) & (small >= ratio * big)
    return F.when(x.isNull() | y.isNull(), None).when(big < least, "neither").when(equal, "roughly_equal").when(x >= y, "source_a").otherwise("source_b")


def two_source_class(total: DataFrame, a: str, b: str, least: float, ratio: float) -> DataFrame:
    """Class of the fit, and the share of replicates in each class."""
    pair = total.where(F.col("source").isin(a, b)).groupBy(*GRAPH).agg(F.max(F.when(F.col("source") == a, F.col("effect"))).alias("effect_a"), F.max(F.when(F.col("source") == b, F.col("effect"))).alias("effect_b"))
    each = pair.withColumn("klass", two_source_label(F.col("effect_a"), F.col("effect_b"), least, ratio))
    boot = each.where("replicate > 0 and klass is not null")
    names = ["neither", "source_a", "source_b", "roughly_equal"]
    share = boot.groupBy(*KEYS).agg(*[F.avg((F.col("klass") == n).cast("int")).alias(f"p_{n}") for n in names])
    return each.where("replicate = 0").select(*KEYS, "effect_a", "effect_b", "klass").join(share, KEYS, "left")


def two_source_reclassify(stored: DataFrame, run: str, least: float, ratio: float) -> DataFrame:
    """Stored effects with a class for new thresholds; a table of another run is refused."""
    other = stored.where(~F.col("run").eqNullSafe(F.lit(run))).limit(1).collect()
    if other:
        raise ValueError(f"the table holds the run {other[0]['run']}, not {run}")
    return stored.withColumn("klass", two_source_label(F.col("effect_a"), F.col("effect_b"), least, ratio))


def group_score(effects: DataFrame, groups: dict[str, list[str]], how: str) -> DataFrame:
    """Contribution of groups of sources: max_abs, rms_abs, mean_abs or sum_abs of their scaled effects."""
    of = F.create_map(*[F.lit(x) for g, names in groups.items() for n in names for x in (n, g)])
    v = F.abs("scaled")
    score = {"max_abs": F.max(v), "rms_abs": F.sqrt(F.avg(v * v)), "mean_abs": F.avg(v), "sum_abs": F.sum(v)}[how]
    keys = [c for c in GRAPH if c in effects.columns]
    return effects.withColumn("process", of[F.col("source")]).where("process is not null").groupBy(*keys, "process").agg(score.alias("score"))


def group_score_joint(panel: DataFrame, effects: DataFrame, groups: dict[str, list[str]], target_delta: DataFrame, low: float, high: float) -> DataFrame:
    """Joint contribution: quantile range of the summed contributions of a group over the target's contrast."""
    names = sorted({n for g in groups.values() for n in g})
    wide = effects.groupBy(*KEYS).pivot("source", names).agg(F.first("effect")).select(*KEYS, *[F.coalesce(F.col(n), F.lit(0.0)).alias(f"_e_{n}") for n in names])
    rows = panel.join(wide, KEYS)
    sums = [sum((F.col(n) * F.col(f"_e_{n}") for n in members), F.lit(0.0)).alias(f"_g_{g}") for g, members in groups.items()]
    q = rows.select(*KEYS, *sums).groupBy(*KEYS).agg(*[F.percentile(f"_g_{g}", [low, high]).alias(g) for g in groups])
    long = q.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(g).alias("process"), (F.col(g)[1] - F.col(g)[0]).alias("range")) for g in groups])))
    return long.join(target_delta, KEYS).select(*KEYS, "process", F.try_divide("range", F.when(F.col("delta") != 0, F.col("delta"))).alias("score"))


def process_label(a: Column, b: Column, least: float, ratio: float) -> Column:
    """weak where the larger score is at most ``least``; mixed where the smaller reaches ``ratio`` of it."""
    big, small = F.greatest(a, b), F.least(a, b)
    return F.when(a.isNull() | b.isNull(), None).when(big <= least, "weak").when(small >= ratio * big, "mixed").when(a > b, "A").otherwise("B")


def process_dominance(scores: DataFrame, a: str, b: str, least: float, ratio: float, support: float) -> DataFrame:
    """Dominant process of the fit; uncertain where too few replicates agree. ``scores`` has row, col, replicate, process, score."""
    pair = scores.groupBy(*GRAPH).agg(F.max(F.when(F.col("process") == a, F.col("score"))).alias("score_a"), F.max(F.when(F.col("process") == b, F.col("score"))).alias("score_b"))
    each = pair.withColumn("raw", process_label(F.col("score_a"), F.col("score_b"), least, ratio))
    point = each.where("replicate = 0").drop("replicate")
    agree = each.where("replicate > 0 and raw is not null").select(*KEYS, F.col("raw").alias("_r")).join(point.select(*KEYS, "raw"), KEYS).groupBy(*KEYS).agg(F.avg((F.col("_r") == F.col("raw")).cast("int")).alias("support"))
    j = point.join(agree, KEYS, "left")
    return j.withColumn("klass", F.when(F.coalesce("support", F.lit(0.0)) < support, "uncertain").otherwise(F.col("raw")))


def coupling_sensitivity(upstream: DataFrame, downstream: DataFrame, limit_up: float, limit_down: float) -> DataFrame:
    """Quadrant of a pixel by its upstream-to-mediator and mediator-to-target scores, and the replicates' support for it."""
    j = upstream.select(*GRAPH, F.col("score").alias("up")).join(downstream.select(*GRAPH, F.col("score").alias("down")), GRAPH)
    word = lambda c, lim: F.when(F.col(c) >= lim, "high").otherwise("low")
    each = j.withColumn("quadrant", F.concat_ws("-", word("up", limit_up), word("down", limit_down)))
    point = each.where("replicate = 0").drop("replicate")
    support = each.where("replicate > 0").select(*KEYS, F.col("quadrant").alias("_q")).join(point.select(*KEYS, "quadrant"), KEYS).groupBy(*KEYS).agg(F.avg((F.col("_q") == F.col("quadrant")).cast("int")).alias("support"))
    return point.join(support, KEYS, "left")


def mediated_path_score(edges: DataFrame, sources: list[str], mediators: list[str], target: str, contrasts: DataFrame) -> DataFrame:
    """Sum of absolute two-edge products source -> mediator -> target, in contrasts of source and target."""
    up = edges.where(F.col("parent").isin(*sources) & F.col("child").isin(*mediators)).select(*GRAPH, F.col("parent").alias("source"), F.col("child").alias("mediator"), F.col("weight").alias("_a"))
    down = edges.where(F.col("parent").isin(*mediators) & (F.col("child") == target)).select(*GRAPH, F.col("parent").alias("mediator"), F.col("weight").alias("_b"))
    src = contrasts.select(*KEYS, F.col("variable").alias("source"), F.col("delta").alias("_s"))
    tgt = contrasts.where(F.col("variable") == target).select(*KEYS, F.col("delta").alias("_t"))
    j = up.join(down, [*GRAPH, "mediator"]).join(src, [*KEYS, "source"]).join(tgt, KEYS)
    return j.groupBy(*GRAPH).agg(F.sum(F.abs(F.try_divide(F.col("_a") * F.col("_b") * F.col("_s"), F.when(F.col("_t") != 0, F.col("_t"))))).alias("score"))


def backdoor_effect(panel: DataFrame, treatment: str, outcome: str, adjustment: list[str], low: float, high: float) -> DataFrame:
    """Linear backdoor effect of moving the treatment between two of its quantiles, adjusted for its parents in the graph."""
    fit = grouped_ols(panel, KEYS, outcome, [treatment, *adjustment])
    q = panel.groupBy(*KEYS).agg(F.percentile(treatment, [low, high]).alias("_q"))
    return fit.join(q, KEYS).select(*KEYS, "n", F.col(f"b_{treatment}").alias("coefficient"), F.col("_q")[0].alias("control"), F.col("_q")[1].alias("treated"), (F.col(f"b_{treatment}") * (F.col("_q")[1] - F.col("_q")[0])).alias("effect"))


def backdoor_bootstrap(panel: DataFrame, treatment: str, outcome: str, adjustment: list[str], replicates: int, block: int = 1) -> DataFrame:
    """Coefficients on replicates: rows, or moving blocks of ``block`` consecutive rows whose starts are hash draws."""
    own = Window.partitionBy(*KEYS)
    numbered = panel.select(*KEYS, "year", "month", treatment, outcome, *adjustment).withColumn("i", F.row_number().over(own.orderBy("year", "month")) - 1).withColumn("n", F.count("*").over(own))
    if block == 1:
        from terracause.operators.sampling import resample

        drawn = resample(panel.select(*KEYS, "year", "month", treatment, outcome, *adjustment), replicates)
    else:
        slots = numbered.select(*KEYS, "i", "n").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        start = draw(*KEYS, "replicate", F.floor(F.col("i") / block)) % F.greatest(F.col("n") - block + 1, F.lit(1))
        spots = slots.select(*KEYS, "replicate", (start + F.col("i") % block).cast("int").alias("i")).where(F.col("i") >= 0)
        drawn = spots.join(numbered.drop("n"), [*KEYS, "i"])
    fit = grouped_ols(drawn, GRAPH, outcome, [treatment, *adjustment])
    return bootstrap_summary(fit.select(*GRAPH, F.col(f"b_{treatment}").alias("effect")), KEYS, "effect")


def cumulative_effect(df: DataFrame, keys: list[str], value: str, horizon: str = "horizon") -> DataFrame:
    """Running sum over the horizon."""
    return df.withColumn("cumulative", F.sum(value).over(Window.partitionBy(*keys).orderBy(horizon).rowsBetween(Window.unboundedPreceding, 0)))
