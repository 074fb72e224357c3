"""Graphs as long edge tables: row, col, replicate (0 is the fit), parent, child, weight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["row", "col"]


def prior_knowledge(lags: dict[str, int], roots: tuple[str, ...] = ("month_sin", "month_cos")) -> list[tuple[str, str]]:
    """Forbidden (parent, child) pairs: no edge from a less lagged to a more lagged variable, none into a root."""
    return sorted((p, c) for p in lags for c in lags if p != c and (lags[p] < lags[c] or c in roots))


def forbidden_edges(lags: DataFrame, roots: tuple[str, ...] = ("month_sin", "month_cos")) -> DataFrame:
    """The rule of ``prior_knowledge`` for a table of row, col, variable and lag: the forbidden pairs of each pixel."""
    side = lambda name: lags.select(*KEYS, F.col("variable").alias(name), F.col("lag").alias(f"_{name}"))
    barred = (F.col("_parent") < F.col("_child")) | F.col("child").isin(*roots)
    return side("parent").join(side("child"), KEYS).where((F.col("parent") != F.col("child")) & barred).select(*KEYS, "parent", "child")


def _edge(edges: DataFrame) -> list[str]:
    """What names an edge within a pixel: parent and child, and the lag where edges have one."""
    return [c for c in ("lag", "parent", "child") if c in edges.columns]


def edge_probability(edges: DataFrame, least: float) -> DataFrame:
    """Share of replicates in which an edge's weight exceeds ``least``, per lag where there are lags; a replicate without the edge counts as none."""
    boot, edge = edges.where("replicate > 0"), _edge(edges)
    sizes = boot.groupBy(*KEYS).agg(F.countDistinct("replicate").alias("_n"))
    have = boot.groupBy(*KEYS, *edge).agg(F.sum((F.abs("weight") > least).cast("int")).alias("_k"))
    return have.join(sizes, KEYS).select(*KEYS, *edge, (F.col("_k") / F.col("_n")).alias("probability"))


def consensus_edges(edges: DataFrame, least_probability: float, least_weight: float, least_effect: float = 0.0) -> DataFrame:
    """Fitted edges with a probability and an absolute weight that reach the limits, each lag by itself."""
    p = edge_probability(edges, least_effect)
    point = edges.where("replicate = 0").drop("replicate")
    return point.join(p, [*KEYS, *_edge(edges)]).where((F.col("probability") >= least_probability) & (F.abs("weight") >= least_weight))


def graph_signature(edges: DataFrame, mode: str = "topology", digits: int = 2) -> DataFrame:
    """SHA-1 of a pixel's sorted edges: by topology, signs or rounded weights."""
    name = F.concat(F.col("parent"), F.lit("->"), F.col("child"))
    if mode == "signed":
        name = F.concat(name, F.when(F.col("weight") > 0, "+").otherwise("-"))
    elif mode == "weighted":
        name = F.concat(name, F.lit(":"), F.floor(F.col("weight") * 10**digits + 0.5).cast("string"))
    elif mode != "topology":
        raise ValueError(f"unknown mode: {mode}")
    text = F.concat_ws(";", F.sort_array(F.collect_list(name)))
    return edges.groupBy(*KEYS).agg(F.sha1(text.cast("binary")).alias("signature"), F.count("*").alias("n_edges"))


def graph_groups(signatures: DataFrame) -> DataFrame:
    """Identical graphs as groups, numbered by size (largest first), fewest edges and signature; attached to pixels.

    The signatures, a row a pixel, are written once: they are counted, ranked and joined.
    """
    from terracause.operators.ranks import ranked
    from terracause.sources.tables import scratch, table_replace

    signatures = table_replace(signatures, scratch(signatures.sparkSession, "signatures"))
    g = signatures.groupBy("signature", "n_edges").agg(F.count("*").alias("n_pixels"))
    numbered = ranked(g, [F.desc("n_pixels"), F.asc("n_edges"), F.asc("signature")], "group_id").withColumn("group_id", F.col("group_id").cast("int"))
    return signatures.join(numbered, ["signature", "n_edges"]).select(*KEYS, "group_id", "n_pixels", "n_edges")


def graph_features(edges: DataFrame, probability: DataFrame, total: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One fixed-length row a pixel: weight, probability and total effect of each ordered pair, and four summaries."""
    side = lambda df, c, tag: df.select(*KEYS, F.concat(F.lit(f"{tag}_"), "parent", F.lit("_"), "child").alias("_f"), F.col(c).alias("_v"))
    point = edges.where("replicate = 0")
    long = side(point, "weight", "raw").unionByName(side(probability, "probability", "p")).unionByName(side(total, "effect", "te"))
    names = [f"{tag}_{a}_{b}" for tag in ("raw", "p", "te") for a, b in pairs]
    wide = long.groupBy(*KEYS).pivot("_f", names).agg(F.first("_v"))
    summary = point.groupBy(*KEYS).agg(F.count("*").alias("n_edges"), F.sum(F.abs("weight")).alias("sum_abs"), F.max(F.abs("weight")).alias("max_abs"), F.avg("weight").alias("mean_weight"))
    return wide.join(summary, KEYS).select(*KEYS, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names], "n_edges", "sum_abs", "max_abs", "mean_weight")


def graph_vectorize(edges: DataFrame, pairs: list[tuple[str, str]], mode: str = "signed", standardise: bool = True) -> DataFrame:
    """Off-diagonal weights as columns: signed, absolute or binary, z-scored over all pixels."""
    value: Column = {"signed": F.col("weight"), "abs": F.abs("weight"), "binary": (F.col("weight") != 0).cast("double")}[mode]
    names = [f"{a}_{b}" for a, b in pairs]
    wide = edges.where("replicate = 0").withColumn("_f", F.concat("parent", F.lit("_"), "child")).withColumn("_v", value).groupBy(*KEYS).pivot("_f", names).agg(F.first("_v"))
    wide = wide.select(*KEYS, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names])
    if not standardise:
        return wide
    stats = wide.agg(*[x for n in names for x in (F.avg(n).alias(f"_m_{n}"), F.stddev_pop(n).alias(f"_s_{n}"))])
    z = lambda n: F.coalesce(F.try_divide(F.col(n) - F.col(f"_m_{n}"), F.when(F.col(f"_s_{n}") > 1e-12, F.col(f"_s_{n}"))), F.lit(0.0))
    return wide.crossJoin(F.broadcast(stats)).select(*KEYS, *[z(n).alias(n) for n in names])


Learner = Callable[[DataFrame, list[str]], DataFrame]


def correlation_skeleton(rows: DataFrame, variables: list[str], threshold: float = 0.1) -> DataFrame:
    """Default learner of :func:`pooled_discovery`: pairs whose correlation in the replicate reaches the threshold, from sums alone."""
    from terracause.functions.columns import safe_corr

    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1 :]]
    g = rows.groupBy("replicate").agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = g.select("replicate", F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])))
    return long.select("replicate", "a", "b", F.when(F.abs("r") >= threshold, "o-o").otherwise("none").alias("endpoint"))


def poisson_weights(panel: DataFrame, replicates: int, order: tuple[str, ...]) -> DataFrame:
    """Rows with a replicate and ``_k``, how often it takes the row: a Poisson draw from a hash, 0 left out. No join, no numbering of all rows."""
    from terracause.operators.sampling import draw

    rows = panel.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = draw("replicate", *order) / F.lit(2.0**32)
    # Poisson(1) by its distribution function: the usual bootstrap weights for very many rows
    limits = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885]
    times = sum(((u >= x).cast("int") for x in limits), F.lit(0))
    return rows.withColumn("_k", times).where("_k > 0")


def pooled_search(panel: DataFrame, variables: list[str], replicates: int, critical: float = 1.959963984540054, order: tuple[str, ...] = ("row", "col", "year", "month")) -> DataFrame:
    """Causal structure over all pixels: for each pair how many replicates link it, and with which ends.

    A replicate is one row of weighted sums of products (around the means of all rows), from which its
    correlations follow; the PC algorithm searches sets that separate pairs by partial correlations,
    then orients colliders and what follows from them. Ends: ``-->``, ``<--``, ``---``, ``<->`` or ``none``.
    Rows with a null don't count; a variable without variance is linked with nothing.
    """
    import numpy as np
    import pyarrow as pa

    from terracause.operators.linalg import orientations, separations

    d = len(variables)
    rows = panel.select(*order, *[F.col(v).cast("double").alias(f"_{i}") for i, v in enumerate(variables)]).na.drop(subset=[f"_{i}" for i in range(d)])
    means = rows.agg(*[F.avg(f"_{i}").alias(f"_m{i}") for i in range(d)])
    centred = rows.crossJoin(F.broadcast(means)).select(*order, *[(F.col(f"_{i}") - F.col(f"_m{i}")).alias(f"_{i}") for i in range(d)])
    k = F.col("_k")
    products = [F.sum(k * F.col(f"_{i}") * F.col(f"_{j}")) for i in range(d) for j in range(d)]
    sums = poisson_weights(centred, replicates, order).groupBy("replicate").agg(F.sum(k).cast("double").alias("n"), F.array(*[F.sum(k * F.col(f"_{i}")) for i in range(d)]).alias("s"), F.array(*products).alias("p"))
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]

    def run(batches):
        for b in batches:
            out = []
            for n, s, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                c = np.array(p).reshape(d, d) / n - np.outer(s, s) / n / n
                sd = np.sqrt(np.maximum(np.diag(c), 0))
                r = np.divide(c, np.outer(sd, sd), out=np.zeros_like(c), where=np.outer(sd, sd) > 0)
                np.fill_diagonal(r, 1.0)
                near, apart = separations(r, n, critical)
                head = orientations(near, apart)
                out += [(variables[i], variables[j], {(0, 0): "---", (1, 0): "-->", (0, 1): "<--", (1, 1): "<->"}[int(head[i, j]), int(head[j, i])] if near[i, j] else "none") for i, j in pairs]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["a", "b", "endpoint"])

    return sums.mapInArrow(run, "a string, b string, endpoint string").groupBy("a", "b", "endpoint").agg(F.count("*").alias("n"))


def pooled_discovery(panel: DataFrame, variables: list[str], replicates: int, learner: Learner = correlation_skeleton, order: tuple[str, ...] = ("row", "col", "year", "month")) -> DataFrame:
    """Resample the pooled rows, learn a structure on each replicate, count endpoints per pair.

    Each row is taken as often as a Poisson draw from its hash says, so replicates need no join and
    no numbering of all rows.
    """
    drawn = poisson_weights(panel.select(*order, *[v for v in variables if v not in order]), replicates, order).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")
    return learner(drawn, variables).groupBy("a", "b", "endpoint").agg(F.count("*").alias("n"))
