"""Checks of model assumptions: residual moments and dependence, lagged correlation, edge stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracause.functions.columns import binary_entropy, safe_corr
from terracause.operators.aggregates import stack

KEYS = ["row", "col"]


def pairs_of(variables: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(variables) for b in variables[i + 1 :]]


def pair_correlations(panel: DataFrame, variables: list[str], keys: list[str] | None = None) -> DataFrame:
    """Correlation of every pair of variables per pixel, from one aggregation."""
    keys = keys or KEYS
    g = panel.groupBy(*keys).agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs_of(variables)])
    return g.select(*keys, F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs_of(variables)])))


def data_diagnostics(panel: DataFrame, variables: list[str], near: float = 1e-8) -> DataFrame:
    """Rows, rows a variable, near-constant variables, largest and median absolute correlation."""
    rows = panel.na.drop(subset=variables)
    own = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.count("*") / len(variables)).alias("ratio"), sum((F.when(F.stddev_pop(v) <= near, 1).otherwise(0) for v in variables), F.lit(0)).alias("near_constant"))
    c = pair_correlations(rows, variables).groupBy(*KEYS).agg(F.max(F.abs("r")).alias("max_corr"), F.percentile(F.abs("r"), 0.5).alias("median_corr"))
    return own.join(c, KEYS, "left")


def rank_and_condition(panel: DataFrame, variables: list[str]) -> DataFrame:
    """Rank and condition number of the standardised design, from the correlation matrix of each pixel."""
    import numpy as np
    import pandas as pd

    r = pair_correlations(panel.na.drop(subset=variables), variables)
    d, at = len(variables), {v: i for i, v in enumerate(variables)}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = np.eye(d)
        for a, b, v in zip(g.a, g.b, g.r, strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = 0.0 if v is None or np.isnan(v) else v
        s = np.sqrt(np.clip(np.linalg.eigvalsh(m), 0, None))
        rank = int((s > s.max() * 1e-8).sum())
        return pd.DataFrame([(int(g["row"].iloc[0]), int(g["col"].iloc[0]), rank, float(s.max() / s.min()) if s.min() > 0 else None)], columns=["row", "col", "rank", "condition"])

    return r.groupBy(*KEYS).applyInPandas(run, "row int, col int, rank int, condition double")


def residual_moments(panel: DataFrame, variables: list[str], level: float = 0.05, least: int = 8) -> DataFrame:
    """Skewness, excess kurtosis and the Jarque-Bera probability exp(-JB/2) of each series; null below ``least`` rows."""
    rows = stack(panel, KEYS, variables, "variable").where("value is not null")
    g = rows.groupBy(*KEYS, "variable").agg(F.count("*").alias("n"), F.skewness("value").alias("_s"), F.kurtosis("value").alias("_k"))
    ok = F.col("n") >= least
    jb = F.col("n") / 6 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4)
    p = F.when(ok, F.exp(-jb / 2))
    return g.select(*KEYS, "variable", "n", F.when(ok, F.col("_s")).alias("skew"), F.when(ok, F.col("_k")).alias("kurtosis"), p.alias("p"), (p < level).alias("non_gaussian"))


def residual_dependence(panel: DataFrame, variables: list[str], threshold: float) -> DataFrame:
    """Largest and median absolute residual correlation, and pairs that reach the threshold."""
    r = pair_correlations(panel, variables)
    return r.groupBy(*KEYS).agg(F.max(F.abs("r")).alias("most"), F.percentile(F.abs("r"), 0.5).alias("median"), F.sum((F.abs("r") >= threshold).cast("int")).alias("n_pairs"))


def lag1_autocorr(panel: DataFrame, variables: list[str], least: int = 4) -> DataFrame:
    """Lag-1 correlation of each variable's rows within a pixel."""
    order = Window.partitionBy(*KEYS).orderBy("year", "month")
    lagged = panel.select(*KEYS, *variables, *[F.lag(v).over(order).alias(f"_l_{v}") for v in variables])
    g = lagged.groupBy(*KEYS).agg(F.count("*").alias("_n"), *[safe_corr(v, f"_l_{v}").alias(v) for v in variables])
    return stack(g.where(F.col("_n") >= least), KEYS, variables, "variable", "lag1")


def crosslag(panel: DataFrame, variables: list[str], lags: int) -> DataFrame:
    """Correlation of each variable with each variable's value ``lag`` rows before, for all lags."""
    order = Window.partitionBy(*KEYS).orderBy("year", "month")
    past = [(v, k) for v in variables for k in range(1, lags + 1)]
    rows = panel.select(*KEYS, *variables, *[F.lag(v, k).over(order).alias(f"_{k}_{v}") for v, k in past])
    all_ = [(a, b, k) for a in variables for b, k in past]
    g = rows.groupBy(*KEYS).agg(*[safe_corr(a, f"_{k}_{b}").alias(f"{a}|{b}|{k}") for a, b, k in all_])
    return g.select(*KEYS, F.inline(F.array(*[F.struct(F.lit(a).alias("now"), F.lit(b).alias("past"), F.lit(k).alias("lag"), F.col(f"{a}|{b}|{k}").alias("r")) for a, b, k in all_])))


def lagged_covariances(panel: DataFrame, variables: list[str], lags: int) -> DataFrame:
    """One row a pixel: n, and c, the covariances of each variable with each one's value h rows before, h from 0 to ``lags``, divisor n (flat: lag, now, before).

    Sums of products of centred columns; rows with a null don't count.
    """
    own, order = Window.partitionBy(*KEYS), Window.partitionBy(*KEYS).orderBy("year", "month")
    rows = panel.na.drop(subset=variables).select(*KEYS, "year", "month", *[(F.col(v) - F.avg(v).over(own)).alias(v) for v in variables])
    past = {(v, h): F.lag(v, h).over(order).alias(f"_{h}_{v}") for h in range(1, lags + 1) for v in variables}
    wide = rows.select(*KEYS, *variables, *past.values())
    name = lambda v, h: f"_{h}_{v}" if h else v
    sums = [F.coalesce(F.sum(F.col(a) * F.col(name(b, h))), F.lit(0.0)) / F.count("*") for h in range(lags + 1) for a in variables for b in variables]
    return wide.groupBy(*KEYS).agg(F.count("*").cast("int").alias("n"), F.array(*sums).alias("c"))


def _contributions(covariances: DataFrame, d: int, lags: int, schema: str, rows) -> DataFrame:
    """``rows`` of each batch of pixels: keys and n, and the portmanteau's contribution of each lag (pixels x lags)."""
    import numpy as np
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            if b.num_rows:
                n = b.column(2).to_numpy()
                c = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, lags + 1, d, d)
                inverse = np.linalg.pinv(np.nan_to_num(c[:, 0]), hermitian=True)[:, None]
                part = np.einsum("nhij,nhij->nh", inverse @ c[:, 1:], c[:, 1:] @ inverse)
                part *= n[:, None] * n[:, None].astype(float) / np.maximum(n[:, None] - np.arange(1, lags + 1), 1)
                yield pa.RecordBatch.from_arrays(rows(b.columns[:3], n, part), names)

    return covariances.mapInArrow(run, schema)


def portmanteau(panel: DataFrame, variables: list[str], lags: int, fitted: int = 0) -> DataFrame:
    """Adjusted multivariate portmanteau per pixel with its chi-square tail.

    Only a pixel's covariance matrices, lags + 1 times the variables squared, reach Python, many pixels at a time.
    A pixel with ``lags`` + 1 rows or fewer has null results.
    """
    import numpy as np
    import pyarrow as pa

    from terracause.operators.linalg import gamma_tail

    df = len(variables) ** 2 * (lags - fitted)

    def rows(keys, n, part):
        q, short = part.sum(1), n <= lags + 1
        p = np.array([gamma_tail(df / 2, x / 2) if df > 0 else np.nan for x in q])
        return [*keys, pa.array(q, mask=short), pa.array(np.full(len(n), df, np.int32), mask=short), pa.array(p, mask=short | np.isnan(p))]

    return _contributions(lagged_covariances(panel, variables, lags), len(variables), lags, "row int, col int, n int, q double, df int, p double", rows)


def portmanteau_by_lag(panel: DataFrame, variables: list[str], lags: int, fitted: int = 0) -> DataFrame:
    """The same lag by lag: what each adds (``part``), the statistic up to there with its degrees of freedom, and its tail (null up to the fitted lags)."""
    import numpy as np
    import pyarrow as pa

    from terracause.operators.linalg import gamma_tail

    df = len(variables) ** 2 * np.maximum(np.arange(1, lags + 1) - fitted, 0)

    def rows(keys, n, part):
        good = np.flatnonzero(n > lags + 1)
        take = pa.array(np.repeat(good, lags))
        q = np.cumsum(part, axis=1)[good]
        p = np.array([[gamma_tail(k / 2, x / 2) if k else np.nan for k, x in zip(df.tolist(), line, strict=True)] for line in q.tolist()]).reshape(-1)
        lag = np.tile(np.arange(1, lags + 1, dtype=np.int32), len(good))
        return [*[k.take(take) for k in keys], pa.array(lag), pa.array(part[good].ravel()), pa.array(q.ravel()), pa.array(np.tile(df.astype(np.int32), len(good))), pa.array(p, mask=np.isnan(p))]

    return _contributions(lagged_covariances(panel, variables, lags), len(variables), lags, "row int, col int, n int, lag int, part double, q double, df int, p double", rows)


def edge_stability(probability: DataFrame, near: float, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and largest entropy of edge probabilities, edges near the threshold, and pairs with both directions likely; per pixel, and ``by`` other columns of the edges."""
    keys = [*KEYS, *by]
    h = probability.withColumn("h", binary_entropy("probability"))
    own = h.groupBy(*keys).agg(F.count("*").alias("n_edges"), F.avg("h").alias("mean_entropy"), F.max("h").alias("max_entropy"), F.sum((F.abs(F.col("probability") - threshold) <= near).cast("int")).alias("near_threshold"))
    back = probability.select(*keys, F.col("child").alias("parent"), F.col("parent").alias("child"), F.col("probability").alias("_q"))
    both = probability.join(back, [*keys, "parent", "child"]).where((F.col("parent") < F.col("child")) & (F.least("probability", "_q") >= threshold)).groupBy(*keys).agg(F.count("*").alias("conflicts"))
    return own.join(both, keys, "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))


def lagged_edge_stability(probability: DataFrame, near: float, threshold: float) -> DataFrame:
    """One row a pixel: edge stability at once (lag 0) and of all later lags, the lag with the largest mean entropy, and the entropy over all edges together.

    Both directions of a pair conflict only within a month.
    """
    now = edge_stability(probability.where("lag = 0").drop("lag"), near, threshold)
    per = edge_stability(probability.where("lag > 0"), near, threshold, ("lag",))
    later = per.groupBy(*KEYS).agg(F.sum("n_edges").alias("lagged_edges"), (F.sum(F.col("mean_entropy") * F.col("n_edges")) / F.sum("n_edges")).alias("lagged_mean_entropy"), F.max("max_entropy").alias("lagged_max_entropy"), F.sum("near_threshold").alias("lagged_near_threshold"), F.max_by("lag", F.struct("mean_entropy", -F.col("lag"))).alias("least_sure_lag"))
    all_ = probability.withColumn("h", binary_entropy("probability")).groupBy(*KEYS).agg(F.avg("h").alias("combined_entropy"))
    return all_.join(now, KEYS, "left").join(later, KEYS, "left")


def assumption_flag(checks: list[Column], unstable: Column | None = None) -> Column:
    """True where any threshold is passed or the model is unstable; a check that is null doesn't count."""
    out = F.lit(False)
    for c in [*checks, *([unstable] if unstable is not None else [])]:
        out = out | F.coalesce(c, F.lit(False))
    return out
