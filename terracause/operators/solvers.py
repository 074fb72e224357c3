"""Per-pixel graph learning: one grouped-map task a pixel, or a pixel and replicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracause.operators.graphs import prior_knowledge
from terracause.operators.panel import window_pool
from terracause.operators.sampling import resample

EDGES = "row int, col int, replicate int, lag int, parent string, child string, weight double"
NAMES = [x.split()[0] for x in EDGES.split(", ")]


def _forbidden(variables: list[str], lags: dict[str, int] | None) -> set[tuple[int, int]]:
    pairs = prior_knowledge({v: (lags or {}).get(v, 0) for v in variables})
    return {(variables.index(p), variables.index(c)) for p, c in pairs}


def discover_instant(panel: DataFrame, variables: list[str], least: int = 50, reach: int = 0, lags: dict[str, int] | None = None) -> DataFrame:
    """DirectLiNGAM a pixel, over its window if ``reach`` is set; pixels with too few rows have no edges."""
    rows = panel.na.drop(subset=variables)
    if reach:
        pooled = window_pool(rows, reach, ["year", "month", *variables])
        rows = pooled.select(F.col("centre_row").alias("row"), F.col("centre_col").alias("col"), *variables)
    return _fit(rows.withColumn("replicate", F.lit(0)), variables, least, lags)


def bootstrap_edges(panel: DataFrame, variables: list[str], replicates: int, least: int = 50, lags: dict[str, int] | None = None) -> DataFrame:
    """The same on resampled rows; each replicate of each pixel is a group of its own."""
    rows = panel.na.drop(subset=variables).select("row", "col", "year", "month", *variables)
    return _fit(resample(rows, replicates), variables, least, lags)


def _fit(rows: DataFrame, variables: list[str], least: int, lags: dict[str, int] | None) -> DataFrame:
    import numpy as np
    import pandas as pd

    from terracause.operators.linalg import causal_order, weights_along

    forbidden = _forbidden(variables, lags)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < least:
            return pd.DataFrame(columns=NAMES)
        x = g.sort_values(variables)[variables].to_numpy(float)
        b = weights_along(x, causal_order(x, forbidden), forbidden)
        f = g.iloc[0]
        rows = [(int(f["row"]), int(f["col"]), int(f["replicate"]), 0, variables[p], variables[c], float(b[c, p])) for c, p in zip(*np.nonzero(b), strict=True)]
        if not rows and f["replicate"] > 0 and len(variables) > 1:
            # a replicate without edges counts: one row of weight 0
            rows = [(int(f["row"]), int(f["col"]), int(f["replicate"]), 0, variables[0], variables[1], 0.0)]
        return pd.DataFrame(rows, columns=NAMES)

    return rows.select("row", "col", "replicate", *variables).groupBy("row", "col", "replicate").applyInPandas(run, EDGES)


def whole_series(panel: DataFrame, variables: list[str], least: int) -> DataFrame:
    """One row a pixel with gap-free months and rows enough: n, and x, its values in order of time (months x variables, flat).

    A pixel's series is a few hundred months at most.
    """
    at = F.col("year") * 12 + F.col("month")
    one = F.struct(at.alias("at"), F.array(*[F.col(v).cast("double") for v in variables]).alias("v"))
    g = panel.na.drop(subset=variables).groupBy("row", "col").agg(F.count("*").alias("n"), F.min(at).alias("_a"), F.max(at).alias("_b"), F.countDistinct(at).alias("_k"), F.sort_array(F.collect_list(one)).alias("_s"))
    return g.where((F.col("n") >= least) & (F.col("_k") == F.col("n")) & (F.col("_b") - F.col("_a") + 1 == F.col("n"))).select("row", "col", "n", F.flatten(F.col("_s.v")).alias("x"))


def lagged_graphs(panel: DataFrame, variables: list[str], replicates: int = 0, most: int = 2, criterion: str = "bic", least: int = 50, prune: bool = True, lags: dict[str, int] | None = None, seed: int = 0, batch: int = 10) -> DataFrame:
    """VAR-LiNGAM edges a pixel: the fit (replicate 0), and refits on series of redrawn residuals (1 and up).

    The lag order is the fit's, by a criterion. A replicate starts like the series and goes on by the
    fitted dynamics with innovations drawn with replacement; all its weights, of every lag, come from
    that one series and stay together. A graph without edges has one row of weight 0, so that its
    replicate counts. ``batch`` replicates of a pixel are one row to a task, so that the
    replicates of a pixel are many tasks; draws depend on seed, pixel and replicate only.
    """
    import numpy as np
    import pandas as pd

    from terracause.operators.linalg import lag_order, lagged_weights, var_fit, var_redrawn

    forbidden, d = _forbidden(variables, lags), len(variables)
    series = whole_series(panel, variables, least)
    batches = [(a, min(a + batch, replicates + 1)) for a in range(0, replicates + 1, batch)]
    todo = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in batches]))
    dealt = series.withColumn("_b", todo).select("row", "col", "x", "_b.first", "_b.last")
    if replicates:
        dealt = dealt.repartition("row", "col", "first")

    def run(frames):
        for f in frames:
            out = []
            for row, col, x, first, last in zip(f["row"], f["col"], f["x"], f["first"], f["last"], strict=True):
                x = np.asarray(x, float).reshape(-1, d)
                x = x - x.mean(0)
                p = lag_order(x, most, criterion)
                a, e = var_fit(x, p)
                e = e - e.mean(0)
                for r in range(int(first), int(last)):
                    y = x if r == 0 else var_redrawn(a, e, x, np.random.default_rng([seed, int(row) & 0xFFFFFFFF, int(col) & 0xFFFFFFFF, r]).integers(len(e), size=len(x) - p))
                    found = [(int(row), int(col), r, lag, variables[j], variables[i], float(b[i, j])) for lag, b in enumerate(lagged_weights(y, p, forbidden, prune)) for i, j in zip(*np.nonzero(b), strict=True)]
                    out += found or [(int(row), int(col), r, p, variables[0], variables[0], 0.0)]
            yield pd.DataFrame(out, columns=NAMES)

    return dealt.mapInPandas(run, EDGES)


def discover_lagged(panel: DataFrame, variables: list[str], most: int = 2, criterion: str = "bic", least: int = 50, prune: bool = True, lags: dict[str, int] | None = None) -> DataFrame:
    """VAR-LiNGAM a pixel with gap-free months: lag order by a criterion, LiNGAM on the innovations, all lags pruned together."""
    return lagged_graphs(panel, variables, 0, most, criterion, least, prune, lags)


def whiteness_bootstrap(panel: DataFrame, variables: list[str], lags: int, fitted: int, samples: int, pixels: int, seed: int = 0, burn: int = 200, batch: int = 25) -> DataFrame:
    """Probability of a portmanteau as large under the fitted VAR, by simulation; a stated number of pixels in hash order.

    A pixel's samples are dealt in batches to many tasks, each of which counts those that reach its
    statistic; the counts are summed. A sample's draws depend on seed, pixel and sample only.
    """
    import numpy as np
    import pandas as pd

    from terracause.operators.linalg import portmanteau_each, var_fit, var_residuals_each
    from terracause.operators.sampling import draw

    d, least = len(variables), 3 * (lags + fitted)
    chosen = panel.select("row", "col").distinct().orderBy(draw(F.lit(seed), "row", "col"), "row", "col").limit(pixels)
    one = F.struct((F.col("year") * 12 + F.col("month")).alias("at"), F.array(*[F.col(v).cast("double") for v in variables]).alias("v"))
    # the chosen pixels are a bounded number of keys
    rows = panel.join(F.broadcast(chosen), ["row", "col"], "left_semi").na.drop(subset=variables)
    series = rows.groupBy("row", "col").agg(F.flatten(F.sort_array(F.collect_list(one))["v"]).alias("x"))
    todo = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(min(a + batch, samples)).alias("last")) for a in range(0, samples, batch)]))
    dealt = series.withColumn("_b", todo).select("row", "col", "x", "_b.first", "_b.last").repartition("row", "col", "first")

    def run(frames):
        for f in frames:
            out = []
            for row, col, x, first, last in zip(f["row"], f["col"], f["x"], f["first"], f["last"], strict=True):
                x = np.asarray(x, float).reshape(-1, d)
                key = (int(row), int(col))
                if len(x) <= least:
                    out.append((*key, None, 0))
                    continue
                x = x - x.mean(0)
                a, e = var_fit(x, fitted, intercept=False)
                q = float(portmanteau_each(e[None], lags)[0])
                c, n = e - e.mean(0), len(x) + burn
                y = np.stack([c[np.random.default_rng([seed, key[0] & 0xFFFFFFFF, key[1] & 0xFFFFFFFF, s]).integers(len(c), size=n)] for s in range(int(first), int(last))])
                y[:, :fitted] = 0
                for t in range(fitted, n):
                    for k in range(fitted):
                        y[:, t] += y[:, t - 1 - k] @ a[k].T
                out.append((*key, q, int((portmanteau_each(var_residuals_each(y[:, burn:], fitted), lags) >= q).sum())))
            yield pd.DataFrame(out, columns=["row", "col", "q", "beaten"])

    counts = dealt.mapInPandas(run, "row int, col int, q double, beaten long")
    return counts.groupBy("row", "col").agg(F.max("q").alias("q"), F.sum("beaten").alias("_k")).select("row", "col", "q", F.when(F.col("q").isNotNull(), (1 + F.col("_k")) / (samples + 1)).alias("p"))


def var_refit(panel: DataFrame, variables: list[str], lags: int = 1) -> DataFrame:
    """Intercept-free reduced-form VAR of centred series: coefficients as long rows, from sums of products of lagged columns."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    own, order = Window.partitionBy("row", "col"), Window.partitionBy("row", "col").orderBy("year", "month")
    centred = panel.select("row", "col", "year", "month", *[(F.col(v) - F.avg(v).over(own)).alias(v) for v in variables])
    past = [(v, k) for k in range(1, lags + 1) for v in variables]
    rows = centred.select("row", "col", *variables, *[F.lag(v, k).over(order).alias(f"{v}_{k}") for v, k in past]).na.drop()
    xs = [f"{v}_{k}" for v, k in past]
    sums = rows.groupBy("row", "col").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in xs for b in [*xs, *variables]])

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                g = np.array([[r[f"{a}|{b}"] for b in xs] for a in xs])
                coef = np.linalg.pinv(g) @ np.array([[r[f"{a}|{v}"] for v in variables] for a in xs])
                out += [(r["row"], r["col"], k, v, c, float(coef[i, j])) for i, (v, k) in enumerate(past) for j, c in enumerate(variables)]
            yield pd.DataFrame(out, columns=["row", "col", "lag", "parent", "child", "weight"])

    return sums.mapInPandas(run, "row int, col int, lag int, parent string, child string, weight double")


def map_pixels(panel: DataFrame, fn, schema: str, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """A user's function on every pixel's rows; an exception becomes the ``error`` column of that pixel's one row."""
    import pandas as pd
    from pyspark.sql.types import StructType

    full = StructType.fromDDL(f"{schema}, error string")
    names = full.fieldNames()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fn(g)
            out["error"] = None
        except Exception as e:  # the contract: failures are rows
            out = pd.DataFrame([{**{k: g[k].iloc[0] for k in keys}, "error": str(e)}])
        return out.reindex(columns=names)

    return panel.groupBy(*keys).applyInPandas(run, full)
