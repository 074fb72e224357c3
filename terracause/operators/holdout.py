"""Held-out prediction from graphs, and skill by resampling of spatial blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracause.functions.columns import finite_or_null
from terracause.operators.ranks import ranked
from terracause.operators.sampling import draw

KEYS = ["row", "col"]


def holdout_months(years: DataFrame, lead: int) -> DataFrame:
    """Model month of every observed month of the years, ``lead`` months earlier; a year named twice is refused."""
    if years.groupBy("year").count().where("count > 1").limit(1).count():
        raise ValueError("a year is named twice")
    m = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    at = F.col("year") * 12 + F.col("month") - 1 - lead
    return m.select(F.floor(at / 12).cast("int").alias("model_year"), (F.pmod(at, F.lit(12)) + 1).cast("int").alias("model_month"), F.col("year").alias("observed_year"), F.col("month").alias("observed_month"))


def parents_of(edges: DataFrame, panel: DataFrame) -> list[str]:
    """Parents that edges name: at most the panel's columns; others are refused."""
    inside = F.col("parent").isin(*panel.columns)
    other = sorted(r["parent"] for r in edges.where(~inside).select("parent").distinct().limit(5).collect())
    if other:
        raise ValueError(f"parents that the panel doesn't have: {', '.join(other)}")
    return sorted(r["parent"] for r in edges.where(inside).select("parent").distinct().collect())


def predict_level(panel: DataFrame, edges: DataFrame, target: str, train_end: int) -> DataFrame:
    """Forecast of a pixel's target from its parents: the intercept puts the training means on the line.

    ``edges`` has row, col, parent, weight of the target's parents.
    """
    parents = parents_of(edges, panel)
    own = edges.groupBy(*KEYS).pivot("parent", parents).agg(F.first("weight"))
    means = panel.where(F.col("year") <= train_end).groupBy(*KEYS).agg(F.avg(target).alias("_y"), *[F.avg(p).alias(f"_m_{p}") for p in parents])
    weights = own.select(*KEYS, *[F.coalesce(F.col(p), F.lit(0.0)).alias(f"_w_{p}") for p in parents])
    rows = panel.where(F.col("year") > train_end).join(means, KEYS).join(weights, KEYS)
    value = F.col("_y")
    for p in parents:
        value = value + F.col(f"_w_{p}") * (F.col(p) - F.col(f"_m_{p}"))
    return rows.select(*KEYS, "year", "month", F.col(target).alias("observed"), value.alias("predicted"))


def _ridge_slopes(fit: DataFrame, k: int, alpha: float) -> DataFrame:
    """``_b<i>``: slopes of a ridge on k regressors, from their covariances ``_p<i>_<j>`` and ``_c<i>`` with the target over ``_n`` rows.

    One regressor is closed form; more go to NumPy, one row a group. Without a penalty, singular fits have the shortest slopes.
    """
    if k == 1:
        size = F.col("_p0_0") * F.col("_n") + alpha
        return fit.withColumn("_b0", F.when(size > 0, F.col("_c0") * F.col("_n") / size).otherwise(0.0))
    import numpy as np

    def slopes(m, c):
        if alpha > 0:
            try:
                return np.linalg.solve(m, c)
            except np.linalg.LinAlgError:  # the penalty is lost beside huge products
                pass
        return np.linalg.pinv(m, hermitian=True) @ c

    def run(frames):
        for f in frames:
            m = np.empty((len(f), k, k))
            for i in range(k):
                for j in range(i + 1):
                    m[:, i, j] = m[:, j, i] = f[f"_p{i}_{j}"] * f["_n"]
            c = np.stack([f[f"_c{i}"] * f["_n"] for i in range(k)], axis=1)
            b = slopes(m + alpha * np.eye(k), c[:, :, None])
            yield f.assign(**{f"_b{i}": b[:, i, 0] for i in range(k)})

    return fit.mapInPandas(run, fit.withColumns({f"_b{i}": F.lit(0.0) for i in range(k)}).schema)


def predict_response(panel: DataFrame, edges: DataFrame, target: str, train_end: int, least: int, alpha: float = 1.0) -> DataFrame:
    """Anomaly forecast per month: weights times the parents' departures from their month means; two baselines.

    ``ridge`` refits the slopes of a pixel's own parents on the month's training departures, with
    ``alpha`` as penalty; ``persistence`` is last year's anomaly. An edge without a finite weight, or of
    weight 0, names no parent. Rows without the target or a parent of their pixel are neither fitted nor forecast.
    """
    parents = parents_of(edges, panel)
    k = len(parents)
    own = edges.groupBy(*KEYS).pivot("parent", parents).agg(F.first("weight")).select(*KEYS, *[F.coalesce(finite_or_null(p), F.lit(0.0)).alias(f"_w{i}") for i, p in enumerate(parents)])
    # 0 for what isn't a parent of the pixel: no part of its forecast, and a slope of 0
    values = [F.when(F.col(f"_w{i}") != 0, finite_or_null(p)).otherwise(0.0).alias(f"_x{i}") for i, p in enumerate(parents)]
    rows = panel.join(own, KEYS).select(*KEYS, "year", "month", finite_or_null(target).alias("_t"), *[f"_w{i}" for i in range(k)], *values).na.drop(subset=["_t", *[f"_x{i}" for i in range(k)]])
    means = [F.count("*").alias("_n"), F.avg("_t").alias("_y"), *[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(k)]]
    products = [*[F.covar_pop("_t", f"_x{i}").alias(f"_c{i}") for i in range(k)], *[F.covar_pop(f"_x{i}", f"_x{j}").alias(f"_p{i}_{j}") for i in range(k) for j in range(i + 1)]]
    clim = rows.where(F.col("year") <= train_end).groupBy(*KEYS, "month").agg(*means, *products).where(F.col("_n") >= least)
    fit = _ridge_slopes(clim, k, alpha) if k else clim
    before = rows.select(*KEYS, (F.col("year") + 1).alias("year"), "month", F.col("_t").alias("_last"))
    both = rows.where(F.col("year") > train_end).join(fit, [*KEYS, "month"]).join(before, [*KEYS, "year", "month"], "left")
    value, ridge = F.lit(0.0), F.lit(0.0)
    for i in range(k):
        away = F.col(f"_x{i}") - F.col(f"_m{i}")
        value, ridge = value + F.col(f"_w{i}") * away, ridge + F.col(f"_b{i}") * away
    return both.select(*KEYS, "year", "month", (F.col("_t") - F.col("_y")).alias("observed"), value.alias("predicted"), ridge.alias("ridge"), (F.col("_last") - F.col("_y")).alias("persistence"))


def prediction_status(wanted: DataFrame, edges: DataFrame, training: DataFrame, evaluation: DataFrame, variables: list[str], least: int) -> DataFrame:
    """Why a pixel has no forecast for a month, or ``predicted``; with the names of missing values."""
    have = edges.groupBy(*KEYS).agg(F.count("*").alias("_parents"))
    size = training.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    rows = wanted.join(have, KEYS, "left").join(size, KEYS, "left").join(evaluation.withColumn("_row", F.lit(True)), [*KEYS, "year", "month"], "left")
    gone = F.concat_ws(",", *[F.when(F.col(v).isNull(), v) for v in variables])
    status = F.when(F.col("_parents").isNull(), "no_parents").when(F.col("_n").isNull(), "no_training_rows").when(F.col("_n") < least, "too_few_samples").when(F.col("_row").isNull(), "row_absent").when(gone != "", "values_missing").otherwise("predicted")
    return rows.select(*KEYS, "year", "month", status.alias("status"), F.when(status == "values_missing", gone).otherwise("").alias("missing"))


def training_guard(metadata: DataFrame, train_end: int) -> DataFrame:
    """Refuses graphs that were trained on later years than the evaluation allows."""
    late = metadata.where(F.col("last_year") > train_end).limit(1).collect()
    if late:
        raise ValueError(f"a graph was trained up to {late[0]['last_year']}, after {train_end}")
    return metadata


def block_bootstrap_skill(errors: DataFrame, replicates: int) -> DataFrame:
    """Paired skill of two models with an interval from resampled spatial blocks.

    ``errors`` has block, a and b (errors of the model and the baseline). Rows are summed to
    blocks once; replicates draw blocks, so their work grows with blocks, not rows.
    """
    block = errors.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("a")).alias("qa"), F.sum(F.col("b") * F.col("b")).alias("qb"), F.sum(F.abs("a")).alias("sa"), F.sum(F.abs("b")).alias("sb"))
    numbered = ranked(block, [F.asc("block")], "i").withColumn("i", F.col("i").cast("int"))
    size = numbered.agg(F.count("*").alias("k"))
    draws = numbered.select("i").crossJoin(F.broadcast(size)).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select("replicate", (draw("replicate", "i") % F.col("k")).cast("int").alias("i"))
    drawn = draws.join(numbered, "i").select("replicate", "n", "qa", "qb", "sa", "sb").unionByName(block.select(F.lit(0).alias("replicate"), "n", "qa", "qb", "sa", "sb"))
    sums = drawn.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n", "qa", "qb", "sa", "sb")])
    rmse = lambda c: F.sqrt(F.col(c) / F.col("n"))
    each = sums.select("replicate", (1 - rmse("qa") / rmse("qb")).alias("skill"), (rmse("qa") - rmse("qb")).alias("delta_rmse"), ((F.col("sa") - F.col("sb")) / F.col("n")).alias("delta_mae"))
    boot = F.col("replicate") > 0
    pick = lambda c, q: F.percentile(F.when(boot, F.col(c)), q)
    return each.agg(
        F.max(F.when(~boot, F.col("skill"))).alias("skill"), pick("skill", 0.025).alias("skill_low"), pick("skill", 0.975).alias("skill_high"), F.max(F.when(~boot, F.col("delta_rmse"))).alias("delta_rmse"), pick("delta_rmse", 0.025).alias("delta_rmse_low"), pick("delta_rmse", 0.975).alias("delta_rmse_high"),
        F.max(F.when(~boot, F.col("delta_mae"))).alias("delta_mae"), F.avg(F.when(boot, (F.col("delta_rmse") < 0).cast("double"))).alias("p_better"),
    )
