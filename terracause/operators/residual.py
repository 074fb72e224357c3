"""Seasonal residuals and grouped least squares, from sums alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["row", "col"]


def residualize_monthly(panel: DataFrame, variables: list[str], fit_end_year: int, trend: bool = True, least: int = 24, least_month: int = 2) -> DataFrame:
    """``<v>_expected``, ``<v>_resid`` and ``<v>_status``: month effects and a linear trend, fitted up to ``fit_end_year``.

    Frisch-Waugh: with month means removed from the series and from time, the trend is one slope;
    the fit needs two aggregations and no matrix.
    """
    t = F.col("year") * 12 + F.col("month") - 1
    # one shuffle by pixel serves the windows by pixel and by pixel and month of all variables
    out = panel.repartition(*KEYS).withColumn("_t", t.cast("double"))
    for v in variables:
        used = F.when((F.col("year") <= fit_end_year) & F.col(v).isNotNull(), 1)
        month = Window.partitionBy(*KEYS, "month")
        ym, tm = F.avg(F.when(used == 1, F.col(v))).over(month), F.avg(F.when(used == 1, F.col("_t"))).over(month)
        out = out.withColumns({"_u": used, "_ym": ym, "_tm": tm, "_nm": F.count(used).over(month)})
        pixel = Window.partitionBy(*KEYS)
        dt, dy = F.col("_t") - F.col("_tm"), F.col(v) - F.col("_ym")
        sxy, sxx = F.sum(F.when(F.col("_u") == 1, dt * dy)).over(pixel), F.sum(F.when(F.col("_u") == 1, dt * dt)).over(pixel)
        fewest = F.min(F.coalesce("_nm", F.lit(0))).over(pixel)
        kinds = F.size(F.collect_set(F.when(F.col("_nm") > 0, F.col("month"))).over(pixel))
        out = out.withColumns({"_sxy": sxy, "_sxx": sxx, "_n": F.count("_u").over(pixel), "_few": F.when(kinds < 12, 0).otherwise(fewest)})
        slope = F.coalesce(F.try_divide("_sxy", F.when(F.col("_sxx") > 1e-12, F.col("_sxx"))), F.lit(0.0)) if trend else F.lit(0.0)
        status = F.when(F.col("_n") < least, "too_few_fit_samples").when(F.col("_few") < least_month, "too_few_samples_in_calendar_month")
        if trend:
            status = status.when(F.coalesce("_sxx", F.lit(0.0)) <= 1e-12, "design_rank_deficient")
        status = status.otherwise("fit")
        out = out.withColumn(f"{v}_status", status)
        expected = F.when(F.col(f"{v}_status") == "fit", F.col("_ym") + slope * (F.col("_t") - F.col("_tm")))
        out = out.withColumn(f"{v}_expected", expected).withColumn(f"{v}_resid", F.col(v) - F.col(f"{v}_expected"))
    return out.drop("_t", "_u", "_ym", "_tm", "_nm", "_sxy", "_sxx", "_n", "_few")


def residual_models(panel: DataFrame, variable: str, fit_end_year: int) -> DataFrame:
    """One row a pixel: samples, counts by month, trend per month, time centre, R2 and residual deviation of the fit."""
    fit = residualize_monthly(panel, [variable], fit_end_year).where((F.col("year") <= fit_end_year) & F.col(variable).isNotNull())
    t = (F.col("year") * 12 + F.col("month") - 1).cast("double")
    month = fit.withColumn("_t", t).groupBy(*KEYS, "month").agg(F.count("*").alias("n"), F.avg(variable).alias("_ym"), F.avg("_t").alias("_tm"))
    rows = fit.withColumn("_t", t).join(month, [*KEYS, "month"])
    dt = F.col("_t") - F.col("_tm")
    sums = rows.groupBy(*KEYS).agg(
        F.count("*").alias("n_samples"), F.try_divide(F.sum(dt * (F.col(variable) - F.col("_ym"))), F.sum(dt * dt)).alias("trend"), F.avg("_t").alias("time_centre"),
        (1 - F.try_divide(F.sum(F.col(f"{variable}_resid") * F.col(f"{variable}_resid")), F.var_pop(variable) * F.count("*"))).alias("r2"), F.stddev_pop(f"{variable}_resid").alias("residual_sd"), F.first(f"{variable}_status").alias("status"),
    )
    counts = month.groupBy(*KEYS).agg(F.min("n").alias("min_month_count"), F.count("*").alias("n_month_effects"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("month_"), F.lpad("month", 2, "0")), "_ym")))).alias("month_means"))
    return sums.join(counts, KEYS).withColumn("n_parameters", F.col("n_month_effects") + 1)


def grouped_sums(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Counts, sums and cross products of complete rows: all that least squares needs, one row a group."""
    rows = df.na.drop(subset=[y, *xs])
    names = [y, *xs]
    out = [F.count("*").alias("n"), *[F.sum(v).alias(f"s_{v}") for v in names]]
    out += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*keys).agg(*out)


def _centred(a: str, b: str) -> Column:
    return F.col(f"p_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")


def grouped_ols(df: DataFrame, keys: list[str], y: str, xs: list[str], alpha: float = 0.0) -> DataFrame:
    """Intercept and slopes per group; ``alpha`` is a ridge on the slopes, the intercept is never penalised.

    One or two regressors are solved in closed form; more go to NumPy, one row of sums a group.
    """
    # deviations from a rough centre keep the products small
    sums = grouped_sums(df, keys, y, xs)
    if len(xs) == 1:
        b = F.try_divide(_centred(y, xs[0]), F.nullif(_centred(xs[0], xs[0]) + alpha, F.lit(0.0)))
        slopes = [b]
    elif len(xs) == 2:
        a11, a22, a12 = _centred(xs[0], xs[0]) + alpha, _centred(xs[1], xs[1]) + alpha, _centred(xs[0], xs[1])
        c1, c2 = _centred(y, xs[0]), _centred(y, xs[1])
        det = a11 * a22 - a12 * a12
        det = F.when(F.abs(det) > 1e-12, det)
        slopes = [(c1 * a22 - c2 * a12) / det, (c2 * a11 - c1 * a12) / det]
    else:
        return _solved(sums, keys, y, xs, alpha)
    with_slopes = sums.select(*keys, "n", *[f"s_{v}" for v in (y, *xs)], *[b.alias(f"b_{x}") for b, x in zip(slopes, xs, strict=True)])
    intercept = F.col(f"s_{y}") / F.col("n")
    for x in xs:
        intercept = intercept - F.col(f"b_{x}") * F.col(f"s_{x}") / F.col("n")
    return with_slopes.select(*keys, "n", intercept.alias("intercept"), *[f"b_{x}" for x in xs])


def _solved(sums: DataFrame, keys: list[str], y: str, xs: list[str], alpha: float) -> DataFrame:
    import numpy as np
    import pandas as pd

    from terracause.operators.linalg import solve

    schema = sums.select(*keys, "n").withColumns({"intercept": F.lit(0.0), **{f"b_{x}": F.lit(0.0) for x in xs}}).schema
    names = [y, *xs]

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                cross = lambda a, b: r[f"p_{a}_{b}"] - r[f"s_{a}"] * r[f"s_{b}"] / r["n"]  # noqa: B023, E731
                m = np.array([[cross(*sorted((a, b), key=names.index)) for b in xs] for a in xs]) + alpha * np.eye(len(xs))
                b = solve(m, np.array([cross(y, x) for x in xs]))
                out.append([*[r[k] for k in keys], r["n"], r[f"s_{y}"] / r["n"] - sum(v * r[f"s_{x}"] / r["n"] for v, x in zip(b, xs, strict=True)), *b])
            yield pd.DataFrame(out, columns=[*keys, "n", "intercept", *[f"b_{x}" for x in xs]])

    return sums.mapInPandas(run, schema)


def residualize_harmonic(panel: DataFrame, variable: str, fit_end_year: int, trend: bool = True) -> DataFrame:
    """Expected value and residual from an intercept, one annual harmonic and a trend."""
    angle = F.col("month") * (2 * 3.141592653589793) / 12
    t = (F.col("year") * 12 + F.col("month") - 1 - 24000).cast("double") / 12
    xs = ["_sin", "_cos"] + (["_t"] if trend else [])
    rows = panel.withColumns({"_sin": F.sin(angle), "_cos": F.cos(angle), "_t": t})
    fit = grouped_ols(rows.where(F.col("year") <= fit_end_year), KEYS, variable, xs)
    expected = F.col("intercept")
    for x in xs:
        expected = expected + F.col(f"b_{x}") * F.col(x)
    return rows.join(fit.drop("n"), KEYS).withColumn(f"{variable}_expected", expected).withColumn(f"{variable}_resid", F.col(variable) - expected).drop("_sin", "_cos", "_t", "intercept", *[f"b_{x}" for x in xs])


def standard_climatology(panel: DataFrame, variable: str) -> DataFrame:
    """Monthly mean, count, deviation and standard error of each pixel's z-scored series."""
    own = Window.partitionBy(*KEYS)
    sd = F.stddev_pop(variable).over(own)
    z = panel.withColumn("_z", F.try_divide(F.col(variable) - F.avg(variable).over(own), F.when(sd > 0, sd)))
    return z.groupBy(*KEYS, "month").agg(F.count("_z").alias("n"), F.avg("_z").alias("mean"), F.stddev_pop("_z").alias("sd"), F.try_divide(F.stddev_pop("_z"), F.sqrt(F.count("_z"))).alias("sem"))


def residual_report(panel: DataFrame, variable: str, residual: str, expected: str) -> DataFrame:
    """Before and after: mean, deviation, R2 of the expectation, harmonic amplitude, range of month means, lag-1 correlation, identity error."""
    from terracause.functions.columns import safe_corr

    order = Window.partitionBy(*KEYS).orderBy("year", "month")
    angle = (F.col("month") - 1) * (2 * 3.141592653589793) / 12
    rows = panel.where(F.col(residual).isNotNull()).withColumns({"_l": F.lag(variable).over(order), "_m": F.lag(residual).over(order), "_sin": F.sin(angle), "_cos": F.cos(angle)})
    month = rows.groupBy(*KEYS, "month").agg(F.avg(variable).alias("_a"), F.avg(residual).alias("_b"))
    ranges = month.groupBy(*KEYS).agg((F.max("_a") - F.min("_a")).alias("range_before"), (F.max("_b") - F.min("_b")).alias("range_after"))
    wave = grouped_ols(rows, KEYS, variable, ["_sin", "_cos"]).select(*KEYS, F.sqrt(F.col("b__sin") * F.col("b__sin") + F.col("b__cos") * F.col("b__cos")).alias("amplitude"))
    own = rows.groupBy(*KEYS).agg(
        F.avg(variable).alias("mean_before"), F.avg(residual).alias("mean_after"), F.stddev_pop(variable).alias("sd_before"), F.stddev_pop(residual).alias("sd_after"), (1 - F.try_divide(F.var_pop(residual), F.var_pop(variable))).alias("explained"),
        safe_corr(variable, "_l").alias("lag1_before"), safe_corr(residual, "_m").alias("lag1_after"), F.max(F.abs(F.col(variable) - F.col(expected) - F.col(residual))).alias("identity_error"),
    )
    return own.join(ranges, KEYS).join(wave, KEYS)
