"""Summaries of effects, classes, diagnostics and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracause.functions.columns import safe_corr


def stack(df: DataFrame, keys: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row a key and metric; nulls stay."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias(name), F.col(v).cast("double").alias(value)) for v in values])))


def quantile(c: str | Column, q: float) -> Column:
    return F.percentile(F.col(c) if isinstance(c, str) else c, q)


def json_records(df: DataFrame, cell: str, fields: str, keys: list[str]) -> DataFrame:
    """The records of a column of JSON lists; malformed lists give no rows."""
    read = F.from_json(cell, f"array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split() for x in fields.split(', ')))}>>")
    rows = df.select(*keys, F.explode(read).alias("_r")).where("_r is not null").select(*keys, "_r.*")
    return rows.dropna(how="all", subset=[x.split()[0] for x in fields.split(", ")])


def climatology_anomaly(panel: DataFrame, variable: str, year: int, first: int | None = None, last: int | None = None) -> DataFrame:
    """Mean anomaly and z-score of a year against the other years' month means, per pixel."""
    base = panel.where(F.col("year") != year)
    if first is not None:
        base = base.where(F.col("year") >= first)
    if last is not None:
        base = base.where(F.col("year") <= last)
    clim = base.groupBy("row", "col", "month").agg(F.avg(variable).alias("_mean"), F.stddev_pop(variable).alias("_sd"))
    now = panel.where(F.col("year") == year).groupBy("row", "col", "month").agg(F.avg(variable).alias("_now"))
    diff = now.join(clim, ["row", "col", "month"]).withColumn("_a", F.col("_now") - F.col("_mean"))
    return diff.groupBy("row", "col").agg(F.avg("_a").alias("anomaly"), F.avg(F.try_divide(F.col("_a"), F.when(F.col("_sd") > 0, F.col("_sd")))).alias("zscore"), F.count("_a").alias("n_months"))


def class_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """n, mean, median, sample deviation and quartiles of each metric per key."""
    g = stack(df, keys, metrics).where("value is not null").groupBy(*keys, "metric")
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), quantile("value", 0.5).alias("median"), F.stddev_samp("value").alias("sd"), quantile("value", 0.25).alias("q25"), quantile("value", 0.75).alias("q75"))


def class_indicator_corr(df: DataFrame, klass: str, value: str, keys: list[str]) -> DataFrame:
    """Correlation of a value with membership in each class, with the means in and out of it.

    From per-class sums: for a 0/1 indicator the correlation is a function of counts, means and
    the overall deviation, so rows are never multiplied by classes.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(klass).isNotNull())
    own = rows.groupBy(*keys, klass).agg(F.count("*").alias("n_class"), F.sum(value).alias("s"))
    all_ = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.stddev_pop(value).alias("sd"))
    j = own.join(all_, keys) if keys else own.crossJoin(F.broadcast(all_))
    share = F.col("n_class") / F.col("n")
    mean_in, mean_out = F.col("s") / F.col("n_class"), F.try_divide(F.col("total") - F.col("s"), F.col("n") - F.col("n_class"))
    corr = F.when((F.col("n") >= 3) & (share < 1) & (F.col("sd") > 1e-12), (mean_in - mean_out) * F.sqrt(share * (1 - share)) / F.col("sd"))
    return j.select(*keys, klass, "n", share.alias("fraction"), corr.alias("corr"), mean_in.alias("class_mean"), mean_out.alias("other_mean"), (F.col("total") / F.col("n")).alias("overall_mean"), (mean_in - mean_out).alias("difference"))


def class_heatmap(summary: DataFrame, source: str, klass: str, value: str, classes: list, top: int) -> DataFrame:
    """The ``top`` sources by largest absolute value, one column a class."""
    best = summary.groupBy(source).agg(F.max(F.abs(value)).alias("_m"))
    # one row a source
    kept = best.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("_m"), source))).where(F.col("_k") <= top).select(source)
    return summary.join(F.broadcast(kept), source).groupBy(source).pivot(klass, classes).agg(F.first(value))


def filter_funnel(df: DataFrame, stages: list[tuple[str, Column]], klass: str) -> DataFrame:
    """Samples and classes left after each of the conditions in turn, in one pass."""
    so_far, aggs = F.lit(True), []
    for name, condition in stages:
        so_far = so_far & F.coalesce(condition, F.lit(False))
        aggs += [F.sum(so_far.cast("long")).alias(f"n_{name}"), F.countDistinct(F.when(so_far, F.col(klass))).alias(f"k_{name}")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(name).alias("filter"), F.coalesce(F.col(f"n_{name}"), F.lit(0)).alias("n_samples"), F.col(f"k_{name}").alias("n_classes")) for i, (name, _) in enumerate(stages)])))


def class_retain(df: DataFrame, klass: str, least: int) -> DataFrame:
    """Rows of classes with ``least`` rows or more."""
    big = df.groupBy(klass).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(klass)
    return df.join(big, klass, "left_semi")


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric: finite count, missing share, mean, population deviation, extremes and quantiles."""
    v = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return stack(df, [], metrics).withColumn("value", v).groupBy("metric").agg(
        F.count("value").alias("n"), (1 - F.count("value") / F.count("*")).alias("missing"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("least"), quantile("value", 0.05).alias("q05"), quantile("value", 0.5).alias("median"), quantile("value", 0.95).alias("q95"), F.max("value").alias("most")
    )


def model_pair_compare(first: DataFrame, second: DataFrame, metric: str) -> DataFrame:
    """n, median and outer quantiles of a metric in two runs and of its change, over the pixels of both."""
    both = first.select("row", "col", F.col(metric).alias("first")).join(second.select("row", "col", F.col(metric).alias("second")), ["row", "col"]).withColumn("change", F.col("second") - F.col("first"))
    rows = stack(both, [], ["first", "second", "change"], "model").where("value is not null")
    return rows.groupBy("model").agg(F.count("*").alias("n"), quantile("value", 0.5).alias("median"), quantile("value", 0.05).alias("q05"), quantile("value", 0.95).alias("q95"))


def effect_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stable, error-free pixels per key: moments, quantiles, signs, and how often the interval leaves zero out."""
    rows = df.where("error is null and stable")
    outside = ((F.col("low") > 0) | (F.col("high") < 0)).cast("double")
    return rows.groupBy(*keys).agg(
        F.count("effect").alias("n"), F.avg("effect").alias("mean"), quantile("effect", 0.5).alias("median"), quantile("effect", 0.05).alias("q05"), quantile("effect", 0.95).alias("q95"),
        F.avg((F.col("effect") > 0).cast("double")).alias("positive"), quantile("cumulative", 0.5).alias("cumulative_median"), F.avg(outside).alias("excludes_zero"), quantile("sd", 0.5).alias("median_sd"),
    )


def map_summary(df: DataFrame, horizon: int) -> DataFrame:
    """Per source at one horizon: n, quantiles, positive and supported shares."""
    outside = ((F.col("low") > 0) | (F.col("high") < 0)).cast("double")
    return df.where((F.col("horizon") == horizon) & F.col("effect").isNotNull()).groupBy("source").agg(
        F.count("*").alias("n"), quantile("effect", 0.5).alias("median"), quantile("effect", 0.05).alias("q05"), quantile("effect", 0.95).alias("q95"), F.avg((F.col("effect") > 0).cast("double")).alias("positive"), F.avg(outside).alias("supported")
    )


def qc_coverage(footprint: DataFrame, qc: DataFrame, flag: str) -> DataFrame:
    """Eligible and excluded pixels of a footprint; pixels without a flag are excluded."""
    j = footprint.join(qc.select("row", "col", flag), ["row", "col"], "left")
    good = F.coalesce(F.col(flag), F.lit(False)).cast("long")
    return j.agg(F.sum(good).alias("eligible"), (F.count("*") - F.sum(good)).alias("excluded"), (100 * F.sum(good) / F.count("*")).alias("percent"))


def status_counts(df: DataFrame, status: str, missing: str) -> DataFrame:
    """Rows per status, and per name in comma lists of missing values."""
    own = df.groupBy(F.lit("status").alias("kind"), F.col(status).alias("name")).agg(F.count("*").alias("n"))
    names = df.where(F.coalesce(F.col(missing), F.lit("")) != "").select(F.explode(F.split(missing, r",\s*")).alias("name"))
    return own.unionByName(names.groupBy(F.lit("missing").alias("kind"), "name").agg(F.count("*").alias("n")))


def _error_sums(observed: str, predicted: str) -> list[Column]:
    e = F.col(predicted) - F.col(observed)
    return [F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(e * e).alias("_mse"), F.var_pop(observed).alias("_var"), safe_corr(observed, predicted).alias("pearson")]


def holdout_metrics(df: DataFrame, models: list[str], observed: str = "observed") -> DataFrame:
    """mae, rmse, r2, bias and correlation of each model: over all rows, by year and by month, in one pass."""
    rows = stack(df, ["year", "month", observed], models, "model", "predicted").where(F.col(observed).isNotNull() & F.col("predicted").isNotNull())
    m, y, k = F.col("model"), F.col("year"), F.col("month")
    g = rows.groupingSets([[m], [m, y], [m, k]], m, y, k).agg(*_error_sums(observed, "predicted")).where("n >= 2")
    kind = F.when(y.isNotNull(), "year").when(k.isNotNull(), "month").otherwise("all")
    return g.select(kind.alias("grouping"), F.coalesce(y, k).alias("value"), "model", "n", "mae", "rmse", F.when(F.col("_var") > 1e-12, 1 - F.col("_mse") / F.col("_var")).alias("r2"), "bias", "pearson")


def holdout_pixel_metrics(df: DataFrame, models: list[str], observed: str = "observed") -> DataFrame:
    """The same per pixel, with its mean position."""
    rows = stack(df, ["row", "col", "x", "y", observed], models, "model", "predicted").where(F.col(observed).isNotNull() & F.col("predicted").isNotNull())
    g = rows.groupBy("row", "col", "model").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), *_error_sums(observed, "predicted")).where("n >= 2")
    return g.select("row", "col", "model", "x", "y", "n", "mae", "rmse", F.when(F.col("_var") > 1e-12, 1 - F.col("_mse") / F.col("_var")).alias("r2"), "bias", "pearson")


def holdout_skill(df: DataFrame, pairs: list[tuple[str, str]], observed: str = "observed") -> DataFrame:
    """1 - rmse(model) / rmse(baseline) over rows where both have a value."""
    made = F.inline(F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("comparison"), F.col(a).alias("_a"), F.col(b).alias("_b")) for a, b in pairs]))
    rows = df.select(F.col(observed).alias("_o"), made).where("_o is not null and _a is not null and _b is not null")
    sq = lambda c: (F.col(c) - F.col("_o")) * (F.col(c) - F.col("_o"))
    return rows.groupBy("comparison").agg(F.count("*").alias("n"), (1 - F.try_divide(F.sqrt(F.avg(sq("_a"))), F.sqrt(F.avg(sq("_b"))))).alias("skill"))


def acf_profile(panel: DataFrame, value: str, lags: int) -> DataFrame:
    """Autocorrelation of each pixel's series at calendar lags 1 … ``lags``, with the band 1.96/sqrt(n)."""
    at = F.col("year") * 12 + F.col("month") - 1
    now = panel.select("row", "col", at.alias("_t"), F.col(value).alias("_x"))
    past = panel.select("row", "col", at.alias("_p"), F.col(value).alias("_y")).withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("_t", F.col("_p") + F.col("lag"))
    sizes = panel.groupBy("row", "col").agg(F.count(value).alias("n"))
    acf = now.join(past, ["row", "col", "_t"]).groupBy("row", "col", "lag").agg(safe_corr("_x", "_y").alias("acf"))
    return acf.join(sizes, ["row", "col"]).select("row", "col", "lag", "acf", (1.96 / F.sqrt("n")).alias("band"))


def large_differences(df: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Rows whose absolute difference reaches its quantile, overall or within ``by``."""
    size = F.abs(F.col("predicted") - F.col("observed"))
    rows = df.withColumn("difference", F.col("predicted") - F.col("observed")).withColumn("_s", size).where("_s is not null")
    if by:
        return rows.join(rows.groupBy(*by).agg(quantile("_s", q).alias("_q")), by).where("_s >= _q").drop("_s", "_q")
    return rows.crossJoin(F.broadcast(rows.agg(quantile("_s", q).alias("_q")))).where("_s >= _q").drop("_s", "_q")


def symmetric_limit(df: DataFrame, value: str, q: float, keys: list[str]) -> DataFrame:
    """A colour limit: the quantile of the absolute values, else their maximum, else 1."""
    size = F.abs(F.col(value))
    return df.groupBy(*keys).agg(F.coalesce(F.nullif(quantile(size, q), F.lit(0.0)), F.nullif(F.max(size), F.lit(0.0)), F.lit(1.0)).alias("limit"), quantile(value, 0.02).alias("low"), quantile(value, 0.98).alias("high"))


def quantile_class(df: DataFrame, value: str, names: list[str]) -> DataFrame:
    """Classes between equal quantiles; equal edges count once, and the lowest edge belongs to the first class."""
    k = len(names)
    if k < 2:
        raise ValueError("two classes at least")
    edges = df.agg(F.array_distinct(F.percentile(value, [i / k for i in range(1, k)])).alias("_e"))
    below = F.size(F.filter("_e", lambda e: e < F.col(value)))
    return df.crossJoin(F.broadcast(edges)).withColumn("klass", F.when(F.col(value).isNotNull(), F.array(*map(F.lit, names))[below])).drop("_e")


def zscore_class(z: Column, threshold: float) -> Column:
    return F.when(z.isNull(), None).when(z <= -threshold, "negative").when(z >= threshold, "positive").otherwise("near normal")


def top_pairs(pairs: DataFrame, value: str, threshold: float, n: int) -> DataFrame:
    """The ``n`` strongest pairs of each pixel that reach the threshold; ties by name."""
    order = Window.partitionBy("row", "col").orderBy(F.desc(F.abs(value)), "a", "b")
    return pairs.where(F.abs(value) >= threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def similarity_rank(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Rank by a score (then by the keys), and the rank from 0 to 1."""
    from terracause.operators.ranks import ranked

    n = df.agg(F.count("*").alias("_n"))
    out = ranked(df, [F.asc(score), *[F.asc(k) for k in keys]], "rank").withColumn("rank", F.col("rank").cast("int"))
    return out.crossJoin(F.broadcast(n)).withColumn("scaled", F.when(F.col("_n") > 1, F.col("rank") / (F.col("_n") - 1)).otherwise(0.0)).drop("_n")


def edge_presence_bins(scores: DataFrame, edges: DataFrame, bins: int, top: int) -> DataFrame:
    """Share of graphs with each edge per equal-width score bin; the edges whose share varies most, by the bin of their peak."""
    ends = scores.agg(F.min("score").alias("_a"), F.max("score").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    binned = scores.crossJoin(F.broadcast(ends)).withColumn("bin", F.coalesce(F.least(F.floor(F.try_divide(F.col("score") - F.col("_a"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")).select("row", "col", "bin")
    sizes = binned.groupBy("bin").agg(F.count("*").alias("_n"))
    names = edges.select("parent", "child").distinct()
    have = edges.select("row", "col", "parent", "child").distinct().join(binned, ["row", "col"]).groupBy("bin", "parent", "child").agg(F.count("*").alias("_k"))
    # one row a bin, one a pair of variables
    share = F.broadcast(sizes).crossJoin(F.broadcast(names)).join(have, ["bin", "parent", "child"], "left").select("bin", "parent", "child", (F.coalesce("_k", F.lit(0)) / F.col("_n")).alias("share"))
    varied = share.groupBy("parent", "child").agg((F.max("share") - F.min("share")).alias("range"), F.max_by("bin", F.struct("share", -F.col("bin"))).alias("peak_bin"))
    kept = varied.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("range"), "parent", "child"))).where(F.col("_k") <= top).drop("_k")
    return share.join(kept, ["parent", "child"])


def candidate_pixels(panel: DataFrame, original: str, residual: str, least: int) -> DataFrame:
    """Complete rows and explained variance of each pixel with enough of them."""
    rows = panel.where(F.col(original).isNotNull() & F.col(residual).isNotNull()).groupBy("row", "col").agg(F.count("*").alias("n"), F.var_pop(residual).alias("_r"), F.var_pop(original).alias("_o"))
    return rows.where(F.col("n") >= least).select("row", "col", "n", (1 - F.try_divide("_r", F.when(F.col("_o") > 0, F.col("_o")))).alias("explained"))


def select_pixel(candidates: DataFrame, how: str, seed: int = 0) -> DataFrame:
    """One pixel: the best explained, the one closest to the median, or one by a hash of the seed."""
    from terracause.operators.sampling import draw

    if how == "highest":
        return candidates.orderBy(F.desc("explained"), "row", "col").limit(1)
    if how == "median":
        mid = candidates.agg(quantile("explained", 0.5).alias("_m"))
        return candidates.crossJoin(F.broadcast(mid)).orderBy(F.abs(F.col("explained") - F.col("_m")), "row", "col").limit(1).drop("_m")
    if how == "random":
        return candidates.orderBy(draw(F.lit(seed), "row", "col"), "row", "col").limit(1)
    raise ValueError(f"unknown choice: {how}")
