"""Queries over summaries, rankings, residuals, regressions and held-out skill, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracause.functions import columns as C
from terracause.operators import aggregates as A
from terracause.operators import holdout as H
from terracause.operators import panel as P
from terracause.operators import residual as R
from terracause.plans.fixtures import ARD, EDGES, GAPPY, LABELS, PREDICTIONS, ard, ard_gappy, edges, labels_px, predictions, q6, table, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df, *names):
    return df.select(*[C.r6(c).alias(c) if c in names else c for c in df.columns])


FX = (
    ARD
    + """, fx AS (SELECT row, col, v AS source, 'price' AS target, month AS horizon, e AS effect, e * 2 AS cumulative, e - 0.5 AS low, e + (month % 3) / 4.0::DOUBLE - 0.2 AS high, abs(e) / 3 AS sd,
  CASE WHEN (row + col + month) % 7 = 0 THEN 'failed' END AS error, (row * 3 + col + month) % 5 <> 0 AS stable
  FROM (SELECT row, col, month, v, CASE v WHEN 'qty' THEN qty - 25.5 WHEN 'disc' THEN (disc - 0.05) * 30 ELSE (tax - 0.04) * 30 END AS e FROM ard, (VALUES ('qty'), ('disc'), ('tax')) t(v) WHERE year = 2000))"""
)


def fx(s, d):
    a = ard(s, d).where("year = 2000")
    rows = a.select("row", "col", "month", F.inline(F.array(F.struct(F.lit("qty").alias("source"), (F.col("qty") - 25.5).alias("effect")), F.struct(F.lit("disc").alias("source"), ((F.col("disc") - 0.05) * 30).alias("effect")), F.struct(F.lit("tax").alias("source"), ((F.col("tax") - 0.04) * 30).alias("effect")))))
    e, k = F.col("effect"), F.col("row") + F.col("col") + F.col("month")
    return rows.select("row", "col", "source", F.lit("price").alias("target"), F.col("month").alias("horizon"), "effect", (e * 2).alias("cumulative"), (e - 0.5).alias("low"), (e + (F.col("month") % 3) / 4 - 0.2).alias("high"), (F.abs(e) / 3).alias("sd"), F.when(k % 7 == 0, "failed").alias("error"), ((F.col("row") * 3 + F.col("col") + F.col("month")) % 5 != 0).alias("stable"))


@query(
    with_sql(ARD)
    + f""", b AS (SELECT row, col, month, avg(qty) AS m, stddev_pop(qty) AS sd FROM ard WHERE year <> 2000 AND year >= 1996 GROUP BY ALL), n AS (SELECT row, col, month, avg(qty) AS q FROM ard WHERE year = 2000 GROUP BY ALL)
SELECT row, col, {q6('avg(q - m)')} AS anomaly, {q6('avg(CASE WHEN sd > 0 THEN (q - m) / sd END)')} AS zscore, count(q - m) AS n_months FROM n JOIN b USING (row, col, month) GROUP BY row, col"""
)
def climatology_anomaly(s, d):
    return rounded(A.climatology_anomaly(ard(s, d), "qty", 2000, first=1996), "anomaly", "zscore")


@query(
    with_sql(FX, LABELS)
    + f""", j AS (SELECT source, klass, effect, sd AS spread FROM fx JOIN labels_px USING (row, col)), l AS (UNPIVOT j ON effect, spread INTO NAME metric VALUE v)
SELECT source, klass, metric, count(*) AS n, {q6('avg(v)')} AS mean, {q6('median(v)')} AS median, {q6('stddev_samp(v)')} AS sd, {q6('quantile_cont(v, 0.25)')} AS q25, {q6('quantile_cont(v, 0.75)')} AS q75 FROM l GROUP BY ALL"""
)
def class_summary_effects(s, d):
    j = fx(s, d).join(labels_px(s, d), ["row", "col"]).withColumnRenamed("sd", "spread")
    return rounded(A.class_summary(j, ["source", "klass"], ["effect", "spread"]), "mean", "median", "sd", "q25", "q75")


@query(
    with_sql(FX, LABELS)
    + f""", j AS (SELECT source, klass, effect FROM fx JOIN labels_px USING (row, col)), k AS (SELECT DISTINCT source, klass AS c FROM j)
SELECT source, c AS klass, count(*) AS n, {q6("avg((klass = c)::INT)")} AS fraction, CASE WHEN count(*) >= 3 AND min((klass = c)::INT) < max((klass = c)::INT) THEN {q6("covar_pop(effect, (klass = c)::INT) / (stddev_pop(effect) * stddev_pop((klass = c)::INT))")} END AS corr,
  {q6("avg(effect) FILTER (klass = c)")} AS class_mean, {q6("avg(effect) FILTER (klass <> c)")} AS other_mean, {q6("avg(effect)")} AS overall_mean, {q6("avg(effect) FILTER (klass = c) - avg(effect) FILTER (klass <> c)")} AS difference
FROM j JOIN k USING (source) GROUP BY ALL"""
)
def class_indicator_corr(s, d):
    j = fx(s, d).join(labels_px(s, d), ["row", "col"])
    return rounded(A.class_indicator_corr(j, "klass", "effect", ["source"]), "fraction", "corr", "class_mean", "other_mean", "overall_mean", "difference")


@query(
    with_sql(FX, LABELS)
    + f""", m AS (SELECT source, klass, avg(effect) AS v FROM fx JOIN labels_px USING (row, col) GROUP BY ALL), t AS (SELECT source FROM m GROUP BY source ORDER BY max(abs(v)) DESC, source LIMIT 2)
SELECT source, {', '.join(f"{q6(f'max(v) FILTER (klass = {chr(39)}class{i}{chr(39)})')} AS class{i}" for i in range(1, 6))} FROM m JOIN t USING (source) GROUP BY source"""
)
def class_heatmap(s, d):
    names = [f"class{i}" for i in range(1, 6)]
    m = fx(s, d).join(labels_px(s, d), ["row", "col"]).groupBy("source", "klass").agg(F.avg("effect").alias("v"))
    return rounded(A.class_heatmap(m, "source", "klass", "v", names, 2), *names)


@query(with_sql(ARD, LABELS) + f"SELECT klass, count(*) AS n, {q6('avg(purity)')} AS purity, {q6('avg(valid_fraction)')} AS valid_fraction, sum(code)::BIGINT AS codes, count(DISTINCT row) AS n_blocks FROM labels_px GROUP BY klass")
def label_summary(s, d):
    g = labels_px(s, d).groupBy("klass").agg(F.count("*").alias("n"), F.avg("purity").alias("purity"), F.avg("valid_fraction").alias("valid_fraction"), F.sum("code").alias("codes"), F.countDistinct("row").alias("n_blocks"))
    return rounded(g, "purity", "valid_fraction")


STAGES = [("labelled", "code IS NOT NULL"), ("pure", "purity >= 0.2"), ("valid", "valid_fraction >= 0.4"), ("inner", "row BETWEEN 1 AND 3")]


@query(with_sql(ARD, LABELS) + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS stage, '{n}' AS filter, count(*) AS n_samples, count(DISTINCT klass) AS n_classes FROM labels_px WHERE {' AND '.join(c for _, c in STAGES[: i + 1])}" for i, (n, _) in enumerate(STAGES)))
def filter_funnel(s, d):
    return A.filter_funnel(labels_px(s, d), [(n, F.expr(c)) for n, c in STAGES], "klass")


@query(with_sql(ARD, LABELS) + "SELECT row, col, klass FROM labels_px WHERE klass IN (SELECT klass FROM labels_px GROUP BY klass HAVING count(*) >= 4)")
def class_retain(s, d):
    return A.class_retain(labels_px(s, d), "klass", 4).select("row", "col", "klass")


@query(
    with_sql(ARD)
    + f""", g AS (SELECT qty, CASE WHEN nl % 3 <> 0 THEN price END AS price, tax FROM ard), l AS (SELECT 'qty' AS metric, qty AS v FROM g UNION ALL SELECT 'price', price FROM g UNION ALL SELECT 'tax', tax FROM g)
SELECT metric, count(v) AS n, {q6('1 - count(v) / count(*)')} AS missing, {q6('avg(v)')} AS mean, {q6('stddev_pop(v)')} AS sd, min(v) AS least, {q6('quantile_cont(v, 0.05)')} AS q05, {q6('median(v)')} AS median, {q6('quantile_cont(v, 0.95)')} AS q95, max(v) AS most FROM l GROUP BY metric"""
)
def diag_metric_summary(s, d):
    g = ard(s, d).select("qty", F.when(F.col("nl") % 3 == 0, float("nan")).otherwise(F.col("price")).alias("price"), "tax")
    return rounded(A.metric_summary(g, ["qty", "price", "tax"]), "missing", "mean", "sd", "q05", "median", "q95")


def _json_cells(s, d):
    """Diagnostics cells: one JSON list of pair records a pixel."""
    a = ard(s, d).where("year = 2000")
    record = F.struct(F.concat(F.lit("v"), (F.col("month") % 4).cast("string")).alias("a"), F.concat(F.lit("v"), (F.col("month") % 3).cast("string")).alias("b"), (F.col("month") % 5).alias("lag"), (F.col("qty") - 25.5).alias("value"), (F.col("nl") / 100).alias("p"))
    return a.groupBy("row", "col").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("cell"))


RECORDS = ARD + ", rec AS (SELECT row, col, 'v' || (month % 4) AS a, 'v' || (month % 3) AS b, month % 5 AS lag, qty - 25.5 AS value, nl / 100 AS p FROM ard WHERE year = 2000)"


def records(s, d):
    return A.json_records(_json_cells(s, d), "cell", "a string, b string, lag int, value double, p double", ["row", "col"])


@query(with_sql(RECORDS) + f"SELECT a, b, count(*) AS n, {q6('median(abs(value))')} AS median, {q6('avg(abs(value))')} AS mean, {q6('max(abs(value))')} AS most FROM rec GROUP BY a, b")
def agg_residual_pairs(s, d):
    v = F.abs("value")
    return rounded(records(s, d).groupBy("a", "b").agg(F.count("*").alias("n"), A.quantile(v, 0.5).alias("median"), F.avg(v).alias("mean"), F.max(v).alias("most")), "median", "mean", "most")


@query(with_sql(RECORDS) + f"SELECT a, b, CAST(lag AS INTEGER) AS lag, count(*) AS n, {q6('median(abs(value))')} AS median, {q6('max(abs(value))')} AS most FROM rec GROUP BY a, b, lag")
def agg_crosslag_pairs(s, d):
    v = F.abs("value")
    return rounded(records(s, d).groupBy("a", "b", "lag").agg(F.count("*").alias("n"), A.quantile(v, 0.5).alias("median"), F.max(v).alias("most")), "median", "most")


@query(with_sql(RECORDS) + f", w AS (SELECT lag, avg(p) AS whiteness FROM rec WHERE lag <> 2 GROUP BY lag) SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, {q6('median(abs(value)) FILTER (a = b)')} AS auto_median, {q6('quantile_cont(abs(value), 0.95) FILTER (a <> b)')} AS cross_q95, {q6('max(whiteness)')} AS whiteness FROM rec LEFT JOIN w USING (lag) GROUP BY lag")
def agg_lag_profile(s, d):
    r = records(s, d)
    v = F.abs("value")
    own = r.groupBy("lag").agg(F.count("*").alias("n"), A.quantile(F.when(F.col("a") == F.col("b"), v), 0.5).alias("auto_median"), A.quantile(F.when(F.col("a") != F.col("b"), v), 0.95).alias("cross_q95"))
    white = r.where("lag <> 2").groupBy("lag").agg(F.avg("p").alias("whiteness"))
    return rounded(own.join(white, "lag", "left"), "auto_median", "cross_q95", "whiteness")


@query(with_sql(RECORDS) + f"SELECT a AS parent, b AS child, count(*) AS n, count(*) FILTER (p >= 0.25 AND abs(value) >= 0.1) AS n_consensus, {q6('median(p)')} AS median_p, {q6('avg(p)')} AS mean_p, {q6('median(abs(value))')} AS median_weight FROM rec GROUP BY a, b")
def agg_edges(s, d):
    r = records(s, d)
    g = r.groupBy(F.col("a").alias("parent"), F.col("b").alias("child")).agg(F.count("*").alias("n"), F.count(F.when((F.col("p") >= 0.25) & (F.abs("value") >= 0.1), 1)).alias("n_consensus"), A.quantile("p", 0.5).alias("median_p"), F.avg("p").alias("mean_p"), A.quantile(F.abs("value"), 0.5).alias("median_weight"))
    return rounded(g, "median_p", "mean_p", "median_weight")


@query(with_sql(RECORDS) + f", e AS (SELECT row, col, a, b, max(p) AS p FROM rec WHERE a <> b GROUP BY ALL) SELECT x.a, x.b, count(*) AS n, {q6('median(least(x.p, y.p))')} AS median, {q6('max(least(x.p, y.p))')} AS most FROM e x JOIN e y ON x.row = y.row AND x.col = y.col AND x.a = y.b AND x.b = y.a AND x.a < x.b GROUP BY x.a, x.b")
def agg_bidirectional(s, d):
    e = records(s, d).where("a <> b").groupBy("row", "col", "a", "b").agg(F.max("p").alias("p"))
    back = e.select("row", "col", F.col("a").alias("b"), F.col("b").alias("a"), F.col("p").alias("q"))
    both = e.join(back, ["row", "col", "a", "b"]).where("a < b").withColumn("v", F.least("p", "q"))
    return rounded(both.groupBy("a", "b").agg(F.count("*").alias("n"), A.quantile("v", 0.5).alias("median"), F.max("v").alias("most")), "median", "most")


LAG1 = """lagged AS (SELECT row, col, qty, price, lag(qty) OVER w AS lq, lag(price) OVER w AS lp FROM ard WINDOW w AS (PARTITION BY row, col ORDER BY year, month)),
lag1 AS (SELECT row, col, 'qty' AS variable, corr(qty, lq) AS r FROM lagged GROUP BY row, col UNION ALL SELECT row, col, 'price', corr(price, lp) FROM lagged GROUP BY row, col)"""


@query(with_sql(ARD, LAG1) + f"SELECT variable, count(r) AS n, {q6('median(r)')} AS median, {q6('max(r)')} AS most FROM lag1 GROUP BY variable")
def agg_lag1(s, d):
    from terracause.operators.diagnostics import lag1_autocorr

    r = lag1_autocorr(ard(s, d), ["qty", "price"])
    return rounded(r.groupBy("variable").agg(F.count("lag1").alias("n"), A.quantile("lag1", 0.5).alias("median"), F.max("lag1").alias("most")), "median", "most")


@query(with_sql(RECORDS) + f"SELECT a AS variable, count(*) AS n, {q6('avg((p < 0.25)::INT)')} AS non_gaussian, {q6('median(abs(value))')} AS skew, {q6('median(abs(value * 2))')} AS kurtosis, {q6('median(p)')} AS p FROM rec GROUP BY a")
def agg_moments(s, d):
    g = records(s, d).groupBy(F.col("a").alias("variable")).agg(F.count("*").alias("n"), F.avg((F.col("p") < 0.25).cast("int")).alias("non_gaussian"), A.quantile(F.abs("value"), 0.5).alias("skew"), A.quantile(F.abs(F.col("value") * 2), 0.5).alias("kurtosis"), A.quantile("p", 0.5).alias("p"))
    return rounded(g, "non_gaussian", "skew", "kurtosis", "p")


def _effect_sql(keys: str) -> str:
    return f"SELECT {keys}, count(effect) AS n, {q6('avg(effect)')} AS mean, {q6('median(effect)')} AS median, {q6('quantile_cont(effect, 0.05)')} AS q05, {q6('quantile_cont(effect, 0.95)')} AS q95, {q6('avg((effect > 0)::INT)')} AS positive, {q6('median(cumulative)')} AS cumulative_median, {q6('avg((low > 0 OR high < 0)::INT)')} AS excludes_zero, {q6('median(sd)')} AS median_sd FROM fx WHERE error IS NULL AND stable GROUP BY {keys}"


EFFECT_COLUMNS = ["mean", "median", "q05", "q95", "positive", "cumulative_median", "excludes_zero", "median_sd"]


@query(with_sql(FX) + _effect_sql("source, target, horizon"))
def agg_var_effects(s, d):
    return rounded(A.effect_summary(fx(s, d), ["source", "target", "horizon"]), *EFFECT_COLUMNS)


@query(with_sql(FX.replace("v AS source", "v AS scenario")) + _effect_sql("scenario, target, horizon"))
def agg_interventions(s, d):
    return rounded(A.effect_summary(fx(s, d).withColumnRenamed("source", "scenario"), ["scenario", "target", "horizon"]), *EFFECT_COLUMNS)


@query(with_sql(FX) + f"SELECT source, count(*) AS n, {q6('median(effect)')} AS median, {q6('quantile_cont(effect, 0.05)')} AS q05, {q6('quantile_cont(effect, 0.95)')} AS q95, {q6('avg((effect > 0)::INT)')} AS positive, {q6('avg((low > 0 OR high < 0)::INT)')} AS supported FROM fx WHERE horizon = 3 GROUP BY source")
def map_summary(s, d):
    return rounded(A.map_summary(fx(s, d), 3), "median", "q05", "q95", "positive", "supported")


@query(with_sql(ARD, LABELS) + f"SELECT count(*) FILTER (purity >= 0.205) AS eligible, count(*) FILTER (NOT purity >= 0.205) AS excluded, {q6('100 * count(*) FILTER (purity >= 0.205) / count(*)')} AS percent FROM labels_px")
def qc_coverage(s, d):
    px = labels_px(s, d)
    return rounded(A.qc_coverage(px.select("row", "col"), px.select("row", "col", (F.col("purity") >= 0.205).alias("ok")), "ok"), "percent")


@query("WITH e AS (SELECT event_type, CASE event_id % 3 WHEN 0 THEN 'qty, tax' WHEN 1 THEN 'qty' ELSE '' END AS m FROM events) SELECT 'status' AS kind, event_type AS name, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'missing', name, count(*) FROM (SELECT unnest(string_split(m, ', ')) AS name FROM e WHERE m <> '') GROUP BY ALL")
def status_counts(s, d):
    k = F.col("event_id") % 3
    return A.status_counts(table(s, d, "events").select("event_type", F.when(k == 0, "qty, tax").when(k == 1, "qty").otherwise("").alias("m")), "event_type", "m")


MODELS = ["predicted", "climatology", "persistence"]
STACKED = PREDICTIONS + ", st AS (SELECT row, col, year, month, x, y, observed, m AS model, CASE m WHEN 'predicted' THEN predicted WHEN 'climatology' THEN climatology ELSE persistence END AS p FROM predictions, (VALUES ('predicted'), ('climatology'), ('persistence')) t(m))"
METRICS = f"""count(*) AS n, {q6('avg(abs(p - observed))')} AS mae, {q6('sqrt(avg((p - observed) * (p - observed)))')} AS rmse, CASE WHEN var_pop(observed) > 1e-12 THEN {q6('1 - avg((p - observed) * (p - observed)) / var_pop(observed)')} END AS r2,
  {q6('avg(p - observed)')} AS bias, CASE WHEN stddev_pop(observed) * stddev_pop(p) > 1e-12 THEN {q6('covar_pop(observed, p) / (stddev_pop(observed) * stddev_pop(p))')} END AS pearson"""
SCORES = ["mae", "rmse", "r2", "bias", "pearson"]


@query(with_sql(ARD, STACKED) + f"SELECT CASE WHEN year IS NOT NULL THEN 'year' WHEN month IS NOT NULL THEN 'month' ELSE 'all' END AS grouping, coalesce(year, month) AS value, model, {METRICS} FROM st WHERE observed IS NOT NULL AND p IS NOT NULL GROUP BY GROUPING SETS ((model), (model, year), (model, month)) HAVING count(*) >= 2")
def holdout_metrics(s, d):
    return rounded(A.holdout_metrics(predictions(s, d), MODELS), *SCORES)


@query(with_sql(ARD, STACKED) + f"SELECT row, col, model, avg(x) AS x, avg(y) AS y, {METRICS} FROM st WHERE observed IS NOT NULL AND p IS NOT NULL GROUP BY row, col, model HAVING count(*) >= 2")
def holdout_pixel_metrics(s, d):
    return rounded(A.holdout_pixel_metrics(predictions(s, d), MODELS), *SCORES)


def _skill(a: str, b: str) -> str:
    return f"SELECT '{a} vs {b}' AS comparison, count(*) AS n, {q6(f'1 - sqrt(avg(({a} - observed) * ({a} - observed))) / sqrt(avg(({b} - observed) * ({b} - observed)))')} AS skill FROM predictions WHERE observed IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL"


PAIRS = [("predicted", "climatology"), ("predicted", "persistence"), ("climatology", "persistence")]


@query(with_sql(ARD, PREDICTIONS) + " UNION ALL ".join(_skill(*p) for p in PAIRS))
def holdout_skill(s, d):
    return rounded(A.holdout_skill(predictions(s, d), PAIRS), "skill")


@query(with_sql(RECORDS) + f"SELECT count(*) AS n, {q6('avg((p < 0.25)::INT)')} AS rejected, {q6('median(p)')} AS median_p, {q6('avg((abs(value) > 1)::INT)')} AS analytic_rejected FROM rec WHERE lag = 1")
def whiteness_pilot_summary(s, d):
    g = records(s, d).where("lag = 1").agg(F.count("*").alias("n"), F.avg((F.col("p") < 0.25).cast("int")).alias("rejected"), A.quantile("p", 0.5).alias("median_p"), F.avg((F.abs("value") > 1).cast("int")).alias("analytic_rejected"))
    return rounded(g, "rejected", "median_p", "analytic_rejected")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


# --- windows, ranking, sets


@query(with_sql(GAPPY) + "SELECT row, col, count(*) AS n_rows, count(*) = count(DISTINCT year * 12 + month) AND count(*) = max(year * 12 + month) - min(year * 12 + month) + 1 AS consecutive FROM ard_gappy GROUP BY row, col")
def consecutive_months(s, d):
    return P.consecutive_months(ard_gappy(s, d), ["qty", "price"])


@query(with_sql(GAPPY) + "SELECT row, col, year, month, year * 12 + month - 1 - (SELECT min(year * 12 + month - 1) FROM ard_gappy) AS time_index FROM ard_gappy")
def time_index(s, d):
    return P.time_index(ard_gappy(s, d).select("row", "col", "year", "month"))


@query(with_sql(FX) + f"SELECT row, col, source, horizon, {q6('sum(effect) OVER (PARTITION BY row, col, source ORDER BY horizon)')} AS cumulative FROM fx")
def cumulative_effect(s, d):
    from terracause.operators.effects import cumulative_effect

    return rounded(cumulative_effect(fx(s, d), ["row", "col", "source"], "effect").select("row", "col", "source", "horizon", "cumulative"), "cumulative")


@query(with_sql(RECORDS) + ", t AS (SELECT row, col, a, b, value, CAST(row_number() OVER (PARTITION BY row, col ORDER BY abs(value) DESC, a, b) AS INTEGER) AS rank FROM rec WHERE a <> b AND abs(value) >= 0.1) SELECT row, col, a, b, value, rank FROM t WHERE rank <= 3")
def top_pairs(s, d):
    return A.top_pairs(records(s, d).where("a <> b"), "value", 0.1, 3).select("row", "col", "a", "b", "value", "rank")


@query(with_sql(ARD) + f", g AS (SELECT row, col, max(qty) AS score FROM ard GROUP BY row, col) SELECT row, col, CAST(row_number() OVER (ORDER BY score, row, col) - 1 AS INTEGER) AS rank, {q6('(row_number() OVER (ORDER BY score, row, col) - 1) / (count(*) OVER () - 1)')} AS scaled FROM g")
def similarity_rank(s, d):
    g = ard(s, d).groupBy("row", "col").agg(F.max("qty").alias("score"))
    return rounded(A.similarity_rank(g, "score", ["row", "col"]).select("row", "col", "rank", "scaled"), "scaled")


@query(
    with_sql(EDGES)
    + f""", sc AS (SELECT row, col, max(nl) AS score FROM ard GROUP BY row, col), e AS (SELECT DISTINCT row, col, parent, child FROM edges WHERE abs(weight) > 0.02 AND replicate = 0),
b AS (SELECT row, col, CAST(coalesce(least(floor((score - a) / nullif((b - a) / 3, 0)), 2), 0) AS INTEGER) AS bin FROM sc, (SELECT min(score) AS a, max(score) AS b FROM sc)),
s AS (SELECT n.bin, p.parent, p.child, coalesce(k, 0) / n AS share FROM (SELECT bin, count(*) AS n FROM b GROUP BY bin) n CROSS JOIN (SELECT DISTINCT parent, child FROM e) p LEFT JOIN (SELECT bin, parent, child, count(*) AS k FROM e JOIN b USING (row, col) GROUP BY ALL) h ON h.bin = n.bin AND h.parent = p.parent AND h.child = p.child),
v AS (SELECT parent, child, max(share) - min(share) AS range FROM s GROUP BY ALL ORDER BY range DESC, parent, child LIMIT 2),
q AS (SELECT parent, child, bin AS peak_bin FROM (SELECT *, row_number() OVER (PARTITION BY parent, child ORDER BY share DESC, bin) AS k FROM s) WHERE k = 1)
SELECT s.bin, s.parent, s.child, {q6('s.share')} AS share, {q6('v.range')} AS range, q.peak_bin FROM s JOIN v USING (parent, child) JOIN q USING (parent, child)"""
)
def edge_presence_bins(s, d):
    score = ard(s, d).groupBy("row", "col").agg(F.max("nl").alias("score"))
    e = edges(s, d).where("abs(weight) > 0.02 and replicate = 0")
    return rounded(A.edge_presence_bins(score, e, 3, 2).select("bin", "parent", "child", "share", "range", "peak_bin"), "share", "range")


@query(
    with_sql(GAPPY)
    + f""", t AS (SELECT row, col, year * 12 + month AS t, qty FROM ard_gappy), n AS (SELECT row, col, count(qty) AS n FROM t GROUP BY ALL)
SELECT a.row, a.col, CAST(l AS INTEGER) AS lag, {q6('corr(a.qty, b.qty)')} AS acf, {q6('1.96 / sqrt(max(n))')} AS band FROM t a JOIN generate_series(1, 12) g(l) ON true JOIN t b ON a.row = b.row AND a.col = b.col AND b.t = a.t - l JOIN n ON n.row = a.row AND n.col = a.col GROUP BY a.row, a.col, l"""
)
def acf_profile(s, d):
    return rounded(A.acf_profile(ard_gappy(s, d), "qty", 12), "acf", "band")


@query(with_sql(ARD, PREDICTIONS) + f", e AS (SELECT *, abs(predicted - observed) AS s FROM predictions WHERE predicted IS NOT NULL) SELECT row, col, month, {q6('predicted - observed')} AS difference FROM e JOIN (SELECT month, quantile_cont(s, 0.9) AS q FROM e GROUP BY month) USING (month) WHERE s >= q")
def large_differences(s, d):
    return rounded(A.large_differences(predictions(s, d), 0.9, ["month"]).select("row", "col", "month", "difference"), "difference")


@query(with_sql(FX) + f"SELECT source, {q6('coalesce(nullif(quantile_cont(abs(effect), 0.98), 0), nullif(max(abs(effect)), 0), 1)')} AS limit, {q6('quantile_cont(effect, 0.02)')} AS low, {q6('quantile_cont(effect, 0.98)')} AS high FROM fx GROUP BY source".replace(" AS limit", ' AS "limit"'))
def symmetric_limit(s, d):
    return rounded(A.symmetric_limit(fx(s, d), "effect", 0.98, ["source"]), "limit", "low", "high")


@query(with_sql(ARD) + ", a AS (SELECT row, col, avg(qty) AS v FROM ard WHERE year = 2000 GROUP BY ALL), e AS (SELECT quantile_cont(v, 1 / 3::DOUBLE) AS e1, quantile_cont(v, 2 / 3::DOUBLE) AS e2 FROM a) SELECT row, col, CASE WHEN v <= e1 THEN 'low' WHEN v <= e2 THEN 'middle' ELSE 'high' END AS klass FROM a, e")
def quantile_class(s, d):
    v = ard(s, d).where("year = 2000").groupBy("row", "col").agg(F.avg("qty").alias("v"))
    return A.quantile_class(v, "v", ["low", "middle", "high"]).select("row", "col", "klass")


@query(with_sql(ARD) + ", z AS (SELECT row, col, month, (qty - avg(qty) OVER w) / nullif(stddev_pop(qty) OVER w, 0) AS z FROM ard WHERE year = 2000 WINDOW w AS (PARTITION BY row, col)) SELECT row, col, month, CASE WHEN z IS NULL THEN NULL WHEN z <= -1 THEN 'negative' WHEN z >= 1 THEN 'positive' ELSE 'near normal' END AS klass FROM z")
def zscore_class(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("row", "col")
    sd = F.stddev_pop("qty").over(w)
    z = ard(s, d).where("year = 2000").withColumn("z", (F.col("qty") - F.avg("qty").over(w)) / F.when(sd > 0, sd))
    return z.select("row", "col", "month", A.zscore_class(F.col("z"), 1.0).alias("klass"))


CANDIDATES = ARD + ", r AS (SELECT row, col, qty, qty - avg(qty) OVER (PARTITION BY row, col, month) AS e FROM ard), c AS (SELECT row, col, count(*) AS n, 1 - var_pop(e) / var_pop(qty) AS explained FROM r GROUP BY row, col HAVING count(*) >= 40)"


def _candidates(s, d):
    from pyspark.sql import Window

    r = ard(s, d).withColumn("e", F.col("qty") - F.avg("qty").over(Window.partitionBy("row", "col", "month")))
    return A.candidate_pixels(r, "qty", "e", 40)


@query(with_sql(CANDIDATES) + f"SELECT row, col, n, {q6('explained')} AS explained FROM c")
def candidate_pixels(s, d):
    return rounded(_candidates(s, d), "explained")


@query(with_sql(CANDIDATES) + f"(SELECT 'highest' AS how, row, col, {q6('explained')} AS explained FROM c ORDER BY c.explained DESC, row, col LIMIT 1) UNION ALL (SELECT 'median', row, col, {q6('explained')} FROM c ORDER BY abs(c.explained - (SELECT median(explained) FROM c)), row, col LIMIT 1) UNION ALL (SELECT 'random', row, col, {q6('explained')} FROM c ORDER BY ('0x' || substr(md5(concat_ws('|', 7, row, col)), 1, 8))::BIGINT, row, col LIMIT 1)")
def select_pixel(s, d):
    c = _candidates(s, d)
    out = None
    for how in ("highest", "median", "random"):
        one = A.select_pixel(c, how, 7).select(F.lit(how).alias("how"), "row", "col", "explained")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "explained")


@query(with_sql(GAPPY) + "SELECT CAST(r AS INTEGER) AS row, " + ", ".join(f"max(qty) FILTER (col = {c}) AS c{c}" for c in range(6)) + " FROM generate_series(0, 5) g(r) LEFT JOIN (SELECT * FROM ard_gappy WHERE year = 1998 AND month = 5) a ON a.row = r GROUP BY r")
def grid_matrix(s, d):
    return P.grid_matrix(ard_gappy(s, d).where("year = 1998 and month = 5"), "qty", 6, 6)


@query(with_sql(EDGES) + f", p AS (SELECT row, col, avg((abs(weight) > 0.02)::INT) AS p FROM edges WHERE replicate > 0 AND parent = 'nl' AND child = 'qty' GROUP BY row, col) SELECT CAST(r AS INTEGER) AS row, " + ", ".join(f"{q6(f'max(p) FILTER (col = {c})')} AS c{c}" for c in range(5)) + " FROM generate_series(0, 4) g(r) LEFT JOIN p ON p.row = r GROUP BY r")
def arrow_probability_grid(s, d):
    from terracause.operators.graphs import edge_probability

    p = edge_probability(edges(s, d), 0.02).where("parent = 'nl' and child = 'qty'")
    return rounded(P.grid_matrix(p, "probability", 5, 5), *[f"c{c}" for c in range(5)])


@query(with_sql(ARD) + "SELECT row, col, year, month, qty AS value, 'early' AS part FROM ard WHERE year < 1998 UNION ALL SELECT row, col, year, month, price, 'late' FROM ard WHERE year >= 1998")
def panel_concat(s, d):
    a = ard(s, d)
    return a.where("year < 1998").select(*P.KEYS, *P.TIME, F.col("qty").alias("value"), F.lit("early").alias("part")).unionByName(a.where("year >= 1998").select(*P.KEYS, *P.TIME, F.col("price").alias("value"), F.lit("late").alias("part")))


@query("SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM generate_series(1994, 2003) a(y), generate_series(1, 12) b(m) EXCEPT SELECT CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER) FROM orders")
def month_set_difference(s, d):
    from terracause.sources.catalog import missing_months

    need = s.range(1994, 2004).select(F.col("id").cast("int").alias("year")).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return missing_months(need, table(s, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")))


# --- residuals and regressions

RESID = """fit AS (SELECT row, col, month, avg(v) AS ym, avg(t) AS tm, count(*) AS nm FROM (SELECT row, col, month, qty AS v, CAST(year * 12 + month - 1 AS DOUBLE) AS t FROM ard_gappy WHERE year <= 2000) GROUP BY ALL),
slope AS (SELECT row, col, sum((t - tm) * (v - ym)) / sum((t - tm) * (t - tm)) AS b, count(*) AS n, min(nm) AS few, count(DISTINCT month) AS months, sum((t - tm) * (t - tm)) AS sxx FROM (SELECT row, col, month, qty AS v, CAST(year * 12 + month - 1 AS DOUBLE) AS t FROM ard_gappy WHERE year <= 2000) JOIN fit USING (row, col, month) GROUP BY row, col),
resid AS (SELECT a.row, a.col, a.year, a.month, a.qty, CASE WHEN n < 24 THEN 'too_few_fit_samples' WHEN few < 2 OR months < 12 THEN 'too_few_samples_in_calendar_month' ELSE 'fit' END AS qty_status,
  CASE WHEN n >= 24 AND few >= 2 AND months = 12 THEN ym + b * (a.year * 12 + a.month - 1 - tm) END AS qty_expected FROM ard_gappy a LEFT JOIN fit USING (row, col, month) LEFT JOIN slope USING (row, col))"""


@query(with_sql(GAPPY, RESID) + f"SELECT row, col, year, month, qty_status, {q6('qty_expected')} AS qty_expected, {q6('qty - qty_expected')} AS qty_resid FROM resid")
def residualize_monthly(s, d):
    r = R.residualize_monthly(ard_gappy(s, d), ["qty"], 2000)
    return rounded(r.select("row", "col", "year", "month", "qty_status", "qty_expected", "qty_resid"), "qty_expected", "qty_resid")


@query(
    with_sql(ARD)
    + f""", r AS (SELECT *, sin(2 * pi() * month / 12) AS sn, cos(2 * pi() * month / 12) AS cs FROM ard), c AS (SELECT row, col, avg(qty) AS my, avg(sn) AS ms, avg(cs) AS mc, var_pop(sn) AS ss, var_pop(cs) AS cc, covar_pop(sn, cs) AS sc, covar_pop(qty, sn) AS ys, covar_pop(qty, cs) AS yc FROM r WHERE year <= 2000 GROUP BY row, col)
SELECT row, col, year, month, {q6('my + (ys * cc - yc * sc) / (ss * cc - sc * sc) * (sn - ms) + (yc * ss - ys * sc) / (ss * cc - sc * sc) * (cs - mc)')} AS qty_expected FROM r JOIN c USING (row, col)"""
)
def residualize_harmonic(s, d):
    return rounded(R.residualize_harmonic(ard(s, d), "qty", 2000, trend=False).select("row", "col", "year", "month", "qty_expected"), "qty_expected")


@query(with_sql(GAPPY, RESID) + f", m AS (SELECT row, col, count(*) AS n_month_effects, min(nm) AS min_month_count FROM fit GROUP BY row, col), f AS (SELECT row, col, count(*) AS n_samples, {q6('1 - sum((qty - qty_expected) * (qty - qty_expected)) / (var_pop(qty) * count(*))')} AS r2, {q6('stddev_pop(qty - qty_expected)')} AS residual_sd FROM resid WHERE year <= 2000 GROUP BY row, col) SELECT row, col, n_samples, {q6('b')} AS trend, r2, residual_sd, n_month_effects + 1 AS n_parameters, min_month_count FROM f JOIN m USING (row, col) JOIN slope USING (row, col)")
def residual_models(s, d):
    return rounded(R.residual_models(ard_gappy(s, d), "qty", 2000).select("row", "col", "n_samples", "trend", "r2", "residual_sd", "n_parameters", "min_month_count"), "trend", "r2", "residual_sd")


@query(
    with_sql(ARD)
    + f""", r AS (SELECT row, col, year, month, qty, avg(qty) OVER (PARTITION BY row, col, month) AS e FROM ard), z AS (SELECT *, qty - e AS u, lag(qty) OVER w AS lq, lag(qty - e) OVER w AS lu FROM r WINDOW w AS (PARTITION BY row, col ORDER BY year, month)),
m AS (SELECT row, col, month, avg(qty) AS a FROM z GROUP BY ALL) SELECT row, col, {q6('avg(qty)')} AS mean_before, {q6('stddev_pop(qty)')} AS sd_before, {q6('stddev_pop(u)')} AS sd_after, {q6('1 - var_pop(u) / var_pop(qty)')} AS explained, {q6('corr(qty, lq)')} AS lag1_before, {q6('corr(u, lu)')} AS lag1_after, {q6('max(rb)')} AS range_before
FROM z JOIN (SELECT row, col, max(a) - min(a) AS rb FROM m GROUP BY ALL) USING (row, col) GROUP BY row, col"""
)
def residual_report(s, d):
    from pyspark.sql import Window

    r = ard(s, d).withColumn("e", F.avg("qty").over(Window.partitionBy("row", "col", "month"))).withColumn("u", F.col("qty") - F.col("e"))
    names = ["mean_before", "sd_before", "sd_after", "explained", "lag1_before", "lag1_after", "range_before"]
    return rounded(R.residual_report(r, "qty", "u", "e").select("row", "col", *names), *names)


@query(with_sql(ARD) + f", z AS (SELECT row, col, month, (qty - avg(qty) OVER w) / stddev_pop(qty) OVER w AS z FROM ard WINDOW w AS (PARTITION BY row, col)) SELECT row, col, month, count(z) AS n, {q6('avg(z)')} AS mean, {q6('stddev_pop(z)')} AS sd, {q6('stddev_pop(z) / sqrt(count(z))')} AS sem FROM z GROUP BY ALL")
def standard_climatology(s, d):
    return rounded(R.standard_climatology(ard(s, d), "qty"), "mean", "sd", "sem")


def _two(alpha: str) -> str:
    return f"""c AS (SELECT row, col, count(*) AS n, avg(price) AS my, avg(qty) AS m1, avg(disc) AS m2, var_pop(qty) * count(*) + {alpha} AS a11, var_pop(disc) * count(*) + {alpha} AS a22, covar_pop(qty, disc) * count(*) AS a12, covar_pop(price, qty) * count(*) AS c1, covar_pop(price, disc) * count(*) AS c2 FROM ard GROUP BY row, col),
b AS (SELECT *, (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) AS b1, (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) AS b2 FROM c) SELECT row, col, n, {q6('my - b1 * m1 - b2 * m2')} AS intercept, {q6('b1')} AS b_qty, {q6('b2')} AS b_disc FROM b"""


@query(with_sql(ARD, _two("0")))
def grouped_ols(s, d):
    return rounded(R.grouped_ols(ard(s, d), ["row", "col"], "price", ["qty", "disc"]), "intercept", "b_qty", "b_disc")


@query(with_sql(ARD, _two("0.5")))
def grouped_ridge(s, d):
    return rounded(R.grouped_ols(ard(s, d), ["row", "col"], "price", ["qty", "disc"], alpha=0.5), "intercept", "b_qty", "b_disc")


# --- held-out prediction

POINT = EDGES + ", par AS (SELECT row, col, parent, weight FROM edges WHERE replicate = 0 AND child = 'qty')"


def _parents(s, d, panel):
    return edges(s, d, panel, replicates=0).where("child = 'qty'").select("row", "col", "parent", "weight")


@query(with_sql(POINT) + f", m AS (SELECT row, col, avg(qty) AS my, avg(nl) AS mn FROM ard WHERE year <= 2000 GROUP BY ALL) SELECT row, col, year, month, qty AS observed, {q6('my + coalesce(weight, 0) * (nl - mn)')} AS predicted FROM ard JOIN m USING (row, col) JOIN par USING (row, col) WHERE year > 2000")
def predict_level(s, d):
    a = ard(s, d)
    return rounded(H.predict_level(a, _parents(s, d, a), "qty", 2000), "predicted")


@query(with_sql(POINT) + f", m AS (SELECT row, col, month, count(qty) AS n, avg(qty) AS my, avg(nl) AS mn, covar_pop(qty, nl) * count(*) AS sxy, var_pop(nl) * count(*) AS sxx FROM ard WHERE year <= 2000 GROUP BY ALL) SELECT a.row, a.col, a.year, a.month, {q6('a.qty - my')} AS observed, {q6('coalesce(weight, 0) * (a.nl - mn)')} AS predicted, {q6('CASE WHEN weight <> 0 THEN sxy / (sxx + 1) ELSE 0 END * (a.nl - mn)')} AS ridge, {q6('l.qty - my')} AS persistence FROM ard a JOIN m ON m.row = a.row AND m.col = a.col AND m.month = a.month JOIN par p ON p.row = a.row AND p.col = a.col LEFT JOIN ard l ON l.row = a.row AND l.col = a.col AND l.month = a.month AND l.year = a.year - 1 WHERE a.year > 2000 AND n >= 4")
def predict_response(s, d):
    a = ard(s, d)
    return rounded(H.predict_response(a, _parents(s, d, a), "qty", 2000, 4), "observed", "predicted", "ridge", "persistence")


@query(
    with_sql(POINT)
    + f""", f AS (SELECT row, col, month, avg(qty) AS ym, avg(t) AS tm FROM (SELECT row, col, month, qty, CAST(year * 12 + month - 1 AS DOUBLE) AS t FROM ard WHERE year <= 2000) GROUP BY ALL),
s AS (SELECT row, col, sum((t - tm) * (qty - ym)) / sum((t - tm) * (t - tm)) AS b FROM (SELECT row, col, month, qty, CAST(year * 12 + month - 1 AS DOUBLE) AS t FROM ard WHERE year <= 2000) JOIN f USING (row, col, month) GROUP BY row, col),
e AS (SELECT a.row, a.col, a.year, a.month, a.qty, a.nl, ym + b * (a.year * 12 + a.month - 1 - tm) AS expected FROM ard a JOIN f USING (row, col, month) JOIN s USING (row, col)),
r AS (SELECT *, qty - expected AS u FROM e), m AS (SELECT row, col, avg(u) AS my, avg(nl) AS mn FROM r WHERE year <= 2000 GROUP BY ALL)
SELECT row, col, year, month, qty AS observed, {q6('expected + my + coalesce(weight, 0) * (nl - mn)')} AS predicted, {q6('expected')} AS zero_residual FROM r JOIN m USING (row, col) JOIN par USING (row, col) WHERE year > 2000"""
)
def predict_residual_to_raw(s, d):
    a = ard(s, d)
    r = R.residualize_monthly(a, ["qty"], 2000, least=12, least_month=1)
    p = H.predict_level(r, _parents(s, d, a), "qty_resid", 2000).select("row", "col", "year", "month", "predicted")
    j = r.join(p, ["row", "col", "year", "month"])
    return rounded(j.select("row", "col", "year", "month", F.col("qty").alias("observed"), (F.col("qty_expected") + F.col("predicted")).alias("predicted"), F.col("qty_expected").alias("zero_residual")), "predicted", "zero_residual")


@query(
    with_sql(GAPPY)
    + """, px AS (SELECT DISTINCT row, col FROM nat), w AS (SELECT row, col, CAST(2001 AS INTEGER) AS year, CAST(m AS INTEGER) AS month FROM px, generate_series(1, 6) g(m)), tr AS (SELECT row, col, count(*) AS n FROM ard_gappy WHERE year <= 2000 AND row < 4 GROUP BY ALL),
ev AS (SELECT row, col, year, month, CASE WHEN nl % 4 <> 0 THEN nl END AS nl, qty FROM ard_gappy)
SELECT w.row, w.col, w.year, w.month, CASE WHEN w.col = 4 THEN 'no_parents' WHEN n IS NULL THEN 'no_training_rows' WHEN n < 68 THEN 'too_few_samples' WHEN e.row IS NULL THEN 'row_absent' WHEN e.nl IS NULL THEN 'values_missing' ELSE 'predicted' END AS status,
  CASE WHEN w.col <> 4 AND n >= 68 AND e.row IS NOT NULL AND e.nl IS NULL THEN 'nl' ELSE '' END AS missing
FROM w LEFT JOIN tr USING (row, col) LEFT JOIN ev e ON e.row = w.row AND e.col = w.col AND e.year = w.year AND e.month = w.month"""
)
def prediction_status(s, d):
    a = ard_gappy(s, d)
    from terracause.plans.fixtures import pixels

    px = pixels(s, d).select("row", "col").distinct()
    wanted = px.select("row", "col", F.lit(2001).alias("year"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("month"))
    e = px.where("col <> 4").withColumn("parent", F.lit("nl"))
    ev = a.select("row", "col", "year", "month", F.when(F.col("nl") % 4 != 0, F.col("nl")).alias("nl"), "qty")
    return H.prediction_status(wanted, e, a.where("year <= 2000 and row < 4"), ev, ["nl", "qty"], 68)


@query(with_sql(ARD) + "SELECT row, col, max(year) AS last_year FROM ard WHERE year <= 2000 GROUP BY row, col")
def training_guard(s, d):
    return H.training_guard(ard(s, d).where("year <= 2000").groupBy("row", "col").agg(F.max("year").alias("last_year")), 2000)


@query(
    with_sql(ARD, PREDICTIONS)
    + f""", e AS (SELECT row || '_' || (col // 2) AS block, predicted - observed AS a, climatology - observed AS b FROM predictions WHERE predicted IS NOT NULL AND climatology IS NOT NULL),
k AS (SELECT *, row_number() OVER (ORDER BY block) - 1 AS i, count(*) OVER () AS k FROM (SELECT block, count(*) AS n, sum(a * a) AS qa, sum(b * b) AS qb, sum(abs(a)) AS sa, sum(abs(b)) AS sb FROM e GROUP BY block)),
d AS (SELECT r AS rep, ('0x' || substr(md5(concat_ws('|', r, i)), 1, 8))::BIGINT % k AS i FROM k, generate_series(1, 50) g(r)), u AS (SELECT rep, n, qa, qb, sa, sb FROM d JOIN k USING (i) UNION ALL SELECT 0, n, qa, qb, sa, sb FROM k),
t AS (SELECT rep, 1 - sqrt(sum(qa) / sum(n)) / sqrt(sum(qb) / sum(n)) AS skill, sqrt(sum(qa) / sum(n)) - sqrt(sum(qb) / sum(n)) AS dr, (sum(sa) - sum(sb)) / sum(n) AS dm FROM u GROUP BY rep)
SELECT {q6('max(skill) FILTER (rep = 0)')} AS skill, {q6('quantile_cont(skill, 0.025) FILTER (rep > 0)')} AS skill_low, {q6('quantile_cont(skill, 0.975) FILTER (rep > 0)')} AS skill_high, {q6('max(dr) FILTER (rep = 0)')} AS delta_rmse, {q6('quantile_cont(dr, 0.025) FILTER (rep > 0)')} AS delta_rmse_low, {q6('quantile_cont(dr, 0.975) FILTER (rep > 0)')} AS delta_rmse_high,
  {q6('max(dm) FILTER (rep = 0)')} AS delta_mae, {q6('avg((dr < 0)::INT) FILTER (rep > 0)')} AS p_better FROM t"""
)
def block_bootstrap_skill(s, d):
    p = predictions(s, d).where("predicted is not null and climatology is not null")
    e = p.select(F.concat_ws("_", F.col("row"), F.floor(F.col("col") / 2)).alias("block"), (F.col("predicted") - F.col("observed")).alias("a"), (F.col("climatology") - F.col("observed")).alias("b"))
    r = H.block_bootstrap_skill(e, 50)
    return rounded(r, *r.columns)
