"""Queries over lagged graphs with replicates, scenarios over time, goals and refusals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracause.operators import diagnostics as D
from terracause.operators import graphs as G
from terracause.operators import interventions as I
from terracause.operators import lagged as L
from terracause.operators import landcover as N
from terracause.operators import solvers as S
from terracause.operators.sampling import resample
from terracause.plans.fixtures import ARD, EDGES, REPLICATES, ard, edges, q6, with_sql
from terracause.plans.graphs import CONTRAST, SHARES, VARS, _classed, _consensus, _contrast, rounded
from terracause.sources.tables import scratch, table_replace

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAIR = ["qty", "price"]
#: Replicates of the lagged graphs.
MANY = 200
HORIZON = 24


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def lagged_replicates(s, d, panel: DataFrame | None = None) -> DataFrame:
    """The lagged graph of ``lagged_edges`` with replicates: a row's values and those of the month before are drawn together."""
    panel = ard(s, d) if panel is None else panel
    w = Window.partitionBy("row", "col").orderBy("year", "month")
    rows = panel.select("row", "col", "year", "month", *PAIR, F.lag("qty").over(w).alias("lq"), F.lag("price").over(w).alias("lp")).where("lq is not null")
    names = ["row", "col", "replicate", *PAIR, "lq", "lp"]
    every = rows.withColumn("replicate", F.lit(0)).select(*names).unionByName(resample(rows, MANY).select(*names))
    g = every.groupBy("row", "col", "replicate").agg(F.regr_slope("price", "qty").alias("b"), F.regr_slope("qty", "lq").alias("q"), F.regr_slope("price", "lp").alias("p"))
    e = lambda lag, a, b, c: F.struct(F.lit(lag).alias("lag"), F.lit(a).alias("parent"), F.lit(b).alias("child"), F.col(c).alias("weight"))
    return g.select("row", "col", "replicate", F.inline(F.array(e(0, "qty", "price", "b"), e(1, "qty", "qty", "q"), e(1, "price", "price", "p"))))


LBOOT = f"""pairs AS (SELECT row, col, year, month, qty, price, lag(qty) OVER w AS lq, lag(price) OVER w AS lp FROM ard WINDOW w AS (PARTITION BY row, col ORDER BY year, month)),
pn AS (SELECT row, col, qty, price, lq, lp, row_number() OVER (PARTITION BY row, col ORDER BY year, month) - 1 AS i, count(*) OVER (PARTITION BY row, col) AS n FROM pairs WHERE lq IS NOT NULL),
pd AS (SELECT row, col, rep, ('0x' || substr(md5(concat_ws('|', row, col, rep, i)), 1, 8))::BIGINT % n AS i FROM pn, generate_series(1, {MANY}) g(rep)),
ps AS (SELECT row, col, 0 AS replicate, qty, price, lq, lp FROM pn UNION ALL SELECT row, col, rep, qty, price, lq, lp FROM pd JOIN pn USING (row, col, i)),
lw AS (SELECT row, col, CAST(replicate AS INTEGER) AS replicate, regr_slope(price, qty) AS b, regr_slope(qty, lq) AS q, regr_slope(price, lp) AS p FROM ps GROUP BY ALL),
le AS (SELECT row, col, replicate, CAST(0 AS INTEGER) AS lag, 'qty' AS parent, 'price' AS child, b AS weight FROM lw UNION ALL SELECT row, col, replicate, 1, 'qty', 'qty', q FROM lw UNION ALL SELECT row, col, replicate, 1, 'price', 'price', p FROM lw)"""
# the recursion Theta_h = A Theta_{h-1}, with A = [[q, 0], [b q, p]]
STEPS = """th AS (SELECT row, col, replicate, b, q, p, 0 AS h, 1.0::DOUBLE AS qq, b AS qp, 1.0::DOUBLE AS pp FROM lw
  UNION ALL SELECT row, col, replicate, b, q, p, h + 1, q * qq, b * q * qq + p * qp, p * pp FROM th WHERE h < {horizon})"""
THETA = """tl AS (SELECT row, col, replicate, h, greatest(abs(q), abs(p)) AS radius, 'qty' AS source, 'qty' AS target, CASE h WHEN 1 THEN q ELSE 0 END AS direct, CASE h WHEN 0 THEN 1 WHEN 1 THEN q END AS slice, qq AS e FROM th
  UNION ALL SELECT row, col, replicate, h, greatest(abs(q), abs(p)), 'qty', 'price', CASE h WHEN 0 THEN b ELSE 0 END, CASE h WHEN 0 THEN b WHEN 1 THEN b * q END, qp FROM th
  UNION ALL SELECT row, col, replicate, h, greatest(abs(q), abs(p)), 'price', 'price', CASE h WHEN 1 THEN p ELSE 0 END, CASE h WHEN 0 THEN 1 WHEN 1 THEN p END, pp FROM th
  UNION ALL SELECT row, col, replicate, h, greatest(abs(q), abs(p)), 'price', 'qty', 0, CASE WHEN h < 2 THEN 0 END, 0 FROM th),
tc AS (SELECT *, sum(e) OVER (PARTITION BY row, col, replicate, source, target ORDER BY h) AS c FROM tl)"""


@query(with_sql(ARD, LBOOT, STEPS.format(horizon=HORIZON), THETA, recursive=True) + f"SELECT row, col, source, target, CAST(h AS INTEGER) AS horizon, {q6('direct')} AS direct, {q6('slice')} AS lag_slice, {q6('e')} AS effect, {q6('c')} AS cumulative, {q6('radius')} AS radius, radius < 1 AS stable FROM tc WHERE replicate = 0")
def dynamic_effects_long(s, d):
    """Two years of horizons of every pair."""
    out = L.dynamic_effects(lagged_replicates(s, d).where("replicate = 0"), PAIR, HORIZON, connected=False)
    return rounded(out.drop("replicate"), "direct", "lag_slice", "effect", "cumulative", "radius")


def _summaries(value: str) -> str:
    return f"{q6(f'avg({value})')} AS {{name}}_boot_mean, {q6(f'stddev_samp({value})')} AS {{name}}_boot_sd, {q6(f'quantile_cont({value}, 0.025)')} AS {{name}}_ci_low, {q6(f'quantile_cont({value}, 0.975)')} AS {{name}}_ci_high, {q6(f'avg(({value} > 0)::INT)')} AS {{name}}_p_positive, quantile_cont({value}, 0.025) > 0 OR quantile_cont({value}, 0.975) < 0 AS {{name}}_excludes_zero"


@query(
    with_sql(ARD, LBOOT, STEPS.format(horizon=6), THETA, CONTRAST, recursive=True)
    + f""", ts AS (SELECT tc.*, e * a.delta / nullif(z.delta, 0) AS sc, c * a.delta / nullif(z.delta, 0) AS scc FROM tc JOIN contrast a ON a.row = tc.row AND a.col = tc.col AND a.variable = source JOIN contrast z ON z.row = tc.row AND z.col = tc.col AND z.variable = target),
bs AS (SELECT row, col, source, target, h, count(*) AS n_stable, {_summaries('e').format(name='effect')}, {_summaries('c').format(name='cumulative')}, {_summaries('sc').format(name='scaled')} FROM ts WHERE replicate > 0 AND radius < 1 GROUP BY row, col, source, target, h),
n AS (SELECT row, col, count(DISTINCT replicate) AS n_replicates FROM lw WHERE replicate > 0 GROUP BY row, col)
SELECT row, col, source, target, CAST(h AS INTEGER) AS horizon, {q6('direct')} AS direct, {q6('slice')} AS lag_slice, {q6('e')} AS effect, {q6('c')} AS cumulative, {q6('radius')} AS radius, radius < 1 AS stable, {q6('sc')} AS scaled, {q6('scc')} AS scaled_cumulative, coalesce(n_stable, 0) AS n_stable, n_replicates, bs.* EXCLUDE (row, col, source, target, h, n_stable)
FROM (SELECT * FROM ts WHERE replicate = 0) p LEFT JOIN bs USING (row, col, source, target, h) LEFT JOIN n USING (row, col)"""
)
def dynamic_table(s, d):
    """Effects of half a year with intervals over stable replicates."""
    e = lagged_replicates(s, d)
    out = L.dynamic_table(L.dynamic_effects(e, PAIR, 6, connected=False), _contrast(s, d), e.select("row", "col", "replicate").distinct())
    return rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


# --- scenarios over time

START = (1998, 6)
OVER_TIME = [I.Scenario("pulse", (I.Hard("qty", I.Value("delta", 5.0)),)), I.Scenario("both", (I.Hard("qty", I.Value("zdelta", 1.0)), I.Hard("price", I.Value("scale", 1.1))))]
# windows from the month before the start to three months after; how far qty (y) and price (z) are moved at each step
WINDOW = f""", sr AS (SELECT row, col, year, month, qty, price, row_number() OVER (PARTITION BY row, col ORDER BY year, month) AS i, count(*) OVER (PARTITION BY row, col) AS n, year * 12 + month AS ym, stddev_samp(qty) OVER (PARTITION BY row, col) AS sd FROM ard),
st AS (SELECT row, col, max(i) FILTER (year = {START[0]} AND month = {START[1]}) AS s, max(n) AS n, max(sd) AS sd FROM sr GROUP BY row, col),
wi AS (SELECT sr.row, sr.col, i - s AS step, ym, qty, price FROM sr JOIN st USING (row, col) WHERE i - s BETWEEN -1 AND 3),
wx AS (SELECT st.row, st.col, any_value(sd) AS sd, {', '.join(f'max({v}) FILTER (step = {t}) AS {v[0]}{t}' for v in PAIR for t in range(4))},
  CASE WHEN s IS NULL THEN 'no row for the start month' WHEN s <= 1 THEN 'not enough months before the start' WHEN s + 3 > st.n THEN 'the horizon is beyond the series' WHEN max(ym) - min(ym) <> 4 THEN 'months are missing' END AS error
  FROM st LEFT JOIN wi USING (row, col) GROUP BY st.row, st.col, s, st.n),
good AS (SELECT wx.*, replicate, b, q, p FROM wx JOIN lw USING (row, col) WHERE error IS NULL),
y AS (SELECT *, 'pulse' AS scenario, 5.0::DOUBLE AS y0, 5.0::DOUBLE AS y1, b * 5 AS z0, b * 5 + p * b * 5 AS z1 FROM good UNION ALL SELECT *, 'both', sd, sd, p0 * 0.1, p1 * 0.1 FROM good),
y2 AS (SELECT *, q * y1 AS y2, b * q * y1 + p * z1 AS z2 FROM y), y3 AS (SELECT *, q * y2 AS y3, b * q * y2 + p * z2 AS z3 FROM y2),
path AS (SELECT row, col, replicate, scenario, 'qty' AS target, h AS horizon, greatest(abs(q), abs(p)) < 1 AS stable, [q0, q1, q2, q3][h + 1] AS factual, [y0, y1, y2, y3][h + 1] AS effect FROM y3, generate_series(0, 3) g(h)
  UNION ALL SELECT row, col, replicate, scenario, 'price', h, greatest(abs(q), abs(p)) < 1, [p0, p1, p2, p3][h + 1], [z0, z1, z2, z3][h + 1] FROM y3, generate_series(0, 3) g(h)),
pc AS (SELECT *, sum(effect) OVER (PARTITION BY row, col, replicate, scenario, target ORDER BY horizon) AS cumulative FROM path)"""


@query(with_sql(ARD, LBOOT) + WINDOW + f" SELECT row, col, replicate, scenario, target, CAST(horizon AS INTEGER) AS horizon, horizon < 2 AS active, {q6('factual')} AS factual, {q6('factual + effect')} AS counterfactual, {q6('effect')} AS effect, {q6('cumulative')} AS cumulative, stable FROM pc WHERE replicate <= 20")
def var_counterfactual(s, d):
    """Two scenarios held for two months from June 1998 on the pixels' own innovations, by the fit and the first replicates."""
    a = ard(s, d)
    out = L.var_paths(lagged_replicates(s, d, a).where("replicate <= 20"), a, PAIR, OVER_TIME, PAIR, 3, 2, START)
    return rounded(out, "factual", "counterfactual", "effect", "cumulative")


def _four(value: str) -> str:
    return f"{q6(f'avg({value})')} AS {value}_boot_mean, {q6(f'quantile_cont({value}, 0.025)')} AS {value}_ci_low, {q6(f'quantile_cont({value}, 0.975)')} AS {value}_ci_high, quantile_cont({value}, 0.025) > 0 OR quantile_cont({value}, 0.975) < 0 AS {value}_excludes_zero"


@query(
    with_sql(ARD, LBOOT)
    + WINDOW
    + f""", bt AS (SELECT row, col, scenario, target, horizon, count(*) AS n_stable, {_four('effect')}, {_four('cumulative')} FROM pc WHERE replicate > 0 AND stable GROUP BY ALL)
SELECT row, col, scenario, target, CAST(horizon AS INTEGER) AS horizon, horizon < 2 AS active, {q6('factual')} AS factual, {q6('factual + effect')} AS counterfactual, {q6('effect')} AS effect, {q6('cumulative')} AS cumulative, stable, bt.* EXCLUDE (row, col, scenario, target, horizon), NULL::VARCHAR AS error FROM (SELECT * FROM pc WHERE replicate = 0) f LEFT JOIN bt USING (row, col, scenario, target, horizon)
UNION ALL BY NAME SELECT row, col, scenario, error FROM wx, (VALUES ('pulse'), ('both')) v(scenario) WHERE error IS NOT NULL"""
)
def var_scenario_table(s, d):
    a = ard(s, d)
    out = L.var_scenario_table(lagged_replicates(s, d, a), a, PAIR, OVER_TIME, PAIR, 3, 2, START)
    return rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


@query(
    with_sql(ARD, LBOOT)
    + f""", y AS (SELECT row, col, replicate, b, q, p, 2 * sd AS y0, b * 2 * sd AS z0 FROM lw JOIN (SELECT row, col, stddev_samp(qty) AS sd FROM ard GROUP BY row, col) USING (row, col)),
path AS (SELECT row, col, replicate, 'qty' AS target, h, [y0, q * y0, q * q * y0][h + 1] AS e FROM y, generate_series(0, 2) g(h) UNION ALL SELECT row, col, replicate, 'price', h, [z0, b * q * y0 + p * z0, b * q * q * y0 + p * (b * q * y0 + p * z0)][h + 1] FROM y, generate_series(0, 2) g(h))
SELECT row, col, replicate, target, CAST(h AS INTEGER) AS horizon, {q6('e')} AS effect, {q6('sum(e) OVER (PARTITION BY row, col, replicate, target ORDER BY h)')} AS cumulative FROM path"""
)
def var_mean_path(s, d):
    """From a state of zero: qty up by two of its deviations for a month."""
    up = I.Scenario("up", (I.Hard("qty", I.Value("zdelta", 2.0)),))
    a = ard(s, d)
    out = L.var_paths(lagged_replicates(s, d, a), a, PAIR, [up], PAIR, 2, 1)
    return rounded(out.select("row", "col", "replicate", "target", "horizon", "effect", "cumulative"), "effect", "cumulative")


LPROB = LBOOT + ", lp AS (SELECT row, col, lag, parent, child, avg((abs(weight) > 0.1)::INT) AS probability FROM le WHERE replicate > 0 GROUP BY ALL)"


@query(with_sql(ARD, LPROB) + f"SELECT row, col, lag, parent, child, {q6('probability')} AS probability FROM lp")
def lagged_edge_probability(s, d):
    return rounded(G.edge_probability(lagged_replicates(s, d), 0.1), "probability")


@query(with_sql(ARD, LPROB) + f"SELECT row, col, lag, parent, child, {q6('weight')} AS weight, {q6('probability')} AS probability FROM le JOIN lp USING (row, col, lag, parent, child) WHERE replicate = 0 AND probability >= 0.5 AND abs(weight) >= 0.12")
def lagged_consensus(s, d):
    out = G.consensus_edges(lagged_replicates(s, d), 0.5, 0.12, 0.1)
    return rounded(out.select("row", "col", "lag", "parent", "child", "weight", "probability"), "weight", "probability")


# --- goals, refusals, components and values; edges run nl -> qty -> price


def q3(x: str) -> str:
    return f"floor(({x}) * 1e3 + 0.5031) / 1e3"


def thousandths(df, *names):
    return df.select(*[(F.floor(F.col(c) * 1e3 + 0.5031) / 1e3).alias(c) if c in names else c for c in df.columns])


FOUR = ["nl", "disc", "qty", "price"]


def wide_edges(s, d) -> DataFrame:
    """nl and disc are parents of qty and of price, by least squares on both; with replicates."""
    names = ["row", "col", "replicate", *FOUR]
    panel = ard(s, d)
    rows = panel.withColumn("replicate", F.lit(0)).select(*names).unionByName(resample(panel.select("row", "col", "year", "month", *FOUR), REPLICATES).select(*names))
    v, c = F.var_pop, F.covar_pop
    det = v("nl") * v("disc") - c("nl", "disc") * c("nl", "disc")
    slope = lambda y, a, b: (c(a, y) * v(b) - c(b, y) * c("nl", "disc")) / det
    g = rows.groupBy("row", "col", "replicate").agg(*[slope(y, a, b).alias(f"{a}_{y}") for y in PAIR for a, b in (("nl", "disc"), ("disc", "nl"))])
    return g.select("row", "col", "replicate", F.inline(F.array(*[F.struct(F.lit(a).alias("parent"), F.lit(y).alias("child"), F.col(f"{a}_{y}").alias("weight")) for y in PAIR for a in ("nl", "disc")])))


_DET = "(var_pop(nl) * var_pop(disc) - covar_pop(nl, disc) * covar_pop(nl, disc))"
WIDE = EDGES.replace("SELECT row, col, qty, price, nl, row_number()", "SELECT row, col, qty, price, nl, disc, row_number()").replace("SELECT row, col, 0 AS replicate, qty, price, nl FROM numbered UNION ALL SELECT row, col, rep, qty, price, nl FROM draws", "SELECT row, col, 0 AS replicate, qty, price, nl, disc FROM numbered UNION ALL SELECT row, col, rep, qty, price, nl, disc FROM draws") + ", ww AS (SELECT row, col, CAST(replicate AS INTEGER) AS replicate, " + ", ".join(
    f"(covar_pop({a}, {y}) * var_pop({b}) - covar_pop({b}, {y}) * covar_pop(nl, disc)) / {_DET} AS {a}_{y}" for y in PAIR for a, b in (("nl", "disc"), ("disc", "nl"))
) + " FROM sampled GROUP BY row, col, replicate)"
JOINT = I.Scenario("joint", goals=(I.Goal("nl", "qty", I.Value("delta", 0.5)), I.Goal("disc", "price", I.Value("delta", 0.25))))


@query(
    with_sql(WIDE)
    + f""", k AS (SELECT row, col, replicate, (0.5 * disc_price - 0.25 * disc_qty) / (nl_qty * disc_price - disc_qty * nl_price) AS nl, (nl_qty * 0.25 - nl_price * 0.5) / (nl_qty * disc_price - disc_qty * nl_price) AS disc FROM ww),
m AS (SELECT row, col, avg(nl) AS nl, avg(disc) AS disc FROM ard GROUP BY row, col)
SELECT row, col, replicate, 'nl' AS name, {q3('m.nl')} AS baseline, {q3('k.nl')} AS change, {q3('m.nl + k.nl')} AS required FROM k JOIN m USING (row, col) UNION ALL SELECT row, col, replicate, 'disc', {q3('m.disc')}, {q3('k.disc')}, {q3('m.disc + k.disc')} FROM k JOIN m USING (row, col)"""
)
def goal_seek_joint(s, d):
    """Two variables that bring two targets to their goals together (Cramer's rule in SQL)."""
    out = I.required_values(wide_edges(s, d), ard(s, d), [JOINT], FOUR)
    return thousandths(out.select("row", "col", "replicate", "name", "baseline", "change", "required"), "baseline", "change", "required")


WITH_GOALS = [
    I.Scenario("reach", goals=(I.Goal("qty", "price", I.Value("delta", 1.0)),)),
    I.Scenario("steeper and reach", (I.Hard("nl", I.Value("delta", 5.0)),), (I.Mechanism("nl", "qty", "scale", 2.0),), (I.Goal("qty", "price", I.Value("fraction_to", 0.5, I.Value("median"))),)),
    I.Scenario("out of reach", goals=(I.Goal("price", "qty", I.Value("delta", 1.0)),)),
    I.Scenario("new edge", mechanisms=(I.Mechanism("nl", "price", "set", 0.5),)),
    I.Scenario("itself", mechanisms=(I.Mechanism("qty", "qty", "scale", 2.0),)),
]


@query(
    with_sql(EDGES)
    + f""", w AS (SELECT row, col, replicate, max(weight) FILTER (parent = 'qty') AS b FROM edges GROUP BY ALL), m AS (SELECT row, col, median(price) AS m FROM ard GROUP BY ALL),
ev AS (SELECT row, col, replicate, year, month, 'reach' AS scenario, 1 / b AS qty, 1.0::DOUBLE AS price FROM w JOIN ard USING (row, col) UNION ALL SELECT row, col, replicate, year, month, 'steeper and reach', 0.5 * (m - price) / b, 0.5 * (m - price) FROM w JOIN ard USING (row, col) JOIN m USING (row, col)),
l AS (SELECT row, col, replicate, scenario, 'qty' AS target, qty AS e FROM ev UNION ALL SELECT row, col, replicate, scenario, 'price', price FROM ev), u AS (SELECT row, col, replicate, scenario, target, quantile_cont(e, 0.5) AS e FROM l GROUP BY ALL)
SELECT row, col, scenario, target, {q6('max(e) FILTER (replicate = 0)')} AS effect, {q6('avg(e) FILTER (replicate > 0)')} AS boot_mean, {q6('quantile_cont(e, 0.025) FILTER (replicate > 0)')} AS ci_low, {q6('quantile_cont(e, 0.975) FILTER (replicate > 0)')} AS ci_high, NULL::VARCHAR AS error FROM u GROUP BY row, col, scenario, target
UNION ALL BY NAME SELECT DISTINCT row, col, scenario, error FROM ard, (VALUES ('out of reach', 'goals: singular'), ('new edge', 'no edge: nl->price'), ('itself', 'self-loops: qty')) v(scenario, error)"""
)
def scenario_goals(s, d):
    """Goals beside set variables and mechanisms; goals out of reach, new edges and self-loops are error rows."""
    return rounded(I.scenario_table(edges(s, d), ard(s, d), WITH_GOALS, PAIR, VARS, "median"), "effect", "boot_mean", "ci_low", "ci_high")


PARTS = I.Scenario("parts", (I.Hard("nl", I.Value("delta", 5.0)),), (I.Mechanism("qty", "price", "scale", 2.0),))
PARTS_GOAL = I.Scenario("goal", (I.Hard("nl", I.Value("delta", 5.0)),), (I.Mechanism("qty", "price", "scale", 2.0),), (I.Goal("qty", "price", I.Value("delta", 1.0)),))


@query(
    with_sql(EDGES)
    + f""", w AS (SELECT row, col, max(weight) FILTER (parent = 'nl') AS a, max(weight) FILTER (parent = 'qty') AS b FROM edges WHERE replicate = 0 GROUP BY ALL),
x AS (SELECT w.*, year, month, qty, qty - avg(qty) OVER (PARTITION BY row, col) AS z FROM ard JOIN w USING (row, col))
SELECT 'parts' AS scenario, row, col, year, month, kind, name, {q6('v')} AS contribution FROM (SELECT row, col, year, month, 'mechanism' AS kind, 'mechanisms' AS name, b * z AS v FROM x UNION ALL SELECT row, col, year, month, 'hard', 'nl', 10 * a * b FROM x UNION ALL SELECT row, col, year, month, 'path', 'nl->qty->price', 10 * a * b FROM x)
UNION ALL SELECT 'goal', row, col, year, month, kind, name, {q6('v')} FROM (SELECT row, col, year, month, 'mechanism' AS kind, 'mechanisms' AS name, b * z AS v FROM x UNION ALL SELECT row, col, year, month, 'goal', 'qty', 1 - b * z FROM x UNION ALL SELECT row, col, year, month, 'required', 'qty', qty + (1 - b * z) / (2 * b) FROM x)"""
)
def intervention_components_all(s, d):
    """Mechanisms, set variables, goals and required values at each event; mechanism, hard and goal rows add up to the effect."""
    e, p = edges(s, d), ard(s, d)
    one = lambda scenario: I.intervention_components(e, p, scenario, "price", VARS, 3, "none").withColumn("scenario", F.lit(scenario.name))
    return rounded(one(PARTS).unionByName(one(PARTS_GOAL)), "contribution")


@query(with_sql(EDGES) + ", prob AS (SELECT row, col, parent, child, avg((abs(weight) > 0.02)::INT) AS probability FROM edges WHERE replicate > 0 GROUP BY ALL), cons AS (SELECT row, col, parent, child FROM edges JOIN prob USING (row, col, parent, child) WHERE replicate = 0 AND probability >= 0.5 AND abs(weight) >= 0.03) SELECT row, col, CAST(0 AS INTEGER) AS replicate, 'no edge: nl->qty' AS error FROM cons GROUP BY row, col HAVING count(*) FILTER (parent = 'nl') = 0")
def mechanism_refusals(s, d):
    """Consensus graphs that have no edge to add to."""
    return I.mechanism_refusals(_consensus(s, d).withColumn("replicate", F.lit(0)), (I.Mechanism("qty", "price", "scale", 0.5), I.Mechanism("nl", "qty", "add", 0.1)), VARS)


KINDS = {
    "mean": (I.Value("mean"), "avg(qty) OVER p"),
    "median": (I.Value("median"), "median(qty) OVER p"),
    "quantile": (I.Value("quantile", 0.25), "quantile_cont(qty, 0.25) OVER p"),
    "qdelta": (I.Value("qdelta", 0.5), "qty + 0.5 * (quantile_cont(qty, 0.9) OVER p - quantile_cont(qty, 0.1) OVER p)"),
    "zdelta": (I.Value("zdelta", -1.5), "qty - 1.5 * stddev_samp(qty) OVER p"),
    "scale": (I.Value("scale", 1.1), "qty * 1.1"),
    "fixed": (I.Value("fixed", 3.0), "3"),
    "climatology_mean": (I.Value("climatology_mean"), "avg(qty) OVER m"),
    "climatology_median by year": (I.Value("climatology_median", by=("year",)), "median(qty) OVER y"),
    "climatology_quantile": (I.Value("climatology_quantile", 0.75), "quantile_cont(qty, 0.75) OVER m"),
    "climatology_mean by both": (I.Value("climatology_mean", by=("year", "month")), "avg(qty) OVER ym"),
    "fraction_to": (I.Value("fraction_to", 0.5), "qty + 0.5 * (avg(qty) OVER p - qty)"),
    "fraction_to climatology": (I.Value("fraction_to", 0.25, I.Value("climatology_median")), "qty + 0.25 * (median(qty) OVER m - qty)"),
    "fraction_to fraction_to": (I.Value("fraction_to", 0.5, I.Value("fraction_to", 0.5, I.Value("quantile", 0.9))), "qty + 0.5 * (qty + 0.5 * (quantile_cont(qty, 0.9) OVER p - qty) - qty)"),
}


@query(with_sql(ARD) + " UNION ALL ".join(f"SELECT row, col, year, month, '{k}' AS kind, {q6(text)} AS value FROM ard WINDOW p AS (PARTITION BY row, col), m AS (PARTITION BY row, col, month), y AS (PARTITION BY row, col, year), ym AS (PARTITION BY row, col, year, month)" for k, (_, text) in KINDS.items()))
def value_kinds(s, d):
    """A value of each kind at every row, from one set of statistics."""
    values, panel = I.Values(), ard(s, d)
    columns = [F.struct(F.lit(k).alias("kind"), values.column("qty", v).cast("double").alias("value")) for k, (v, _) in KINDS.items()]
    return rounded(values.joined(panel, panel).select("row", "col", "year", "month", F.inline(F.array(*columns))), "value")


# --- learning lagged graphs, and how white their innovations are


@query()
def bootstrap_lagged_edges(s, d):
    """Lagged graphs with replicates from redrawn residuals: every weight of a replicate is of one series."""
    return S.lagged_graphs(ard(s, d), PAIR, MANY, most=2, least=40)


@query()
def lagged_bootstrap_effects(s, d):
    """Consensus by lag and half a year of effects with intervals, from the learnt lagged graphs."""
    e = table_replace(S.lagged_graphs(ard(s, d), PAIR, MANY, most=2, least=40), scratch(s, "lagged-graphs"))
    table = L.dynamic_table(L.dynamic_effects(e, PAIR, 6, connected=False), _contrast(s, d), e.select("row", "col", "replicate").distinct())
    kept = G.consensus_edges(e, 0.5, 0.05, 0.02).groupBy("row", "col").agg(F.count("*").alias("n_edges"), F.max("lag").alias("deepest"))
    return table.join(kept, ["row", "col"], "left")


def _whiteness_sql(lags: int, by_lag: bool = False) -> str:
    """Two variables: covariances by sums of products, the inverse of C0 in closed form, and the chi-square tail of an even number of degrees."""
    cov = ", ".join(f"sum({a} * {b}{h}) / count(*) AS {a}{b}{h}" for h in range(1, lags + 1) for a in "xy" for b in "xy")
    past = ", ".join(f"lag({v}, {h}) OVER o AS {v}{h}" for h in range(1, lags + 1) for v in "xy")
    terms = []
    for h in range(1, lags + 1):
        c = {(i, j): f"coalesce({'xy'[i]}{'xy'[j]}{h}, 0)" for i in (0, 1) for j in (0, 1)}
        sc = {(i, j): f"(s{i}0 * {c[0, j]} + s{i}1 * {c[1, j]})" for i in (0, 1) for j in (0, 1)}
        cs = {(i, j): f"({c[i, 0]} * s0{j} + {c[i, 1]} * s1{j})" for i in (0, 1) for j in (0, 1)}
        terms.append(f"n * n / greatest(n - {h}, 1) * ({' + '.join(f'{sc[k]} * {cs[k]}' for k in sc)})")
    cumulative = [" + ".join(terms[:h]) for h in range(1, lags + 1)]
    base = f"""zz AS (SELECT row, col, year, month, qty - avg(qty) OVER p AS x, price - avg(price) OVER p AS y FROM ard WINDOW p AS (PARTITION BY row, col)),
zl AS (SELECT row, col, x, y, {past} FROM zz WINDOW o AS (PARTITION BY row, col ORDER BY year, month)),
zc AS (SELECT row, col, count(*)::DOUBLE AS n, sum(x * x) / count(*) AS xx, sum(x * y) / count(*) AS xy, sum(y * y) / count(*) AS yy, {cov} FROM zl GROUP BY row, col),
zs AS (SELECT *, yy / (xx * yy - xy * xy) AS s00, -xy / (xx * yy - xy * xy) AS s01, -xy / (xx * yy - xy * xy) AS s10, xx / (xx * yy - xy * xy) AS s11 FROM zc)"""
    tail = lambda half: f"exp(-q / 2) * list_sum(list_transform(range({half}), lambda k: exp(k * ln(q / 2) - lgamma(k + 1))))"
    if by_lag:
        each = " UNION ALL ".join(f"SELECT row, col, n, CAST({h} AS INTEGER) AS lag, {terms[h - 1]} AS part, {cumulative[h - 1]} AS q FROM zs WHERE n > {lags + 1}" for h in range(1, lags + 1))
        # one lag is fitted
        return base + f", zq AS ({each}) SELECT row, col, CAST(n AS INTEGER) AS n, lag, {q6('part')} AS part, {q6('q')} AS q, CAST(4 * (lag - 1) AS INTEGER) AS df, CASE WHEN lag > 1 THEN {q6(tail('2 * lag - 2'))} END AS p FROM zq"
    return base + f""",
zq AS (SELECT row, col, n, {' + '.join(terms)} AS q FROM zs)
SELECT row, col, CAST(n AS INTEGER) AS n, {q6('q')} AS q, CAST({4 * lags} AS INTEGER) AS df, {q6(tail(2 * lags))} AS p FROM zq"""


@query(with_sql(ARD) + ", " + _whiteness_sql(4))
def portmanteau_pair(s, d):
    """Whiteness of two series together over four months, with the tail of its distribution."""
    return rounded(D.portmanteau(ard(s, d), PAIR, 4), "q", "p")


@query(with_sql(ARD) + ", " + _whiteness_sql(6, True))
def portmanteau_lags(s, d):
    """What each of six months adds to the whiteness statistic, after a fit of one lag."""
    return rounded(D.portmanteau_by_lag(ard(s, d), PAIR, 6, 1), "part", "q", "p")


@query(
    with_sql(ARD, LPROB)
    + f""", h AS (SELECT *, CASE WHEN probability <= 0 OR probability >= 1 THEN 0 ELSE -probability * log2(probability) - (1 - probability) * log2(1 - probability) END AS h FROM lp),
z AS (SELECT row, col, count(*) AS n_edges, avg(h) AS mean_entropy, max(h) AS max_entropy, count(*) FILTER (abs(probability - 0.5) <= 0.2) AS near_threshold FROM h WHERE lag = 0 GROUP BY row, col),
l AS (SELECT row, col, count(*) AS lagged_edges, avg(h) AS lagged_mean_entropy, max(h) AS lagged_max_entropy, count(*) FILTER (abs(probability - 0.5) <= 0.2) AS lagged_near_threshold FROM h WHERE lag > 0 GROUP BY row, col)
SELECT row, col, {q6('avg(h)')} AS combined_entropy, any_value(n_edges) AS n_edges, {q6('any_value(mean_entropy)')} AS mean_entropy, {q6('any_value(max_entropy)')} AS max_entropy, any_value(near_threshold) AS near_threshold, CAST(0 AS BIGINT) AS conflicts, any_value(lagged_edges)::BIGINT AS lagged_edges, {q6('any_value(lagged_mean_entropy)')} AS lagged_mean_entropy, {q6('any_value(lagged_max_entropy)')} AS lagged_max_entropy, any_value(lagged_near_threshold)::BIGINT AS lagged_near_threshold, CAST(1 AS INTEGER) AS least_sure_lag
FROM h LEFT JOIN z USING (row, col) LEFT JOIN l USING (row, col) GROUP BY row, col"""
)
def lagged_edge_stability(s, d):
    out = D.lagged_edge_stability(G.edge_probability(lagged_replicates(s, d), 0.1), 0.2, 0.5)
    return rounded(out, "combined_entropy", "mean_entropy", "max_entropy", "lagged_mean_entropy", "lagged_max_entropy")


@query(
    with_sql(EDGES)
    + f""", w AS (SELECT row, col, replicate, max(weight) FILTER (parent = 'qty') AS b FROM edges GROUP BY ALL), m AS (SELECT row, col, avg(qty) AS m, quantile_cont(qty, 0.75) AS up FROM ard GROUP BY ALL),
ev AS (SELECT w.row, w.col, replicate, avg(0.5 * b * (a.qty - m) + 1.5 * b * (up - a.qty)) AS e FROM w JOIN ard a ON a.row = w.row AND a.col = w.col JOIN m ON m.row = w.row AND m.col = w.col WHERE a.month IN (6, 7, 8) AND a.year >= 1998 GROUP BY w.row, w.col, replicate)
SELECT row, col, 'summers' AS scenario, 'price' AS target, {q6('max(e) FILTER (replicate = 0)')} AS effect, {q6('avg(e) FILTER (replicate > 0)')} AS boot_mean, {q6('quantile_cont(e, 0.025) FILTER (replicate > 0)')} AS ci_low, {q6('quantile_cont(e, 0.975) FILTER (replicate > 0)')} AS ci_high, NULL::VARCHAR AS error FROM ev GROUP BY row, col"""
)
def scenario_chosen_events(s, d):
    """Only summers from 1998 on are events; means and quantiles are of all rows."""
    up = I.Scenario("summers", (I.Hard("qty", I.Value("quantile", 0.75)),), (I.Mechanism("qty", "price", "scale", 1.5),))
    out = I.scenario_table(edges(s, d), ard(s, d), [up], ["price"], VARS, "mean", F.col("month").isin(6, 7, 8) & (F.col("year") >= 1998))
    return rounded(out, "effect", "boot_mean", "ci_low", "ci_high")


# --- structure over all pixels, ranks and folds

CRITICAL = 1.959963984540054


def _dependent(r: str, given: int) -> str:
    return f"abs(atanh({r})) * sqrt(n - {given} - 3) > {CRITICAL}"


def _search_sql(replicates: int) -> str:
    """PC on three variables q, p, t: marginal tests, tests given the third, and the one possible collider."""
    pairs = {"qp": ("q", "p", "t"), "qt": ("q", "t", "p"), "pt": ("p", "t", "q")}
    name = lambda a, b: "".join(sorted((a, b), key="qpt".index))
    sums = ", ".join([f"sum(k * {a}) AS s{a}" for a in "qpt"] + [f"sum(k * {a} * {b}) AS m{a}{b}" for i, a in enumerate("qpt") for b in "qpt"[i:]])
    cov = lambda a, b: f"(m{name(a, b) if a != b else a + a} / n - s{a} * s{b} / n / n)"
    corr = ", ".join(f"{cov(a, b)} / sqrt({cov(a, a)} * {cov(b, b)}) AS r{k}" for k, (a, b, _) in pairs.items())
    first = ", ".join(f"{_dependent('r' + k, 0)} AS a{k}" for k in pairs)
    second = []
    for k, (a, b, c) in pairs.items():
        x, y = f"r{name(a, c)}", f"r{name(b, c)}"
        rho = f"(r{k} - {x} * {y}) / sqrt((1 - {x} * {x}) * (1 - {y} * {y}))"
        second.append(f"a{k} AND (NOT (a{name(a, c)} OR a{name(b, c)}) OR {_dependent(rho, 1)}) AS e{k}")
    ends = []
    for k, (a, b, c) in pairs.items():
        # into b if a and c are apart from the start, into a if b and c are
        into_b = f"(NOT a{name(a, c)} AND e{name(b, c)})"
        into_a = f"(NOT a{name(b, c)} AND e{name(a, c)})"
        full = {"q": "qty", "p": "price", "t": "tax"}
        ends.append(f"SELECT '{full[a]}' AS a, '{full[b]}' AS b, CASE WHEN NOT e{k} THEN 'none' WHEN {into_b} THEN '-->' WHEN {into_a} THEN '<--' ELSE '---' END AS endpoint FROM f")
    return f"""m AS (SELECT avg(qty) AS q, avg(price) AS p, avg(tax) AS t FROM ard),
u AS (SELECT r AS rep, qty - m.q AS q, price - m.p AS p, tax - m.t AS t, ('0x' || substr(md5(concat_ws('|', r, row, col, year, month)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM ard, m, generate_series(1, {replicates}) g(r)),
w AS (SELECT *, {' + '.join(f'(u >= {x})::INT' for x in SHARES)} AS k FROM u),
c AS (SELECT rep, sum(k)::DOUBLE AS n, {sums} FROM w GROUP BY rep), d AS (SELECT n, {corr} FROM c), e AS (SELECT *, {first} FROM d), f AS (SELECT *, {', '.join(second)} FROM e)
SELECT a, b, endpoint, count(*) AS n FROM ({' UNION ALL '.join(ends)}) GROUP BY ALL"""


@query(with_sql(ARD) + ", " + _search_sql(2000))
def pooled_search(s, d):
    """Structure of three variables by 2,000 replicates of all rows."""
    return G.pooled_search(ard(s, d), ["qty", "price", "tax"], 2000)


@query(
    """WITH e AS (SELECT label, (vec_id // 20) % 20 % 5 || '_' || (vec_id % 20) // 5 AS block FROM embeddings), n AS (SELECT block, label, count(*) AS n FROM e GROUP BY ALL),
k AS (SELECT greatest(2, least(5, min(k))) AS n FROM (SELECT count(DISTINCT block) AS k FROM e GROUP BY label)),
b AS (SELECT block, arg_max(label, n * 1000 + label) AS c, sum(n) AS s FROM n GROUP BY block), r AS (SELECT block, (row_number() OVER (ORDER BY c, s DESC, block) - 1) % (2 * k.n) AS t, k.n FROM b, k)
SELECT block, CAST(CASE WHEN t < n THEN t ELSE 2 * n - 1 - t END AS INTEGER) AS fold FROM r"""
)
def spatial_fold_assignment(s, d):
    return N.spatial_folds(_classed(s, d), "label", "block", 5)
