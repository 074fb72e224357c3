"""Queries over graphs, effects, interventions, lagged dynamics, diagnostics and classification, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracause.functions import columns as C
from terracause.operators import diagnostics as D
from terracause.operators import effects as E
from terracause.operators import graphs as G
from terracause.operators import interventions as I
from terracause.operators import lagged as L
from terracause.operators import landcover as N
from terracause.operators import solvers as S
from terracause.plans.fixtures import ARD, EDGES, GAPPY, REPLICATES, ard, ard_gappy, edges, q6, table, with_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
VARS = ["nl", "qty", "price"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df, *names):
    return df.select(*[C.r6(c).alias(c) if c in names else c for c in df.columns])


# --- graph tables

@query(with_sql(ARD) + ", v AS (SELECT DISTINCT row, col, unnest(['nl', 'qty', 'price', 'month_sin']) AS variable, unnest([row % 3, 1, col % 2, 0]) AS lag FROM ard) SELECT a.row, a.col, a.variable AS parent, b.variable AS child FROM v a JOIN v b ON a.row = b.row AND a.col = b.col AND a.variable <> b.variable WHERE a.lag < b.lag OR b.variable = 'month_sin'")
def prior_knowledge(s, d):
    pixels = ard(s, d).select("row", "col").distinct()
    lag = lambda name, value: F.struct(F.lit(name).alias("variable"), value.cast("int").alias("lag"))
    lags = F.array(lag("nl", F.col("row") % 3), lag("qty", F.lit(1)), lag("price", F.col("col") % 2), lag("month_sin", F.lit(0)))
    return G.forbidden_edges(pixels.select("row", "col", F.inline(lags)))


@query()
def discover_instant(s, d):
    return S.discover_instant(ard(s, d), VARS + ["disc"], least=40)


@query()
def discover_lagged(s, d):
    return S.discover_lagged(ard(s, d), VARS, most=2, criterion="bic", least=40)


@query()
def bootstrap_edges(s, d):
    return S.bootstrap_edges(ard(s, d), VARS, 200, least=40)


PROB = EDGES + ", prob AS (SELECT row, col, parent, child, avg((abs(weight) > 0.02)::INT) AS probability FROM edges WHERE replicate > 0 GROUP BY ALL)"
CONSENSUS = PROB + ", cons AS (SELECT row, col, parent, child, weight, probability FROM edges JOIN prob USING (row, col, parent, child) WHERE replicate = 0 AND probability >= 0.5 AND abs(weight) >= 0.03)"


def _consensus(s, d):
    return G.consensus_edges(edges(s, d), 0.5, 0.03, 0.02)


@query(with_sql(PROB) + f"SELECT row, col, parent, child, {q6('probability')} AS probability FROM prob")
def edge_probability(s, d):
    return rounded(G.edge_probability(edges(s, d), 0.02), "probability")


@query(with_sql(CONSENSUS) + f"SELECT row, col, parent, child, {q6('weight')} AS weight, {q6('probability')} AS probability FROM cons")
def consensus_edges(s, d):
    return rounded(_consensus(s, d).select("row", "col", "parent", "child", "weight", "probability"), "weight", "probability")


@query(with_sql(CONSENSUS) + f"SELECT row, col, parent || ' -> ' || child AS edge, {q6('weight')} AS weight FROM cons WHERE weight <> 0")
def edge_list(s, d):
    return rounded(_consensus(s, d).where("weight <> 0").select("row", "col", F.concat_ws(" -> ", "parent", "child").alias("edge"), "weight"), "weight")


SHARES = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885]


@query(
    with_sql(ARD)
    + f""", u AS (SELECT r AS rep, qty, price, tax, ('0x' || substr(md5(concat_ws('|', r, row, col, year, month)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM ard, generate_series(1, 2000) g(r)),
w AS (SELECT *, {' + '.join(f'(u >= {x})::INT' for x in SHARES)} AS k FROM u), x AS (SELECT rep, qty, price, tax FROM w, generate_series(1, 7) g(i) WHERE i <= k),
c AS (SELECT rep, corr(qty, price) AS qp, corr(qty, tax) AS qt, corr(price, tax) AS pt FROM x GROUP BY rep), l AS (SELECT 'qty' AS a, 'price' AS b, qp AS r FROM c UNION ALL SELECT 'qty', 'tax', qt FROM c UNION ALL SELECT 'price', 'tax', pt FROM c)
SELECT a, b, CASE WHEN abs(r) >= 0.1 THEN 'o-o' ELSE 'none' END AS endpoint, count(*) AS n FROM l GROUP BY ALL"""
)
def pooled_discovery(s, d):
    return G.pooled_discovery(ard(s, d), ["qty", "price", "tax"], 2000)


SIGNATURE = CONSENSUS + ", sig AS (SELECT row, col, sha1(string_agg(parent || '->' || child || CASE WHEN weight > 0 THEN '+' ELSE '-' END, ';' ORDER BY parent || '->' || child || CASE WHEN weight > 0 THEN '+' ELSE '-' END)) AS signature, count(*) AS n_edges FROM cons GROUP BY row, col)"


@query(with_sql(SIGNATURE) + "SELECT row, col, signature, n_edges FROM sig")
def graph_signature(s, d):
    return G.graph_signature(_consensus(s, d), "signed")


@query(with_sql(SIGNATURE) + ", g AS (SELECT signature, n_edges, count(*) AS n_pixels, CAST(row_number() OVER (ORDER BY count(*) DESC, n_edges, signature) - 1 AS INTEGER) AS group_id FROM sig GROUP BY signature, n_edges) SELECT row, col, group_id, n_pixels, n_edges FROM sig JOIN g USING (signature, n_edges)")
def graph_groups(s, d):
    return G.graph_groups(G.graph_signature(_consensus(s, d), "signed"))


TOTAL = EDGES + """, total AS (SELECT row, col, replicate, parent, child, weight AS effect FROM edges UNION ALL
  SELECT a.row, a.col, a.replicate, a.parent, b.child, a.weight * b.weight FROM edges a JOIN edges b ON a.row = b.row AND a.col = b.col AND a.replicate = b.replicate AND a.child = b.parent)"""


@query(
    with_sql(PROB, TOTAL.removeprefix(EDGES).lstrip(", "))
    + f"""SELECT row, col, {q6("max(weight) FILTER (parent = 'nl' AND child = 'qty')")} AS raw_nl_qty, {q6("max(weight) FILTER (parent = 'qty' AND child = 'price')")} AS raw_qty_price,
  {q6("max(probability) FILTER (parent = 'nl')")} AS p_nl_qty, {q6("max(te)")} AS te_nl_price, count(*) AS n_edges, {q6('sum(abs(weight))')} AS sum_abs
FROM edges JOIN prob USING (row, col, parent, child) JOIN (SELECT row, col, effect AS te FROM total WHERE replicate = 0 AND parent = 'nl' AND child = 'price') USING (row, col) WHERE replicate = 0 GROUP BY row, col"""
)
def graph_features(s, d):
    e = edges(s, d)
    t = E.total_effects(e, 3).where("replicate = 0")
    f = G.graph_features(e, G.edge_probability(e, 0.02), t, [("nl", "qty"), ("qty", "price"), ("nl", "price")])
    names = ["raw_nl_qty", "raw_qty_price", "p_nl_qty", "te_nl_price", "sum_abs"]
    return rounded(f.select("row", "col", *names[:4], "n_edges", "sum_abs"), *names)


@query(with_sql(EDGES) + f", w AS (SELECT row, col, max(weight) FILTER (parent = 'nl') AS a, max(weight) FILTER (parent = 'qty') AS b FROM edges WHERE replicate = 0 GROUP BY ALL) SELECT row, col, {q6('(a - avg(a) OVER ()) / stddev_pop(a) OVER ()')} AS nl_qty, {q6('(b - avg(b) OVER ()) / stddev_pop(b) OVER ()')} AS qty_price FROM w")
def graph_vectorize(s, d):
    return rounded(G.graph_vectorize(edges(s, d), [("nl", "qty"), ("qty", "price")]), "nl_qty", "qty_price")


# --- effects

CONTRAST = """contrast AS (SELECT row, col, v AS variable, quantile_cont(x, 0.1) AS q_low, quantile_cont(x, 0.9) AS q_high, quantile_cont(x, 0.9) - quantile_cont(x, 0.1) AS delta FROM (SELECT row, col, v, CASE v WHEN 'nl' THEN nl WHEN 'qty' THEN qty ELSE price END AS x FROM ard, (VALUES ('nl'), ('qty'), ('price')) t(v)) GROUP BY ALL)"""


def _total(s, d):
    return E.total_effects(edges(s, d), 3)


def _contrast(s, d):
    return E.quantile_contrast(ard(s, d), VARS, 0.1, 0.9)


@query(with_sql(EDGES) + f"SELECT row, col, parent AS source, {q6('avg(weight)')} AS effect FROM edges WHERE replicate > 0 AND child = 'price' GROUP BY ALL")
def direct_effects(s, d):
    return rounded(E.direct_effects(edges(s, d), "price", "mean"), "effect")


@query(with_sql(TOTAL) + f"SELECT row, col, replicate, parent, child, {q6('effect')} AS effect FROM total")
def total_effects(s, d):
    return rounded(_total(s, d).select("row", "col", "replicate", "parent", "child", "effect"), "effect")


@query(with_sql(ARD, CONTRAST) + f"SELECT row, col, variable, {q6('q_low')} AS q_low, {q6('q_high')} AS q_high, {q6('delta')} AS delta FROM contrast")
def quantile_contrast(s, d):
    return rounded(_contrast(s, d), "q_low", "q_high", "delta")


SCALED = TOTAL + ", " + CONTRAST + ", scaled AS (SELECT t.row, t.col, t.replicate, t.parent AS source, t.effect, t.effect * a.delta / b.delta AS scaled FROM total t JOIN contrast a ON a.row = t.row AND a.col = t.col AND a.variable = t.parent JOIN contrast b ON b.row = t.row AND b.col = t.col AND b.variable = 'price' WHERE t.child = 'price')"


def _scaled(s, d):
    t = _total(s, d).where("child = 'price'").withColumnRenamed("parent", "source").drop("child")
    return E.scaled_effects(t, _contrast(s, d), "price")


@query(with_sql(SCALED) + f"SELECT row, col, source, {q6('effect')} AS effect, {q6('scaled')} AS scaled FROM scaled WHERE replicate = 0")
def scaled_effects(s, d):
    return rounded(_scaled(s, d).where("replicate = 0").select("row", "col", "source", "effect", "scaled"), "effect", "scaled")


def _boot(value: str) -> str:
    return f"count(*) AS boot_n, {q6(f'avg({value})')} AS boot_mean, {q6(f'median({value})')} AS boot_median, {q6(f'stddev_samp({value})')} AS boot_sd, {q6(f'quantile_cont({value}, 0.025)')} AS ci_low, {q6(f'quantile_cont({value}, 0.975)')} AS ci_high, {q6(f'quantile_cont({value}, 0.975) - quantile_cont({value}, 0.025)')} AS ci_width, {q6(f'avg(({value} > 0)::INT)')} AS p_positive, {q6(f'avg(({value} < 0)::INT)')} AS p_negative, quantile_cont({value}, 0.025) > 0 OR quantile_cont({value}, 0.975) < 0 AS excludes_zero"


BOOT = ["boot_mean", "boot_median", "boot_sd", "ci_low", "ci_high", "ci_width", "p_positive", "p_negative"]


@query(with_sql(EDGES) + f"SELECT row, col, parent, child, {_boot('weight')} FROM edges WHERE replicate > 0 GROUP BY row, col, parent, child")
def bootstrap_summary(s, d):
    return rounded(E.bootstrap_summary(edges(s, d), ["row", "col", "parent", "child"], "weight"), *BOOT)


@query(with_sql(SCALED) + f"SELECT row, col, source, {q6('p.effect')} AS effect, {q6('p.scaled')} AS scaled, b.* EXCLUDE (row, col, source) FROM (SELECT * FROM scaled WHERE replicate = 0) p JOIN (SELECT row, col, source, {_boot('effect')} FROM scaled WHERE replicate > 0 GROUP BY row, col, source) b USING (row, col, source)")
def effect_table(s, d):
    return rounded(E.effect_table(edges(s, d), ard(s, d), ["nl", "qty"], "price", VARS), "effect", "scaled", *BOOT)


@query(with_sql(EDGES) + f"SELECT a.row, a.col, a.replicate, 'nl->qty->price' AS path, CAST(3 AS INTEGER) AS n_nodes, {q6('a.weight * b.weight')} AS product, CAST(1 AS INTEGER) AS rank FROM edges a JOIN edges b USING (row, col, replicate) WHERE a.parent = 'nl' AND b.child = 'price' AND a.weight <> 0 AND b.weight <> 0")
def causal_paths(s, d):
    return rounded(E.causal_paths(edges(s, d), "nl", "price", 2, 3), "product")


@query(with_sql(EDGES) + f", v AS (SELECT a.row, a.col, a.replicate, a.weight * b.weight AS v FROM edges a JOIN edges b USING (row, col, replicate) WHERE a.parent = 'nl' AND b.child = 'price') SELECT row, col, 'nl->qty->price' AS path, {q6('p.v')} AS product, b.* EXCLUDE (row, col) FROM (SELECT row, col, v FROM v WHERE replicate = 0 AND v <> 0) p JOIN (SELECT row, col, {_boot('v')} FROM v WHERE replicate > 0 GROUP BY row, col) b USING (row, col)")
def path_bootstrap(s, d):
    return rounded(E.path_bootstrap(edges(s, d), "nl", "price", 2, 3), "product", *BOOT)


WIN = SCALED + """, win AS (SELECT row, col, replicate, CASE WHEN abs(n) >= abs(q) THEN 'nl' ELSE 'qty' END AS driver FROM (SELECT row, col, replicate, max(scaled) FILTER (source = 'nl') AS n, max(scaled) FILTER (source = 'qty') AS q FROM scaled GROUP BY ALL) WHERE n IS NOT NULL AND q IS NOT NULL)"""


@query(with_sql(WIN) + f", c AS (SELECT row, col, driver, count(*) AS k FROM win WHERE replicate > 0 GROUP BY ALL), m AS (SELECT row, col, arg_max(driver, k * 10 - CASE driver WHEN 'nl' THEN 1 ELSE 2 END) AS mode_driver, sum(k) AS n FROM c GROUP BY ALL) SELECT row, col, p.driver, {q6('coalesce(c.k, 0) / m.n')} AS support, mode_driver FROM (SELECT * FROM win WHERE replicate = 0) p JOIN m USING (row, col) LEFT JOIN c USING (row, col, driver)")
def dominant_driver(s, d):
    t = _scaled(s, d).select("row", "col", "replicate", "source", F.col("scaled").alias("effect"))
    return rounded(E.dominant_driver(t, ["nl", "qty"]), "support")


def _two_sql(least: float, ratio: float) -> str:
    big, small = "greatest(abs(effect_a), abs(effect_b))", "least(abs(effect_a), abs(effect_b))"
    return f"CASE WHEN effect_a IS NULL OR effect_b IS NULL THEN NULL WHEN {big} < {least} THEN 'neither' WHEN {small} >= {least} AND {small} >= {ratio} * {big} THEN 'roughly_equal' WHEN abs(effect_a) >= abs(effect_b) THEN 'source_a' ELSE 'source_b' END"


PAIR = SCALED + ", pair AS (SELECT row, col, replicate, max(scaled) FILTER (source = 'nl') AS effect_a, max(scaled) FILTER (source = 'qty') AS effect_b FROM scaled GROUP BY ALL)"
KINDS = ["neither", "source_a", "source_b", "roughly_equal"]


def _two(s, d):
    t = _scaled(s, d).select("row", "col", "replicate", "source", F.col("scaled").alias("effect"))
    return E.two_source_class(t, "nl", "qty", 0.1, 0.5)


@query(with_sql(PAIR) + f", k AS (SELECT *, {_two_sql(0.1, 0.5)} AS klass FROM pair) SELECT row, col, {q6('p.effect_a')} AS effect_a, {q6('p.effect_b')} AS effect_b, p.klass, b.* EXCLUDE (row, col) FROM (SELECT * FROM k WHERE replicate = 0) p JOIN (SELECT row, col, {', '.join(f'{q6(f'avg((klass = {chr(39)}{n}{chr(39)})::INT)')} AS p_{n}' for n in KINDS)} FROM k WHERE replicate > 0 GROUP BY row, col) b USING (row, col)")
def two_source_class(s, d):
    return rounded(_two(s, d), "effect_a", "effect_b", *[f"p_{n}" for n in KINDS])


@query(with_sql(PAIR) + f"SELECT row, col, {_two_sql(0.3, 0.8)} AS klass FROM pair WHERE replicate = 0")
def two_source_reclassify(s, d):
    stored = _two(s, d).select("row", "col", "effect_a", "effect_b", F.lit("run1").alias("run"))
    return E.two_source_reclassify(stored, "run1", 0.3, 0.8).select("row", "col", "klass")


@query(with_sql(SCALED) + f"SELECT row, col, replicate, CASE source WHEN 'nl' THEN 'demand' ELSE 'trade' END AS process, {q6('sqrt(avg(scaled * scaled))')} AS score FROM scaled GROUP BY ALL")
def group_score(s, d):
    return rounded(E.group_score(_scaled(s, d), {"demand": ["nl"], "trade": ["qty"]}, "rms_abs").select("row", "col", "replicate", "process", "score"), "score")


def _process_sql(least: float, ratio: float) -> str:
    return f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(a, b) <= {least} THEN 'weak' WHEN least(a, b) >= {ratio} * greatest(a, b) THEN 'mixed' WHEN a > b THEN 'A' ELSE 'B' END"


@query(with_sql(SCALED) + f""", p AS (SELECT row, col, replicate, max(abs(scaled)) FILTER (source = 'nl') AS a, max(abs(scaled)) FILTER (source = 'qty') AS b FROM scaled GROUP BY ALL), k AS (SELECT *, {_process_sql(0.05, 0.8)} AS raw FROM p), z AS (SELECT * FROM k WHERE replicate = 0),
u AS (SELECT z.row, z.col, avg((k.raw = z.raw)::INT) AS support FROM z JOIN k ON k.row = z.row AND k.col = z.col WHERE k.replicate > 0 AND k.raw IS NOT NULL GROUP BY z.row, z.col)
SELECT row, col, {q6('a')} AS score_a, {q6('b')} AS score_b, raw, {q6('support')} AS support, CASE WHEN coalesce(support, 0) < 0.6 THEN 'uncertain' ELSE raw END AS klass FROM z LEFT JOIN u USING (row, col)""")
def process_dominance(s, d):
    scores = E.group_score(_scaled(s, d), {"demand": ["nl"], "trade": ["qty"]}, "max_abs")
    return rounded(E.process_dominance(scores, "demand", "trade", 0.05, 0.8, 0.6), "score_a", "score_b", "support")


@query(with_sql(EDGES) + f""", q AS (SELECT a.row, a.col, a.replicate, abs(a.weight) AS up, abs(b.weight) AS down, CASE WHEN abs(a.weight) >= 0.1 THEN 'high' ELSE 'low' END || '-' || CASE WHEN abs(b.weight) >= 1.5 THEN 'high' ELSE 'low' END AS quadrant FROM edges a JOIN edges b USING (row, col, replicate) WHERE a.parent = 'nl' AND b.parent = 'qty'), z AS (SELECT * FROM q WHERE replicate = 0),
u AS (SELECT z.row, z.col, avg((q.quadrant = z.quadrant)::INT) AS support FROM z JOIN q ON q.row = z.row AND q.col = z.col WHERE q.replicate > 0 GROUP BY z.row, z.col)
SELECT row, col, {q6('up')} AS up, {q6('down')} AS down, quadrant, {q6('support')} AS support FROM z LEFT JOIN u USING (row, col)""")
def coupling_sensitivity(s, d):
    e = edges(s, d)
    part = lambda p: e.where(F.col("parent") == p).select("row", "col", "replicate", F.abs("weight").alias("score"))
    return rounded(E.coupling_sensitivity(part("nl"), part("qty"), 0.1, 1.5), "up", "down", "support")


@query(with_sql(EDGES, CONTRAST) + f"SELECT a.row, a.col, a.replicate, {q6('abs(a.weight * b.weight * s.delta / t.delta)')} AS score FROM edges a JOIN edges b USING (row, col, replicate) JOIN contrast s ON s.row = a.row AND s.col = a.col AND s.variable = 'nl' JOIN contrast t ON t.row = a.row AND t.col = a.col AND t.variable = 'price' WHERE a.parent = 'nl' AND b.parent = 'qty'")
def mediated_path_score(s, d):
    return rounded(E.mediated_path_score(edges(s, d), ["nl"], ["qty"], "price", _contrast(s, d)), "score")


@query(with_sql(ARD) + f", b AS (SELECT row, col, count(*) AS n, (covar_pop(price, qty) * var_pop(nl) - covar_pop(price, nl) * covar_pop(qty, nl)) / (var_pop(qty) * var_pop(nl) - covar_pop(qty, nl) * covar_pop(qty, nl)) AS c, quantile_cont(qty, 0.25) AS lo, quantile_cont(qty, 0.75) AS hi FROM ard GROUP BY row, col) SELECT row, col, n, {q6('c')} AS coefficient, {q6('lo')} AS control, {q6('hi')} AS treated, {q6('c * (hi - lo)')} AS effect FROM b")
def backdoor_effect(s, d):
    return rounded(E.backdoor_effect(ard(s, d), "qty", "price", ["nl"], 0.25, 0.75), "coefficient", "control", "treated", "effect")


@query(with_sql(EDGES) + f", c AS (SELECT row, col, replicate, (covar_pop(price, qty) * var_pop(nl) - covar_pop(price, nl) * covar_pop(qty, nl)) / (var_pop(qty) * var_pop(nl) - covar_pop(qty, nl) * covar_pop(qty, nl)) AS c FROM sampled WHERE replicate > 0 GROUP BY ALL) SELECT row, col, {_boot('c')} FROM c GROUP BY row, col")
def backdoor_bootstrap(s, d):
    return rounded(E.backdoor_bootstrap(ard(s, d), "qty", "price", ["nl"], REPLICATES), *BOOT)


# --- interventions


@query(with_sql(ARD) + f", m AS (SELECT row, col, month, avg(qty) AS c FROM ard GROUP BY ALL) SELECT row, col, year, month, qty AS baseline, {q6('c')} AS value FROM ard JOIN m USING (row, col, month)")
def value_spec(s, d):
    return rounded(I.value_spec(ard(s, d), "qty", I.Value("climatology_mean")), "value")


@query(with_sql(TOTAL) + f", v AS (SELECT row, col, year, month, nl AS baseline, nl + stddev_samp(nl) OVER (PARTITION BY row, col) AS value FROM ard) SELECT row, col, year, month, child AS target, {q6('effect * (value - baseline)')} AS delta FROM v JOIN total USING (row, col) WHERE parent = 'nl' AND replicate = 0")
def hard_intervention(s, d):
    v = I.value_spec(ard(s, d), "nl", I.Value("zdelta", 1.0))
    out = I.hard_intervention(edges(s, d).where("replicate = 0"), v, "nl", ["qty", "price"], 3)
    return rounded(out.select("row", "col", "year", "month", "target", "delta"), "delta")


@query(with_sql(EDGES) + f", m AS (SELECT row, col, avg(nl) AS m FROM ard GROUP BY ALL) SELECT a.row, a.col, a.replicate, year, month, 'price' AS target, {q6('(a.weight * 2 - a.weight) * (p.nl - m) * b.weight')} AS delta FROM edges a JOIN edges b USING (row, col, replicate) JOIN m ON m.row = a.row AND m.col = a.col JOIN ard p ON p.row = a.row AND p.col = a.col WHERE a.parent = 'nl' AND b.parent = 'qty' AND a.weight <> 0")
def mechanism_change(s, d):
    return rounded(I.mechanism_change(edges(s, d), ard(s, d), (I.Mechanism("nl", "qty", "scale", 2.0),), ["price"], 3), "delta")


@query(with_sql(EDGES) + f", m AS (SELECT row, col, avg(qty) AS baseline FROM ard GROUP BY ALL) SELECT row, col, replicate, {q6('baseline + 1 / weight')} AS required FROM edges JOIN m USING (row, col) WHERE parent = 'qty' AND abs(weight) > 1e-12 AND replicate = 0")
def goal_seek(s, d):
    return rounded(I.goal_seek(edges(s, d).where("replicate = 0"), ard(s, d), "qty", "price", 1.0, 3).select("row", "col", "replicate", "required"), "required")


SCENARIOS = [
    I.Scenario("more lines", (I.Hard("nl", I.Value("delta", 5.0)),)),
    I.Scenario("half quantity", (I.Hard("qty", I.Value("scale", 0.5)),), (I.Mechanism("qty", "price", "scale", 2.0),)),
    I.Scenario("steep price", (), (I.Mechanism("qty", "price", "scale", 2.0),)),
    I.Scenario("broken", (I.Hard("rain", I.Value("mean")),)),
]
# events of the scenarios; edges run nl -> qty -> price
EVENTS = """, m AS (SELECT row, col, avg(qty) AS m FROM ard GROUP BY ALL), g AS (SELECT DISTINCT row, col, replicate FROM edges),
ev AS (SELECT t.row, t.col, t.replicate, year, month, 'more lines' AS scenario, t.child AS target, 5 * t.effect AS effect FROM total t JOIN ard a ON a.row = t.row AND a.col = t.col WHERE t.parent = 'nl'
  UNION ALL SELECT g.row, g.col, replicate, year, month, 'half quantity', 'qty', -qty / 2 FROM g JOIN ard a ON a.row = g.row AND a.col = g.col
  UNION ALL SELECT e.row, e.col, replicate, year, month, 'half quantity', 'price', weight * (qty - m) + 2 * weight * (-qty / 2) FROM edges e JOIN ard a ON a.row = e.row AND a.col = e.col JOIN m ON m.row = e.row AND m.col = e.col WHERE e.parent = 'qty' AND weight <> 0
  UNION ALL SELECT e.row, e.col, replicate, year, month, 'steep price', 'price', weight * (qty - m) FROM edges e JOIN ard a ON a.row = e.row AND a.col = e.col JOIN m ON m.row = e.row AND m.col = e.col WHERE e.parent = 'qty' AND weight <> 0)"""
SUMMARY = f"{q6('max(effect) FILTER (replicate = 0)')} AS effect, {q6('avg(effect) FILTER (replicate > 0)')} AS boot_mean, {q6('quantile_cont(effect, 0.025) FILTER (replicate > 0)')} AS ci_low, {q6('quantile_cont(effect, 0.975) FILTER (replicate > 0)')} AS ci_high, NULL::VARCHAR AS error"
BROKEN = "'broken', NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 'unknown variables: rain' FROM ard"


@query(with_sql(TOTAL) + EVENTS + f", u AS (SELECT row, col, replicate, scenario, target, quantile_cont(effect, 0.5) AS effect FROM ev GROUP BY ALL) SELECT row, col, scenario, target, {SUMMARY} FROM u GROUP BY row, col, scenario, target UNION ALL SELECT DISTINCT row, col, {BROKEN}")
def scenario_table(s, d):
    return rounded(I.scenario_table(edges(s, d), ard(s, d), SCENARIOS, ["qty", "price"], VARS, "median"), "effect", "boot_mean", "ci_low", "ci_high")


@query(with_sql(TOTAL) + EVENTS + f" SELECT row, col, year, month, scenario, target, {SUMMARY} FROM ev GROUP BY row, col, year, month, scenario, target UNION ALL SELECT DISTINCT row, col, NULL::INTEGER, NULL::INTEGER, {BROKEN}")
def scenario_table_events(s, d):
    return rounded(I.scenario_table(edges(s, d), ard(s, d), SCENARIOS, ["qty", "price"], VARS, "none"), "effect", "boot_mean", "ci_low", "ci_high")


@query(with_sql(TOTAL) + f"SELECT row, col, 'hard' AS kind, 'nl' AS name, {q6('5 * effect')} AS contribution FROM total WHERE replicate = 0 AND parent = 'nl' AND child = 'price' UNION ALL SELECT row, col, 'path', 'nl->qty->price', {q6('5 * effect')} FROM total WHERE replicate = 0 AND parent = 'nl' AND child = 'price' AND effect <> 0")
def intervention_components(s, d):
    return rounded(I.intervention_components(edges(s, d), ard(s, d), SCENARIOS[0], "price", VARS, 3), "contribution")


# --- lagged graphs: the instantaneous edge qty -> price, and the lag-1 coefficients of both

LAGGED = """pairs AS (SELECT row, col, qty, price, lag(qty) OVER w AS lq, lag(price) OVER w AS lp FROM ard WINDOW w AS (PARTITION BY row, col ORDER BY year, month)),
lw AS (SELECT row, col, regr_slope(price, qty) AS b, regr_slope(qty, lq) AS q, regr_slope(price, lp) AS p FROM pairs WHERE lq IS NOT NULL GROUP BY row, col),
le AS (SELECT row, col, CAST(0 AS INTEGER) AS replicate, CAST(0 AS INTEGER) AS lag, 'qty' AS parent, 'price' AS child, b AS weight FROM lw UNION ALL SELECT row, col, 0, 1, 'qty', 'qty', q FROM lw UNION ALL SELECT row, col, 0, 1, 'price', 'price', p FROM lw)"""


def lagged_edges(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("row", "col").orderBy("year", "month")
    p = ard(s, d).select("row", "col", "qty", "price", F.lag("qty").over(w).alias("lq"), F.lag("price").over(w).alias("lp")).where("lq is not null")
    g = p.groupBy("row", "col").agg(F.regr_slope("price", "qty").alias("b"), F.regr_slope("qty", "lq").alias("q"), F.regr_slope("price", "lp").alias("p"))
    e = lambda lag, a, b, c: F.struct(F.lit(lag).alias("lag"), F.lit(a).alias("parent"), F.lit(b).alias("child"), F.col(c).alias("weight"))
    return g.select("row", "col", F.lit(0).alias("replicate"), F.inline(F.array(e(0, "qty", "price", "b"), e(1, "qty", "qty", "q"), e(1, "price", "price", "p"))))


@query(with_sql(ARD, LAGGED) + f"SELECT row, col, lag, parent, child, {q6('weight')} AS weight FROM le WHERE lag = 1 UNION ALL SELECT row, col, CAST(1 AS INTEGER), 'qty', 'price', {q6('q * b')} FROM lw")
def reduced_form(s, d):
    return rounded(L.reduced_form(lagged_edges(s, d), 2).select("row", "col", "lag", "parent", "child", "weight"), "weight")


@query(with_sql(ARD, LAGGED) + f"SELECT row, col, {q6('greatest(abs(q), abs(p))')} AS radius FROM lw")
def stability_radius(s, d):
    return rounded(L.stability_radius(lagged_edges(s, d), ["qty", "price"]).select("row", "col", "radius"), "radius")


@query(
    with_sql(ARD, LAGGED)
    + f""", th AS (SELECT row, col, 'qty' AS source, 'qty' AS target, h AS horizon, CASE h WHEN 0 THEN 1.0 WHEN 1 THEN q ELSE q * q END AS e FROM lw, generate_series(0, 2) g(h) UNION ALL SELECT row, col, 'price', 'price', h, CASE h WHEN 0 THEN 1.0 WHEN 1 THEN p ELSE p * p END FROM lw, generate_series(0, 2) g(h)
  UNION ALL SELECT row, col, 'qty', 'price', h, CASE h WHEN 0 THEN b WHEN 1 THEN q * b + p * b ELSE q * b * q + p * (q * b + p * b) END FROM lw, generate_series(0, 2) g(h))
SELECT row, col, source, target, CAST(horizon AS INTEGER) AS horizon, {q6('e')} AS effect, {q6('sum(e) OVER (PARTITION BY row, col, source, target ORDER BY horizon)')} AS cumulative FROM th"""
)
def dynamic_effects(s, d):
    return rounded(L.dynamic_effects(lagged_edges(s, d), ["qty", "price"], 2).select("row", "col", "source", "target", "horizon", "effect", "cumulative"), "effect", "cumulative")


@query(with_sql(ARD, LAGGED) + f", z AS (SELECT row, col, year, month, qty, price, lag(qty) OVER w AS lq, lag(price) OVER w AS lp FROM ard WINDOW w AS (PARTITION BY row, col ORDER BY year, month)) SELECT row, col, year, month, 'qty' AS variable, {q6('qty - q * lq')} AS innovation FROM z JOIN lw USING (row, col) UNION ALL SELECT row, col, year, month, 'price', {q6('price - b * qty - p * lp')} FROM z JOIN lw USING (row, col)")
def structural_innovations(s, d):
    return rounded(L.structural_innovations(ard(s, d), lagged_edges(s, d), ["qty", "price"]), "innovation")


@query(with_sql(ARD, LAGGED) + f", h AS (SELECT row, col, 0 AS h, 'qty' AS v, 2.0::DOUBLE AS e FROM lw UNION ALL SELECT row, col, 0, 'price', 2 * b FROM lw UNION ALL SELECT row, col, 1, 'qty', 2 * q FROM lw UNION ALL SELECT row, col, 1, 'price', b * 2 * q + p * 2 * b FROM lw UNION ALL SELECT row, col, 2, 'qty', 2 * q * q FROM lw UNION ALL SELECT row, col, 2, 'price', b * 2 * q * q + p * (b * 2 * q + p * 2 * b) FROM lw) SELECT row, col, CAST(h AS INTEGER) AS horizon, v AS variable, {q6('e')} AS effect, {q6('sum(e) OVER (PARTITION BY row, col, v ORDER BY h)')} AS cumulative FROM h")
def var_intervention(s, d):
    out = L.var_intervention(lagged_edges(s, d), ["qty", "price"], "qty", 2.0, 1, 2)
    return rounded(out.select("row", "col", "horizon", "variable", "effect", "cumulative"), "effect", "cumulative")


# --- diagnostics


@query(with_sql(ARD) + f", c AS (SELECT row, col, count(*) AS n, CAST((stddev_pop(qty) <= 1e-8)::INT + (stddev_pop(price) <= 1e-8)::INT + (stddev_pop(tax) <= 1e-8)::INT AS INTEGER) AS near_constant, [abs(corr(qty, price)), abs(corr(qty, tax)), abs(corr(price, tax))] AS r FROM ard GROUP BY row, col) SELECT row, col, n, {q6('n / 3')} AS ratio, near_constant, {q6('list_max(r)')} AS max_corr, {q6('list_median(r)')} AS median_corr FROM c")
def data_diagnostics(s, d):
    return rounded(D.data_diagnostics(ard(s, d), ["qty", "price", "tax"]), "ratio", "max_corr", "median_corr")


def _moments(v: str) -> str:
    return f"SELECT row, col, '{v}' AS variable, count(*) AS n, avg(pow({v} - m, 3)) / pow(avg(pow({v} - m, 2)), 1.5) AS sk, avg(pow({v} - m, 4)) / pow(avg(pow({v} - m, 2)), 2) - 3 AS ku FROM (SELECT row, col, {v}, avg({v}) OVER (PARTITION BY row, col) AS m FROM ard) GROUP BY row, col"


@query(with_sql(ARD) + f", m AS ({_moments('qty')} UNION ALL {_moments('price')}) SELECT row, col, variable, n, {q6('sk')} AS skew, {q6('ku')} AS kurtosis, {q6('exp(-(n / 6 * (sk * sk + ku * ku / 4)) / 2)')} AS p, exp(-(n / 6 * (sk * sk + ku * ku / 4)) / 2) < 0.05 AS non_gaussian FROM m")
def residual_moments(s, d):
    return rounded(D.residual_moments(ard(s, d), ["qty", "price"]), "skew", "kurtosis", "p")


@query(with_sql(ARD) + f", c AS (SELECT row, col, [abs(corr(qty, price)), abs(corr(qty, tax)), abs(corr(price, tax))] AS r FROM ard GROUP BY row, col) SELECT row, col, {q6('list_max(r)')} AS most, {q6('list_median(r)')} AS median, CAST(len([x for x in r if x >= 0.1]) AS BIGINT) AS n_pairs FROM c")
def residual_dependence(s, d):
    return rounded(D.residual_dependence(ard(s, d), ["qty", "price", "tax"], 0.1), "most", "median")


@query(with_sql(ARD) + f", l AS (SELECT row, col, qty, price, lag(qty) OVER w AS lq, lag(price) OVER w AS lp FROM ard WINDOW w AS (PARTITION BY row, col ORDER BY year, month)) SELECT row, col, 'qty' AS variable, {q6('corr(qty, lq)')} AS lag1 FROM l GROUP BY row, col UNION ALL SELECT row, col, 'price', {q6('corr(price, lp)')} FROM l GROUP BY row, col")
def lag1_autocorr(s, d):
    return rounded(D.lag1_autocorr(ard(s, d), ["qty", "price"]), "lag1")


@query(
    with_sql(ARD)
    + f""", s AS (SELECT row, col, row_number() OVER (PARTITION BY row, col ORDER BY year, month) AS i, qty, price FROM ard), l AS (SELECT row, col, i, 'qty' AS v, qty AS x FROM s UNION ALL SELECT row, col, i, 'price', price FROM s)
SELECT a.row, a.col, a.v AS now, b.v AS past, CAST(g.k AS INTEGER) AS lag, {q6('corr(a.x, b.x)')} AS r FROM l a JOIN generate_series(1, 3) g(k) ON true JOIN l b ON a.row = b.row AND a.col = b.col AND b.i = a.i - g.k GROUP BY ALL"""
)
def crosslag(s, d):
    return rounded(D.crosslag(ard(s, d), ["qty", "price"], 3), "r")


@query(
    with_sql(ARD)
    + f""", s AS (SELECT row, col, row_number() OVER (PARTITION BY row, col ORDER BY year, month) AS i, count(*) OVER (PARTITION BY row, col) AS n, qty - avg(qty) OVER (PARTITION BY row, col) AS e FROM ard), c AS (SELECT row, col, max(n) AS n, sum(e * e) AS c0 FROM s GROUP BY ALL),
r AS (SELECT a.row, a.col, g.k, sum(a.e * b.e) AS ck FROM s a JOIN generate_series(1, 4) g(k) ON true JOIN s b ON a.row = b.row AND a.col = b.col AND b.i = a.i - g.k GROUP BY ALL)
SELECT row, col, CAST(n AS INTEGER) AS n, {q6('sum(n * n / (n - k) * (ck / c0) * (ck / c0))')} AS q, CAST(4 AS INTEGER) AS df FROM r JOIN c USING (row, col) GROUP BY row, col, n"""
)
def portmanteau(s, d):
    return rounded(D.portmanteau(ard(s, d), ["qty"], 4).select("row", "col", "n", "q", "df"), "q")


@query(with_sql(ARD) + f", z AS (SELECT row, col, year, month, qty - avg(qty) OVER (PARTITION BY row, col) AS e FROM ard), l AS (SELECT row, col, e, lag(e) OVER (PARTITION BY row, col ORDER BY year, month) AS le FROM z) SELECT row, col, CAST(1 AS INTEGER) AS lag, 'qty' AS parent, 'qty' AS child, {q6('sum(e * le) / sum(le * le)')} AS weight FROM l WHERE le IS NOT NULL GROUP BY row, col")
def var_refit(s, d):
    return rounded(S.var_refit(ard(s, d), ["qty"], 1), "weight")


@query()
def whiteness_bootstrap(s, d):
    return S.whiteness_bootstrap(ard(s, d), ["qty", "price"], lags=4, fitted=1, samples=499, pixels=500)


@query(with_sql(PROB) + f", h AS (SELECT *, CASE WHEN probability <= 0 OR probability >= 1 THEN 0 ELSE -probability * log2(probability) - (1 - probability) * log2(1 - probability) END AS h FROM prob) SELECT row, col, count(*) AS n_edges, {q6('avg(h)')} AS mean_entropy, {q6('max(h)')} AS max_entropy, count(*) FILTER (abs(probability - 0.5) <= 0.2) AS near_threshold, CAST(0 AS BIGINT) AS conflicts FROM h GROUP BY row, col")
def edge_stability(s, d):
    return rounded(D.edge_stability(G.edge_probability(edges(s, d), 0.02), 0.2, 0.5), "mean_entropy", "max_entropy")


@query(with_sql(ARD) + "SELECT row, col, coalesce(abs(corr(qty, price)) > 0.6, false) OR coalesce(abs(corr(qty, tax)) > 0.2, false) OR count(*) < 82 AS flagged FROM ard GROUP BY row, col")
def assumption_flag(s, d):
    g = ard(s, d).groupBy("row", "col").agg(F.abs(C.safe_corr("qty", "price")).alias("a"), F.abs(C.safe_corr("qty", "tax")).alias("b"), F.count("*").alias("n"))
    return g.select("row", "col", D.assumption_flag([F.col("a") > 0.6, F.col("b") > 0.2], F.col("n") < 82).alias("flagged"))


# --- land cover, classes, clusters


@query(with_sql(ARD) + "SELECT DISTINCT n.row, n.col, CAST(i * 3 + j AS INTEGER) AS point, n.col + 0.5::DOUBLE - 0.5 + (j + 0.5) * 1.0 / 3 AS px, 4.5::DOUBLE - n.row - 0.5 + (i + 0.5) * 1.0 / 3 AS py FROM nat n, generate_series(0, 2) a(i), generate_series(0, 2) b(j)".replace("n.col + 0.5::DOUBLE - 0.5 + (j + 0.5) * 1.0 / 3", q6("n.col + (j + 0.5::DOUBLE) / 3")).replace("4.5::DOUBLE - n.row - 0.5 + (i + 0.5) * 1.0 / 3", q6("4::DOUBLE - n.row + (i + 0.5::DOUBLE) / 3")))
def footprint_samples(s, d):
    return rounded(N.footprint_samples(_cells(s, d), 3, 1.0), "px", "py")


def _cells(s, d):
    from terracause.plans.fixtures import pixels

    return pixels(s, d).select("row", "col", (F.col("col") + 0.5).alias("x"), (F.lit(4.5) - F.col("row")).alias("y")).distinct()


TILES = "tiles AS (SELECT 't' || i || '_' || j || '_' || k AS tile, i AS tile_x, j AS tile_y, CAST((i * 3 + j * 2 + k + (SELECT count(*) FROM region)) % 4 AS INTEGER) AS code FROM generate_series(0, 7) a(i), generate_series(0, 7) b(j), generate_series(0, 1) c(k) WHERE (i + j) % 5 <> 0)"


@query(
    with_sql(ARD, TILES)
    + f""", pt AS (SELECT DISTINCT n.row, n.col, i * 4 + j AS point, floor((n.col + (j + 0.5::DOUBLE) / 4) / 0.7) AS tile_x, floor((4::DOUBLE - n.row + (i + 0.5::DOUBLE) / 4) / 0.7) AS tile_y FROM nat n, generate_series(0, 3) a(i), generate_series(0, 3) b(j)),
f AS (SELECT tile_x, tile_y, arg_min(code, tile) AS code FROM tiles GROUP BY ALL), k AS (SELECT row, col, code, CASE WHEN code IN (1, 2, 3) THEN code END AS good FROM pt LEFT JOIN f USING (tile_x, tile_y)),
c AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, good) AS r FROM (SELECT row, col, good, count(*) AS n FROM k WHERE good IS NOT NULL GROUP BY ALL))
SELECT row, col, code, {q6('n / v')} AS purity, {q6('coalesce(v, 0) / p')} AS valid_fraction, {q6('t / p')} AS tile_fraction, p AS n_points FROM (SELECT row, col, count(*) AS p, count(code) AS t, nullif(count(good), 0) AS v FROM k GROUP BY ALL) LEFT JOIN (SELECT row, col, good AS code, n FROM c WHERE r = 1) USING (row, col)"""
)
def footprint_label(s, d):
    n = table(s, d, "region").agg(F.count("*").alias("n"))
    grid = s.range(8).select(F.col("id").cast("int").alias("tile_x")).crossJoin(s.range(8).select(F.col("id").cast("int").alias("tile_y"))).crossJoin(s.range(2).select(F.col("id").cast("int").alias("k")))
    tiles = grid.crossJoin(F.broadcast(n)).where("(tile_x + tile_y) % 5 <> 0").select(F.concat(F.lit("t"), "tile_x", F.lit("_"), "tile_y", F.lit("_"), "k").alias("tile"), "tile_x", "tile_y", ((F.col("tile_x") * 3 + F.col("tile_y") * 2 + F.col("k") + F.col("n")) % 4).cast("int").alias("code"))
    out = N.footprint_label(N.footprint_samples(_cells(s, d), 4, 1.0), tiles, 0.7, [1, 2, 3])
    return rounded(out, "purity", "valid_fraction", "tile_fraction")


def _classed(s, d):
    """Embeddings as samples: label as class, a place on a grid by id, and four components as features."""
    e = table(s, d, "embeddings")
    return e.select((F.floor(F.col("vec_id") / 20) % 20).cast("int").alias("row"), (F.col("vec_id") % 20).cast("int").alias("col"), F.col("label").cast("int").alias("label"), F.concat_ws("_", F.floor(F.col("vec_id") / 20) % 20 % 5, F.floor(F.col("vec_id") % 20 / 5)).alias("block"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(6)], "vec_id")


@query("WITH b AS (SELECT DISTINCT label, (vec_id // 20) % 20 % 5 || '_' || (vec_id % 20) // 5 AS block FROM embeddings) SELECT count(DISTINCT block) AS n_blocks, CAST(greatest(2, least(5, min(k))) AS INTEGER) AS n_folds, true AS whole FROM b, (SELECT min(c) AS k FROM (SELECT label, count(DISTINCT block) AS c FROM b GROUP BY label))")
def spatial_folds(s, d):
    f = N.spatial_folds(_classed(s, d), "label", "block", 5)
    return f.agg(F.countDistinct("block").alias("n_blocks"), F.countDistinct("fold").cast("int").alias("n_folds"), (F.count("*") == F.countDistinct("block")).alias("whole"))


@query()
def spatial_cv(s, d):
    c = _classed(s, d)
    return N.spatial_cv(c.join(N.spatial_folds(c, "label", "block", 2), "block"), [f"f{i}" for i in range(6)], "label", "fold")


@query(
    f"""WITH g AS (SELECT vec_id % 3 AS fold, label AS t, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS s FROM embeddings), t AS (SELECT fold, t AS k, count(*) AS t, count(*) FILTER (t = s) AS h FROM g GROUP BY ALL), s AS (SELECT fold, s AS k, count(*) AS s FROM g GROUP BY ALL),
j AS (SELECT fold, coalesce(t, 0) AS t, coalesce(h, 0) AS h, 2 * coalesce(h, 0) / nullif(coalesce(t, 0) + coalesce(s, 0), 0) AS f1, CASE WHEN t > 0 THEN h / t END AS recall FROM t FULL JOIN s USING (fold, k))
SELECT fold, sum(t)::BIGINT AS n, {q6('sum(h) / sum(t)')} AS accuracy, {q6('avg(recall)')} AS balanced_accuracy, {q6('avg(f1)')} AS macro_f1, {q6('sum(f1 * t) / sum(t)')} AS weighted_f1 FROM j GROUP BY fold"""
)
def confusion_metrics(s, d):
    e = table(s, d, "embeddings").select((F.col("vec_id") % 3).alias("fold"), F.col("label").alias("t"), F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("s"))
    return rounded(N.confusion_metrics(e, "t", "s", ["fold"]), "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


@query()
def feature_importance(s, d):
    return N.feature_importance(_classed(s, d), [f"f{i}" for i in range(6)], "label")


@query()
def graph_order(s, d):
    from terracause.operators.aggregates import similarity_rank

    v = G.graph_vectorize(edges(s, d, replicates=0), [("nl", "qty"), ("qty", "price")])
    return similarity_rank(N.graph_order(v, ["nl_qty", "qty_price"]), "score", ["row", "col"]).select("row", "col", "rank", "scaled")


@query()
def graph_cluster(s, d):
    v = G.graph_vectorize(edges(s, d, replicates=0), [("nl", "qty"), ("qty", "price")])
    out, score = N.graph_cluster(v, ["nl_qty", "qty_price"], 3)
    return out.select("row", "col", "cluster").withColumn("silhouette", F.lit(score))


@query(f"WITH c AS (SELECT label, i AS f, avg(embedding[i + 1]::DOUBLE) AS v FROM embeddings, generate_series(0, 5) g(i) GROUP BY ALL) SELECT a.label AS a, b.label AS b, {q6('sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v))')} AS cosine FROM c a JOIN c b USING (f) GROUP BY a.label, b.label")
def cluster_profile(s, d):
    return rounded(N.cluster_cosine(N.cluster_centroids(_classed(s, d), "label", [f"f{i}" for i in range(6)]), "label"), "cosine")


@query(with_sql(GAPPY) + "SELECT row, col, CASE WHEN count(*) >= 80 THEN count(*) END AS n, CASE WHEN count(*) < 80 THEN 'too short' END AS error FROM ard_gappy GROUP BY row, col")
def map_pixels(s, d):
    def count(g):
        import pandas as pd

        if len(g) < 80:
            raise ValueError("too short")
        return pd.DataFrame([(g["row"].iloc[0], g["col"].iloc[0], len(g))], columns=["row", "col", "n"])

    return S.map_pixels(ard_gappy(s, d).select("row", "col", "qty"), count, "row int, col int, n long")


