"""Queries over scans, catalogs, panel assembly, shifts and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracause.functions import columns as C
from terracause.operators import panel as P
from terracause.plans.fixtures import ARD, CATALOG, GAPPY, LABELS, NAME_MAP, VARIABLES, ard, ard_gappy, catalog, labels_px, lines, pixels, q6, table, with_sql
from terracause.sources import catalog as K
from terracause.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


KV = "row, col, year, month"
NAMES = ", ".join(f"({k!r}, {v!r})" for k, v in NAME_MAP.items())
MONTHS = (
    CATALOG
    + f""", names(variable_name, variable) AS (VALUES {NAMES}),
files AS (SELECT year, month, variable, max(file_name) AS file_name FROM (
  SELECT year, CAST(CASE WHEN frequency = 'yearly' THEN m ELSE month END AS INTEGER) AS month, variable, file_name FROM catalog JOIN names USING (variable_name), generate_series(1, 12) g(m)
  WHERE frequency = 'yearly' OR m = 1) GROUP BY ALL)"""
)
REQUIRED = ["high", "low", "medium", "other", "urgent"]
COMPLETE = MONTHS + f", complete AS (SELECT year, month FROM files WHERE variable IN ({', '.join(map(repr, REQUIRED))}) GROUP BY year, month HAVING count(DISTINCT variable) = {len(REQUIRED)})"


@query(with_sql(ARD) + f"SELECT {KV}, qty, price, nl FROM ard")
def panel_scan(s, d):
    return T.panel_scan(ard(s, d), P.KEYS + P.TIME + VARIABLES, P.KEYS + P.TIME + ["qty", "price", "nl"])


@query(with_sql(ARD) + f"SELECT {KV}, disc, tax FROM ard WHERE year >= 2000")
def table_replace(s, d):
    path = T.scratch(s, "results")
    T.table_replace(ard(s, d).where("year < 2000").select(*P.KEYS, *P.TIME, "disc", "tax"), path)
    return T.table_replace(ard(s, d).where("year >= 2000").select(*P.KEYS, *P.TIME, "disc", "tax"), path)


@query(with_sql(ARD, LABELS) + "SELECT row, col, code, klass, purity FROM labels_px")
def csv_exchange(s, d):
    return T.csv_exchange(labels_px(s, d).select("row", "col", "code", "klass", "purity"), T.scratch(s, "csv"))


@query(with_sql(ARD) + "SELECT row, col, max(x) AS x, max(y) AS y, count(*) AS n_months, max(qty) AS qty, min(price) AS price FROM ard GROUP BY row, col")
def graph_rows_scan(s, d):
    g = ard(s, d).groupBy("row", "col").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.count("*").alias("n_months"), F.max("qty").alias("qty"), F.min("price").alias("price"))
    return T.panel_scan(g, ["row", "col", "x", "y", "n_months", "qty", "price"]).orderBy("row", "col")


EFFECT_ROWS = """effects AS (SELECT row, col, v AS source, 'nl' AS target, CAST(month AS INTEGER) AS horizon, CASE v WHEN 'qty' THEN qty WHEN 'disc' THEN disc ELSE tax END AS effect, CASE WHEN (row + col + month) % 7 = 0 THEN 'failed' END AS error
  FROM ard, (VALUES ('qty'), ('disc'), ('tax')) t(v) WHERE year = 2000)"""


def effects(s, d):
    rows = ard(s, d).where("year = 2000")
    stacked = rows.select("row", "col", "month", F.inline(F.array(*[F.struct(F.lit(v).alias("source"), F.col(v).alias("effect")) for v in ("qty", "disc", "tax")])))
    return stacked.select("row", "col", "source", F.lit("nl").alias("target"), F.col("month").cast("int").alias("horizon"), "effect", F.when((F.col("row") + F.col("col") + F.col("month")) % 7 == 0, "failed").alias("error"))


@query(with_sql(ARD, EFFECT_ROWS) + "SELECT row, col, source, target, horizon, effect FROM effects WHERE horizon IN (1, 3, 6) AND target = 'nl' AND source IN ('qty', 'tax') AND error IS NULL")
def effects_scan(s, d):
    return T.effects_scan(effects(s, d), ["qty", "tax"], "nl", [1, 3, 6], ["effect"])


@query(with_sql(ARD) + "SELECT count(*) AS n_rows, count(DISTINCT (row, col)) AS n_pixels, 'bic' AS criterion, CAST(50 AS INTEGER) AS min_samples FROM ard")
def run_metadata(s, d):
    return T.run_metadata(ard(s, d), P.KEYS, {"criterion": "bic", "min_samples": 50})


@query(
    with_sql(CATALOG)
    + """, old AS (SELECT variable_name, year, month, file_name, row_number() OVER (ORDER BY year, month NULLS FIRST, variable_name) AS id FROM catalog WHERE year < 1999),
new AS (SELECT variable_name, year, month, 'v2_' || file_name AS file_name FROM catalog WHERE year IN (1998, 1999))
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.variable_name = old.variable_name AND n.year = old.year AND n.month IS NOT DISTINCT FROM old.month)
UNION ALL SELECT variable_name, year, month, file_name, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY variable_name NULLS FIRST, year, month NULLS FIRST) FROM new"""
)
def catalog_upsert(s, d):
    from pyspark.sql import Window

    c = catalog(s, d).select("variable_name", "year", "month", "file_name")
    old = c.where("year < 1999").withColumn("id", F.row_number().over(Window.orderBy("year", F.col("month").asc_nulls_first(), "variable_name")).cast("long"))
    new = c.where("year in (1998, 1999)").withColumn("file_name", F.concat(F.lit("v2_"), "file_name"))
    return K.upsert(old, new, ["variable_name", "year", "month"])


JSON_GRAPHS = """graphs AS (SELECT row, col, sum(nl)::BIGINT AS total FROM ard GROUP BY row, col)"""


@query(
    with_sql(ARD, JSON_GRAPHS)
    + """, m AS (SELECT row, col, [[0.0, (total % 7) / 8.0, 0.0], [0.0, 0.0, (total % 5) / 4.0], [0.5, 0.0, 0.0]] AS w, ['nl', 'qty', 'price'] AS names FROM graphs WHERE total % 3 <> 0)
SELECT row, col, names[j] AS parent, names[i] AS child, CAST(w[i][j] AS DOUBLE) AS weight FROM m, generate_series(1, 3) a(i), generate_series(1, 3) b(j) WHERE w[i][j] <> 0"""
)
def graph_json_import(s, d):
    t = ard(s, d).groupBy("row", "col").agg(F.sum("nl").cast("long").alias("total"))
    w = F.array(F.array(F.lit(0.0), (F.col("total") % 7) / 8, F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), (F.col("total") % 5) / 4), F.array(F.lit(0.5), F.lit(0.0), F.lit(0.0)))
    stored = t.select("row", "col", F.when(F.col("total") % 3 == 0, "[[0, 1]").otherwise(F.to_json(w)).alias("matrix"), F.lit('["nl", "qty", "price"]').alias("names"))
    return T.edges_from_json(stored, "matrix", "names")


# --- catalog and assembly


@query(with_sql(MONTHS) + "SELECT year, month, variable, file_name FROM files")
def catalog_months(s, d):
    return K.months(catalog(s, d), NAME_MAP)


@query(with_sql(COMPLETE) + "SELECT year, month FROM complete")
def catalog_complete_months(s, d):
    return K.complete_months(K.months(catalog(s, d), NAME_MAP), REQUIRED)


@query(
    with_sql(ARD, COMPLETE)
    + """, wanted AS (SELECT DISTINCT year, month FROM ard WHERE year BETWEEN 1996 AND 2000), seen AS (SELECT DISTINCT year, month FROM ard WHERE month % 5 <> 0)
SELECT w.year, w.month, CAST((w.year * 12 + w.month - 1 - 2) // 12 AS INTEGER) AS model_year, CAST((w.year * 12 + w.month - 1 - 2) % 12 + 1 AS INTEGER) AS model_month,
  concat_ws('; ', CASE WHEN s.year IS NULL THEN 'target not observed' END, CASE WHEN c.year IS NULL THEN 'model month incomplete' END) AS reason
FROM wanted w LEFT JOIN seen s USING (year, month) LEFT JOIN complete c ON c.year = (w.year * 12 + w.month - 3) // 12 AND c.month = (w.year * 12 + w.month - 3) % 12 + 1"""
)
def catalog_choose_months(s, d):
    a = ard(s, d).select("year", "month").distinct()
    return K.choose_months(a.where("year between 1996 and 2000"), a.where("month % 5 <> 0"), K.complete_months(K.months(catalog(s, d), NAME_MAP), REQUIRED), 2)


@query(with_sql(CATALOG) + "SELECT variable_name, year, month, file_name FROM catalog WHERE length(file_name) % 3 = 0 AND year % 2 = 0 ORDER BY year, month NULLS FIRST, variable_name LIMIT 25")
def catalog_missing_files(s, d):
    c = catalog(s, d)
    listing = c.where("not (length(file_name) % 3 = 0 and year % 2 = 0)").select("file_name")
    return K.missing_files(c, listing, 25).select("variable_name", "year", "month", "file_name")


@query(with_sql(GAPPY) + " , v AS (SELECT year, month, 'qty' AS variable, qty AS value FROM ard_gappy UNION ALL SELECT year, month, 'tax', CASE WHEN month > 3 THEN tax END FROM ard_gappy) SELECT variable, year, count(*) AS n_rows, count(DISTINCT month) AS n_months FROM v WHERE value IS NOT NULL GROUP BY ALL")
def catalog_availability(s, d):
    return K.availability(ard_gappy(s, d).withColumn("tax", F.when(F.col("month") > 3, F.col("tax"))), ["qty", "tax"])


RASTER = """raster AS (SELECT row AS r, col AS c, year, month, CASE WHEN count(*) % 11 = 0 THEN -9999.0::DOUBLE ELSE sum(round(l_quantity)::BIGINT)::DOUBLE END AS raw FROM li GROUP BY ALL)"""


def raster(s, d):
    n = lines(s, d).groupBy(F.col("row").alias("r"), F.col("col").alias("c"), "year", "month").agg(F.count("*").alias("n"), F.sum(F.round("l_quantity").cast("long")).cast("double").alias("q"))
    return n.select("r", "c", "year", "month", F.when(F.col("n") % 11 == 0, -9999.0).otherwise(F.col("q")).alias("raw"))


@query(with_sql(ARD, RASTER) + "SELECT r, c, year, month, CASE WHEN raw <> -9999 THEN raw * 0.25::DOUBLE + 5 END AS value FROM raster")
def raster_calibrate(s, d):
    return raster(s, d).select("r", "c", "year", "month", P.calibrate(F.col("raw"), F.lit(-9999.0), F.lit(0.25), F.lit(5.0)).alias("value"))


@query(with_sql(ARD) + "SELECT DISTINCT row, col, (col + 0.5::DOUBLE) * 0.25 + 10 AS x, (row + 0.5::DOUBLE) * -0.25 + 50 AS y FROM nat")
def cell_centers(s, d):
    x, y = P.cell_centres(F.col("row"), F.col("col"), 0.25, 0.0, 10.0, 0.0, -0.25, 50.0)
    return pixels(s, d).select("row", "col", x.alias("x"), y.alias("y")).distinct()


@query(
    with_sql(ARD, RASTER)
    + """, coarse AS (SELECT year, month, r // 2 AS r, c // 2 AS c, max(raw) AS value FROM raster GROUP BY ALL)
SELECT a.row, a.col, a.year, a.month, v.value FROM ard a LEFT JOIN coarse v ON v.year = a.year AND v.month = a.month AND v.c = floor((a.x - 0.5) / 2) AND v.r = floor((4.5 - a.y) / 2)"""
)
def grid_align(s, d):
    coarse = raster(s, d).groupBy("year", "month", F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")).agg(F.max("raw").alias("value"))
    return P.grid_align(ard(s, d).select("row", "col", "year", "month", "x", "y"), coarse, {"x0": 0.5, "y0": 4.5, "dx": 2.0, "dy": 2.0}).select("row", "col", "year", "month", "value")


@query("SELECT CAST(m AS INTEGER) AS month, " + q6("sin(2 * pi() * m / 12)") + " AS month_sin, " + q6("cos(2 * pi() * m / 12)") + " AS month_cos FROM (SELECT DISTINCT month(o_orderdate) AS m FROM orders)")
def month_encoding(s, d):
    months = table(s, d, "orders").select(F.month("o_orderdate").alias("month")).distinct()
    a, b = C.month_encoding()
    return months.select("month", C.r6(a).alias("month_sin"), C.r6(b).alias("month_cos"))


@query(
    with_sql(ARD)
    + """, cells AS (SELECT row, col, year, month, 'flag' || l_returnflag AS variable, sum(round(l_quantity)::BIGINT)::BIGINT AS value FROM li GROUP BY ALL)
SELECT row, col, year, month, max(value) FILTER (variable = 'flagA') AS a, max(value) FILTER (variable = 'flagN') AS n, max(value) FILTER (variable = 'flagR') AS r
FROM cells GROUP BY ALL HAVING max(value) FILTER (variable = 'flagN') IS NOT NULL"""
)
def panel_assemble(s, d):
    flags = table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate", "l_returnflag")
    o, c = table(s, d, "orders"), table(s, d, "customer")
    px = F.broadcast(pixels(s, d))
    li = flags.join(o, F.col("l_orderkey") == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(px, F.col("c_nationkey") == px.n_nationkey)
    cells = li.groupBy("row", "col", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.concat(F.lit("flag"), "l_returnflag").alias("variable")).agg(F.sum(F.round("l_quantity").cast("long")).alias("value"))
    return P.assemble(cells, ["flagA", "flagN", "flagR"], "flagN").select("row", "col", "year", "month", F.col("flagA").alias("a"), F.col("flagN").alias("n"), F.col("flagR").alias("r"))


@query(with_sql(ARD) + "SELECT DISTINCT row, col, col + 0.5::DOUBLE AS x, 5 - (row + 0.5::DOUBLE) AS y FROM nat WHERE col + 0.5 > 0.9 AND col + 0.5 < 4.2 AND 4.5 - row > 0.2 AND 4.5 - row < 3.7")
def polygon_clip(s, d):
    cells = pixels(s, d).select("row", "col", (F.col("col") + 0.5).alias("x"), (F.lit(5) - (F.col("row") + 0.5)).alias("y")).distinct()
    return P.polygon_clip(cells, [[(0.9, 0.2), (4.2, 0.2), (4.2, 3.7), (0.9, 3.7)]])


@query(with_sql(ARD) + ", box AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM ard) SELECT 'tile' || i || '_' || j AS tile FROM generate_series(0, 3) a(i), generate_series(0, 3) b(j), box WHERE i * 3.0 <= b AND i * 3.0 + 3 >= a AND j * 3.0 - 1 <= d AND j * 3.0 + 2 >= c")
def bbox_tiles(s, d):
    ij = s.range(4).select(F.col("id").alias("i")).crossJoin(s.range(4).select(F.col("id").alias("j")))
    tiles = ij.select(F.concat(F.lit("tile"), "i", F.lit("_"), "j").alias("tile"), (F.col("i") * 3.0).alias("x0"), (F.col("i") * 3.0 + 3).alias("x1"), (F.col("j") * 3.0 - 1).alias("y0"), (F.col("j") * 3.0 + 2).alias("y1"))
    return P.bbox_tiles(ard(s, d), tiles).select("tile")


# --- shifts, filters, scalar functions


@query(with_sql(GAPPY) + f"SELECT {KV}, qty, lag(price, 2) OVER w AS price, lead(tax, 1) OVER w AS tax FROM ard_gappy WINDOW w AS (PARTITION BY row, col ORDER BY year, month)")
def panel_shift(s, d):
    return P.shift(ard_gappy(s, d), [P.Shifted("qty"), P.Shifted("price", 2), P.Shifted("tax", -1)])


@query(with_sql(GAPPY) + f"SELECT a.{KV.replace(', ', ', a.')}, a.qty, b.price, c.tax FROM ard_gappy a LEFT JOIN ard_gappy b ON b.row = a.row AND b.col = a.col AND b.year * 12 + b.month = a.year * 12 + a.month + 3 LEFT JOIN ard_gappy c ON c.row = a.row AND c.col = a.col AND c.year * 12 + c.month = a.year * 12 + a.month - 1")
def panel_shift_calendar(s, d):
    return P.shift_calendar(ard_gappy(s, d), {"qty": 0, "price": 3, "tax": -1})


@query(with_sql(GAPPY) + "SELECT CAST(i AS INTEGER) AS row, CAST(j AS INTEGER) AS col, max(qty) FILTER (year * 12 + month = 1999 * 12 + 6) AS qty, max(price) FILTER (year * 12 + month = 1999 * 12 + 4) AS price FROM generate_series(0, 5) a(i) CROSS JOIN generate_series(0, 5) b(j) LEFT JOIN ard_gappy g ON g.row = i AND g.col = j GROUP BY i, j")
def panel_snapshot(s, d):
    return P.snapshot(ard_gappy(s, d), 1999, 6, {"qty": 0, "price": 2}, 6, 6)


@query(with_sql(ARD) + f"SELECT {KV}, lead(qty, 2) OVER w AS raw, lead(price, 2) OVER w AS expected, CAST((year * 12 + month + 1) // 12 AS INTEGER) AS observed_year, CAST((year * 12 + month + 1) % 12 + 1 AS INTEGER) AS observed_month FROM ard WINDOW w AS (PARTITION BY row, col ORDER BY year, month)")
def shifted_target(s, d):
    return P.shifted_target(ard(s, d), "qty", "price", 2)


@query(with_sql(ARD, EFFECT_ROWS) + "SELECT row, col, source, horizon, effect FROM effects WHERE error IS NULL")
def error_free(s, d):
    return P.error_free(effects(s, d)).select("row", "col", "source", "horizon", "effect")


@query(with_sql(ARD) + f"SELECT {KV}, qty, tax FROM ard WHERE year BETWEEN 1996 AND 2000 AND nl % 4 <> 0")
def drop_incomplete(s, d):
    a = ard(s, d).withColumn("qty", F.when(F.col("nl") % 4 != 0, F.col("qty")))
    return P.drop_incomplete(a, ["qty", "tax"], 1996, 2000).select(*P.KEYS, *P.TIME, "qty", "tax")


@query(with_sql(ARD) + f", g AS (SELECT {KV}, qty, CASE WHEN nl % 4 <> 0 THEN nl END AS nl FROM ard) SELECT * FROM g WHERE qty >= 25 AND month != 6 AND nl < 40")
def predicate_filter(s, d):
    a = ard(s, d).select(*P.KEYS, *P.TIME, "qty", F.when(F.col("nl") % 4 != 0, F.col("nl")).alias("nl"))
    for text in ("qty >= 25", "month != 6", "nl < 40"):
        a = a.where(C.predicate(text))
    return a


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST((year(o_orderdate) * 12 + month(o_orderdate) - 1 - 17) // 12 AS INTEGER) AS back_year, CAST((year(o_orderdate) * 12 + month(o_orderdate) - 1 - 17) % 12 + 1 AS INTEGER) AS back_month FROM orders")
def ym_shift(s, d):
    m = table(s, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    y, k = C.ym_shift("year", "month", -17)
    return m.select("year", "month", y.alias("back_year"), k.alias("back_month"))


@query("SELECT CAST((y * 12 + m - 1 - 2) // 12 AS INTEGER) AS model_year, CAST((y * 12 + m - 1 - 2) % 12 + 1 AS INTEGER) AS model_month, CAST(y AS INTEGER) AS observed_year, CAST(m AS INTEGER) AS observed_month FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) CROSS JOIN generate_series(1, 12) g(m)")
def holdout_months(s, d):
    from terracause.operators.holdout import holdout_months

    return holdout_months(table(s, d, "orders").select(F.year("o_orderdate").alias("year")).distinct(), 2)


@query("SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS value FROM events")
def finite_or_null(s, d):
    e = table(s, d, "events")
    bad = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("-inf")).otherwise(F.col("value"))
    return e.select("event_id", C.finite_or_null(bad).alias("value"))


@query("SELECT event_type, CASE WHEN lower(trim(t)) IN ('1', 'true', 'yes') THEN true WHEN lower(trim(t)) IN ('0', 'false', 'no') THEN false END AS flag, count(*) AS n FROM (SELECT event_type, CASE event_id % 5 WHEN 0 THEN ' TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' END AS t FROM events) GROUP BY ALL")
def coerce_boolean(s, d):
    k = F.col("event_id") % 5
    t = F.when(k == 0, " TRUE").when(k == 1, "no").when(k == 2, "1").when(k == 3, "maybe")
    return table(s, d, "events").select("event_type", C.coerce_boolean(t).alias("flag")).groupBy("event_type", "flag").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, {q6('-log10(greatest(least(value / 100, 1.0), 1e-300))')} AS minus_log, CASE WHEN value - 10 > 0 THEN {q6('log10(CASE WHEN value - 10 > 0 THEN value - 10 ELSE 1 END)')} END AS log_value FROM events")
def log_metrics(s, d):
    return table(s, d, "events").select("event_id", C.r6(C.minus_log10(F.col("value") / 100)).alias("minus_log"), C.r6(C.log10_positive(F.col("value") - 10)).alias("log_value"))


#: Beginnings and ends of the names that labels are made of: small words, acronyms, units, numbers, residuals.
ENDS = ["_resid", "-of-ndvi", "_2.5_m", "_residual", "_by_month-and-YEAR", ""]
NAMES = f"n AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'of_' WHEN 1 THEN 'abs ' WHEN 2 THEN ' LST__' ELSE '' END || replace(p_name, ' ', '_') || {ENDS!r}[CAST(p_partkey % {len(ENDS)} + 1 AS INTEGER)] AS variable FROM part)"


def _names(s, d):
    key = F.col("p_partkey")
    end = F.element_at(F.array(*map(F.lit, ENDS)), (key % len(ENDS) + 1).cast("int"))
    begin = F.when(key % 7 == 0, "of_").when(key % 7 == 1, "abs ").when(key % 7 == 2, " LST__").otherwise("")
    return table(s, d, "part").select("p_partkey", F.concat(begin, F.translate("p_name", " ", "_"), end).alias("variable"))


@query(
    f"WITH {NAMES}, "
    + """w AS (SELECT p_partkey, variable, i, lower(w) AS w FROM (SELECT p_partkey, variable, unnest(list_filter(string_split_regex(regexp_replace(variable, '[_-]', ' ', 'g'), '\\s+'), lambda w: w <> '')) AS w, generate_subscripts(list_filter(string_split_regex(regexp_replace(variable, '[_-]', ' ', 'g'), '\\s+'), lambda w: w <> ''), 1) AS i FROM n)),
l AS (SELECT p_partkey, variable, i, CASE WHEN w IN ('ndvi', 'lst') THEN upper(w) WHEN w = 'm' THEN w WHEN w = 'abs' THEN 'Absolute' WHEN i > 1 AND w IN ('of', 'by', 'and') THEN w ELSE upper(w[1]) || w[2:] END AS w FROM w)
SELECT p_partkey, variable, string_agg(w, ' ' ORDER BY i) AS label FROM l GROUP BY p_partkey, variable"""
)
def display_label(s, d):
    return _names(s, d).withColumn("label", C.display_label("variable"))


@query(
    f"WITH {NAMES}, "
    + """b AS (SELECT p_partkey, variable, regexp_replace(variable, '(_residual|_resid)$', '') AS base FROM n), t AS (SELECT *, trim(replace(base, '_', ' ')) AS plain FROM b)
SELECT p_partkey, variable, CASE WHEN variable = 'red_widget_resid' THEN 'Widgets, red' ELSE CASE base WHEN 'blue_widget' THEN 'Widgets, blue' ELSE upper(plain[1]) || lower(plain[2:]) END || CASE WHEN base <> variable THEN ' anomaly' ELSE '' END END AS label FROM t"""
)
def variable_label(s, d):
    return _names(s, d).withColumn("label", C.variable_label("variable", {"red_widget_resid": "Widgets, red", "blue_widget": "Widgets, blue"}))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 4 <> 0")
def json_records(s, d):
    from terracause.operators.aggregates import json_records

    cells = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "[{broken").otherwise(F.concat(F.lit("["), "props", F.lit("]"))).alias("cell"))
    return json_records(cells, "cell", "k bigint", ["event_id"])


@query("SELECT event_id, CASE WHEN p <= 0 OR p >= 1 THEN 0.0::DOUBLE ELSE " + q6("-p * log2(p) - (1 - p) * log2(1 - p)") + " END AS entropy FROM (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS p FROM events)")
def binary_entropy(s, d):
    e = table(s, d, "events").select("event_id", ((F.col("event_id") % 11) / 10.0).alias("p"))
    return e.select("event_id", F.when((F.col("p") <= 0) | (F.col("p") >= 1), 0.0).otherwise(C.r6(C.binary_entropy("p"))).alias("entropy"))


def _laea_sql() -> str:
    import math

    f = C.GRS80_F
    e = math.sqrt(2 * f - f * f)
    q = lambda v: f"(1 - {e * e!r}) * ({v} / (1 - {e * e!r} * {v} * {v}) - ln((1 - {e!r} * {v}) / (1 + {e!r} * {v})) / {2 * e!r})"
    qp = (1 - e * e) * (1 / (1 - e * e) - math.log((1 - e) / (1 + e)) / (2 * e))
    s0 = math.sin(math.radians(C.LAEA_LAT))
    q0 = (1 - e * e) * (s0 / (1 - e * e * s0 * s0) - math.log((1 - e * s0) / (1 + e * s0)) / (2 * e))
    b0, rq = math.asin(q0 / qp), C.GRS80_A * math.sqrt(qp / 2)
    dd = C.GRS80_A * math.cos(math.radians(C.LAEA_LAT)) / math.sqrt(1 - e * e * s0 * s0) / (rq * math.cos(b0))
    return f"""
WITH p AS (SELECT DISTINCT c_custkey, -10.0::DOUBLE + c_custkey % 40 AS lon, 36.0::DOUBLE + c_custkey % 30 AS lat FROM customer),
b AS (SELECT *, asin({q('sin(radians(lat))')} / {qp!r}) AS beta, radians(lon - {C.LAEA_LON!r}) AS turn FROM p),
k AS (SELECT *, {rq!r} * sqrt(2 / (1 + {math.sin(b0)!r} * sin(beta) + {math.cos(b0)!r} * cos(beta) * cos(turn))) AS b FROM b)
SELECT c_custkey, round({C.LAEA_E!r} + b * {dd!r} * cos(beta) * sin(turn), 3) AS east, round({C.LAEA_N!r} + b / {dd!r} * ({math.cos(b0)!r} * sin(beta) - {math.sin(b0)!r} * cos(beta) * cos(turn)), 3) AS north FROM k"""


@query(_laea_sql())
def laea_project(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.lit(-10.0) + F.col("c_custkey") % 40).alias("lon"), (F.lit(36.0) + F.col("c_custkey") % 30).alias("lat")).distinct()
    east, north = C.laea_project("lon", "lat")
    return c.select("c_custkey", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(with_sql(ARD) + "SELECT DISTINCT row, col, CAST(floor(x / 2) AS BIGINT) || '_' || CAST(floor(y / 2) AS BIGINT) AS block FROM ard")
def spatial_block(s, d):
    return ard(s, d).select("row", "col", C.spatial_block("x", "y", 2.0).alias("block")).distinct()


# --- joins


@query(with_sql(ARD, LABELS) + f"SELECT {KV}, qty, code FROM ard JOIN labels_px USING (row, col) WHERE code <> 3")
def graph_panel_join(s, d):
    return P.graph_panel_join(ard(s, d).select(*P.KEYS, *P.TIME, "qty"), labels_px(s, d).where("code <> 3").select("row", "col", "code"))


POOL = "SELECT DISTINCT c.row AS centre_row, c.col AS centre_col, p.row, p.col FROM nat c JOIN nat p ON abs(c.row - p.row) <= 1 AND abs(c.col - p.col) <= 1"


@query(with_sql(GAPPY) + f", pool AS ({POOL}) SELECT centre_row, centre_col, row, col, year, month, qty FROM pool JOIN ard_gappy USING (row, col)")
def window_pool(s, d):
    return P.window_pool(ard_gappy(s, d), 1, ["year", "month", "qty"])


def _summary(where: str) -> str:
    return f", pool AS ({POOL}) SELECT centre_row AS row, centre_col AS col, count(DISTINCT (row, col)) AS n_pixels, {q6('avg(qty)')} AS qty_mean, {q6('stddev_pop(qty)')} AS qty_sd, {q6('avg(tax)')} AS tax_mean, {q6('stddev_pop(tax)')} AS tax_sd FROM pool JOIN ard_gappy USING (row, col) WHERE {where} GROUP BY centre_row, centre_col"


def _window_summary(panel):
    return P.window_summary(panel, 1, ["qty", "tax"]).select("row", "col", "n_pixels", *[C.r6(c).alias(c) for c in ("qty_mean", "qty_sd", "tax_mean", "tax_sd")])


@query(with_sql(GAPPY) + _summary("true"))
def window_summary(s, d):
    return _window_summary(ard_gappy(s, d))


@query(with_sql(GAPPY) + _summary("year < 2000"))
def window_summary_asof(s, d):
    return _window_summary(ard_gappy(s, d).where("year < 2000"))


#: Months that all pixels have, less some of the last row: windows above that row are complete, those that reach it aren't.
SHARED = ", shared AS (SELECT * FROM ard WHERE (year, month) IN (SELECT (year, month) FROM ard GROUP BY year, month HAVING count(*) = 25) AND NOT (row = 4 AND (col + year + month) % 3 = 0))"


def _shared(s, d):
    a = ard(s, d)
    all_ = a.groupBy("year", "month").agg(F.count("*").alias("_n")).where("_n = 25").drop("_n")
    return a.join(all_, ["year", "month"]).where("not (row = 4 and (col + year + month) % 3 = 0)")


@query(
    with_sql(ARD)
    + SHARED
    + f""", pool AS ({POOL}), own AS (SELECT row, col, count(*) AS n, list_sort(list(year * 12 + month)) AS clock FROM shared GROUP BY row, col)
SELECT centre_row AS row, centre_col AS col, sum(n)::BIGINT AS n_rows FROM pool JOIN own USING (row, col) GROUP BY ALL HAVING count(*) = 9 AND count(DISTINCT clock) = 1 AND sum(n) >= 9"""
)
def window_complete(s, d):
    return P.window_complete(_shared(s, d), 1, ["qty", "tax"], 9)


@query(with_sql(ARD) + f"SELECT CAST(row_number() OVER (ORDER BY {KV}) AS INTEGER) AS row_id, {KV}, qty, nl FROM ard WHERE row BETWEEN 1 AND 3 AND col BETWEEN 1 AND 3")
def window_export(s, d):
    return P.window_export(ard(s, d), 2, 2, 1, ["qty", "nl"])


@query(with_sql(ARD, LABELS) + "SELECT row, col, n_months, klass FROM (SELECT row, col, count(*) AS n_months FROM ard GROUP BY row, col) LEFT JOIN (SELECT * FROM labels_px WHERE code < 5) USING (row, col)")
def checked_join(s, d):
    own = ard(s, d).groupBy("row", "col").agg(F.count("*").alias("n_months"))
    return P.checked_join(own, labels_px(s, d).where("code < 5").select("row", "col", "klass"), P.KEYS, "left", one_to_one=True)


@query(with_sql(ARD) + "SELECT row, year, month, count(*) AS n FROM ard GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(s, d):
    return P.duplicate_keys(ard(s, d), ["row", "year", "month"])


@query(
    with_sql(ARD)
    + f""", a AS (SELECT row, col, stddev_pop(qty) AS m FROM ard WHERE year < 1998 GROUP BY ALL), b AS (SELECT row, col, stddev_pop(qty) AS m FROM ard WHERE year >= 1998 GROUP BY ALL),
j AS (SELECT a.m AS first, b.m AS second, b.m - a.m AS change FROM a JOIN b USING (row, col)), l AS (UNPIVOT j ON first, second, change INTO NAME model VALUE v)
SELECT model, count(*) AS n, {q6('median(v)')} AS median, {q6('quantile_cont(v, 0.05)')} AS q05, {q6('quantile_cont(v, 0.95)')} AS q95 FROM l GROUP BY model"""
)
def model_pair_compare(s, d):
    from terracause.operators.aggregates import model_pair_compare

    own = lambda w: ard(s, d).where(w).groupBy("row", "col").agg(F.stddev_pop("qty").alias("m"))
    return model_pair_compare(own("year < 1998"), own("year >= 1998"), "m").select("model", "n", *[C.r6(c).alias(c) for c in ("median", "q05", "q95")])
