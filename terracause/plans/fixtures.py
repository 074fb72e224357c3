"""Panels and tables that the registered queries derive from the given tables.

Each fixture exists twice: as a DataFrame and as the text of common table expressions,
so that a query and its check start from the same rows. Averages are taken over exact
integer sums (cents), so both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracause.sources.tables import scratch, table_replace

KEYS = ["row", "col"]
TIME = ["year", "month"]
VARIABLES = ["qty", "price", "disc", "tax", "nl"]
#: Replicates of a pixel's graph.
REPLICATES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel a nation: its region is the row, its place in the region the column."""
    place = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("int").alias("row"), (F.dense_rank().over(place) - 1).cast("int").alias("col"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their pixel and month. Orders get their pixel first, so that line items are shuffled once."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nations: a fixed list of a few dozen
    px = F.broadcast(pixels(spark, sf_dir))
    placed = orders.join(customer.join(px, F.col("c_nationkey") == px.n_nationkey), F.col("o_custkey") == customer.c_custkey).select("o_orderkey", "row", "col")
    all_ = li.join(placed, li.l_orderkey == placed.o_orderkey)
    return all_.withColumn("year", F.year("l_shipdate")).withColumn("month", F.month("l_shipdate"))


def ard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis-ready panel: one row a pixel and month, one column a variable.

    Written once, since most queries read it several times (windows, replicates, fits): the
    line items are read and joined by one job only, and what follows grows with pixels and
    months. A query that needs the panel and graphs of it passes it on to :func:`edges`.
    """
    cents = lambda c, per: (F.sum(F.round(F.col(c) * 100).cast("long")) / (F.count("*") * per)).alias
    panel = lines(spark, sf_dir).groupBy("row", "col", "year", "month").agg(
        cents("l_quantity", 100.0)("qty"), cents("l_extendedprice", 100000.0)("price"), cents("l_discount", 100.0)("disc"), cents("l_tax", 100.0)("tax"), F.count("*").cast("double").alias("nl")
    )
    angle = F.col("month") * (2 * 3.141592653589793) / 12
    whole = panel.select("row", "col", "year", "month", (F.col("col") + 0.5).alias("x"), (F.lit(5) - (F.col("row") + 0.5)).alias("y"), F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"), *VARIABLES)
    return table_replace(whole, scratch(spark, "panel"))


def ard_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = (F.col("row") >= 2) & ((7 * F.col("row") + 3 * F.col("col") + F.col("year") * 12 + F.col("month")) % 29 == 0)
    return ard(spark, sf_dir).where(~gap)


ARD = """
nat AS (SELECT n_nationkey, CAST(n_regionkey AS INTEGER) AS row, CAST(dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS col FROM nation),
li AS (SELECT l.*, row, col, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month
       FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey),
ard AS (SELECT row, col, year, month, col + 0.5::DOUBLE AS x, 5 - (row + 0.5::DOUBLE) AS y, sin(month * (2 * 3.141592653589793::DOUBLE) / 12) AS month_sin, cos(month * (2 * 3.141592653589793::DOUBLE) / 12) AS month_cos,
       sum(round(l_quantity * 100)::BIGINT)::BIGINT / (count(*) * 100.0::DOUBLE) AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / (count(*) * 100000.0::DOUBLE) AS price,
       sum(round(l_discount * 100)::BIGINT)::BIGINT / (count(*) * 100.0::DOUBLE) AS disc, sum(round(l_tax * 100)::BIGINT)::BIGINT / (count(*) * 100.0::DOUBLE) AS tax, count(*)::DOUBLE AS nl
       FROM li GROUP BY row, col, year, month)"""
GAPPY = ARD + ", ard_gappy AS (SELECT * FROM ard WHERE NOT (row >= 2 AND (7 * row + 3 * col + year * 12 + month) % 29 = 0))"


def with_sql(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(p.strip() for p in parts) + " "


def q6(x: str) -> str:
    """SQL text of :func:`terracause.functions.columns.r6`."""
    return f"floor(({x}) * 1e6 + 0.5031) / 1e6"


def edges_ols(panel: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """A fixed-order graph a pixel, nl -> qty -> price, each child regressed on its parent; replicate 0 is the fit, others resample rows (0 replicates: the fit alone)."""
    from terracause.operators.sampling import resample

    rows = panel.withColumn("replicate", F.lit(0)).select("row", "col", "replicate", "qty", "price", "nl")
    if replicates:
        rows = rows.unionByName(resample(panel.select("row", "col", "year", "month", "qty", "price", "nl"), replicates).select("row", "col", "replicate", "qty", "price", "nl"))
    slopes = rows.groupBy("row", "col", "replicate").agg(F.regr_slope("qty", "nl").alias("a"), F.regr_slope("price", "qty").alias("b"))
    return slopes.select("row", "col", "replicate", F.inline(F.array(F.struct(F.lit("nl").alias("parent"), F.lit("qty").alias("child"), F.col("a").alias("weight")), F.struct(F.lit("qty").alias("parent"), F.lit("price").alias("child"), F.col("b").alias("weight")))))


def edges(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None, replicates: int = REPLICATES) -> DataFrame:
    """Graphs of the panel; one that the caller has already isn't made again."""
    return edges_ols(ard(spark, sf_dir) if panel is None else panel, replicates)


EDGES = (
    ARD
    + f""", numbered AS (SELECT row, col, qty, price, nl, row_number() OVER (PARTITION BY row, col ORDER BY year, month) - 1 AS i, count(*) OVER (PARTITION BY row, col) AS n FROM ard),
draws AS (SELECT row, col, rep, ('0x' || substr(md5(concat_ws('|', row, col, rep, i)), 1, 8))::BIGINT % n AS i FROM numbered, generate_series(1, {REPLICATES}) g(rep)),
sampled AS (SELECT row, col, 0 AS replicate, qty, price, nl FROM numbered UNION ALL SELECT row, col, rep, qty, price, nl FROM draws JOIN numbered USING (row, col, i)),
slopes AS (SELECT row, col, CAST(replicate AS INTEGER) AS replicate, regr_slope(qty, nl) AS a, regr_slope(price, qty) AS b FROM sampled GROUP BY ALL),
edges AS (SELECT row, col, replicate, 'nl' AS parent, 'qty' AS child, a AS weight FROM slopes UNION ALL SELECT row, col, replicate, 'qty', 'price', b FROM slopes)"""
)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source catalog: one file a priority and month; one priority is yearly."""
    yearly = F.col("o_orderpriority") == "5-LOW"
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variable_name"), F.year("o_orderdate").alias("year"), F.when(yearly, None).otherwise(F.month("o_orderdate")).alias("month"), F.when(yearly, "yearly").otherwise("monthly").alias("frequency"))
    one = o.where("coalesce(month, 1) + year <> 1999 or frequency = 'yearly'").distinct()
    name = F.concat_ws("_", F.lower(F.regexp_replace("variable_name", "[^A-Za-z]", "")), "year", F.coalesce(F.col("month").cast("string"), F.lit("all")))
    return one.withColumn("file_name", F.concat(name, F.lit(".tif"))).withColumn("root_dir", F.lit("cells"))


CATALOG = """catalog AS (
  SELECT *, concat_ws('_', lower(regexp_replace(variable_name, '[^A-Za-z]', '', 'g')), year, coalesce(CAST(month AS VARCHAR), 'all')) || '.tif' AS file_name, 'cells' AS root_dir FROM (
    SELECT DISTINCT o_orderpriority AS variable_name, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(month(o_orderdate) AS INTEGER) END AS month,
           CASE WHEN o_orderpriority = '5-LOW' THEN 'yearly' ELSE 'monthly' END AS frequency FROM orders) WHERE coalesce(month, 1) + year <> 1999 OR frequency = 'yearly')"""

#: Names of the catalog's variables in the panel.
NAME_MAP = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "other", "5-LOW": "low"}


def labels_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class label a pixel: the commonest order priority of its customers, with its share as purity."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    px = F.broadcast(pixels(spark, sf_dir))
    n = o.join(c, o.o_custkey == c.c_custkey).join(px, F.col("c_nationkey") == px.n_nationkey).groupBy("row", "col", F.substring("o_orderpriority", 1, 1).cast("int").alias("code")).agg(F.count("*").alias("n"))
    best = n.groupBy("row", "col").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("code"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.select("row", "col", "code", F.concat(F.lit("class"), F.col("code")).alias("klass"), (F.col("n") / F.col("total")).alias("purity"), ((F.col("total") % 10 + 1) / 10).alias("valid_fraction"))


LABELS = """labels_px AS (
  SELECT row, col, code, 'class' || code AS klass, n / total AS purity, (total % 10 + 1) / 10 AS valid_fraction FROM (
    SELECT row, col, code, n, sum(n) OVER (PARTITION BY row, col)::BIGINT AS total, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, code) AS k FROM (
      SELECT row, col, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey GROUP BY ALL)) WHERE k = 1)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and modelled qty of the last year: persistence, climatology, and their mean as the model."""
    a = ard(spark, sf_dir)
    clim = a.where("year <= 2000").groupBy("row", "col", "month").agg(F.avg("qty").alias("climatology"))
    last = a.where("year = 2000").select("row", "col", "month", F.col("qty").alias("persistence"))
    now = a.where("year = 2001").select("row", "col", "year", "month", "x", "y", F.col("qty").alias("observed"))
    return now.join(clim, ["row", "col", "month"], "left").join(last, ["row", "col", "month"], "left").withColumn("predicted", (F.col("climatology") + F.col("persistence")) / 2).select("row", "col", "year", "month", "x", "y", "observed", "predicted", "climatology", "persistence")


PREDICTIONS = """clim AS (SELECT row, col, month, avg(qty) AS climatology FROM ard WHERE year <= 2000 GROUP BY ALL),
predictions AS (SELECT a.row, a.col, a.year, a.month, a.x, a.y, a.qty AS observed, (climatology + l.qty) / 2 AS predicted, climatology, l.qty AS persistence
  FROM ard a LEFT JOIN clim USING (row, col, month) LEFT JOIN (SELECT * FROM ard WHERE year = 2000) l USING (row, col, month) WHERE a.year = 2001)"""
