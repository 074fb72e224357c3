"""Reading and writing of panels, results and graph tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terracause.functions.columns import finite_or_null


def with_nulls(df: DataFrame) -> DataFrame:
    """Non-finite doubles become null, so that aggregates skip them."""
    return df.select(*[finite_or_null(c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def panel_scan(df: DataFrame, required: list[str], columns: list[str] | None = None) -> DataFrame:
    """The asked-for columns of a panel; fails with the names of those that are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    return with_nulls(df.select(*(columns or required)))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all machines share; where that is unset, in a temporary one on a local master (tests) only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table_replace(df: DataFrame, path: str) -> DataFrame:
    """Create or replace a result table, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_exchange(df: DataFrame, path: str) -> DataFrame:
    """Write CSV with a header, and read it back with the schema it had."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(StructType.fromDDL(", ".join(f"{c} {t}" for c, t in df.dtypes))).option("header", True).csv(path)


def effects_scan(df: DataFrame, sources: list[str], target: str, horizons: list[int], columns: list[str]) -> DataFrame:
    """Rows of one target and some sources and horizons without an error; duplicate keys are refused."""
    keys = ["row", "col", "source", "target", "horizon"]
    rows = df.where(F.col("source").isin(*sources) & (F.col("target") == target) & F.col("horizon").isin(*horizons))
    if "error" in df.columns:
        rows = rows.where("error is null")
    twice = rows.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"duplicate keys: {[tuple(r)[:-1] for r in twice]}")
    return rows.select(*keys, *columns)


def run_metadata(df: DataFrame, keys: list[str], parameters: dict[str, object]) -> DataFrame:
    """One row: counts of a run and the parameters it had."""
    counts = df.agg(F.count("*").alias("n_rows"), F.countDistinct(*keys).alias("n_pixels"))
    return counts.select("*", *[F.lit(v).alias(k) for k, v in parameters.items()])


def edges_from_json(df: DataFrame, matrix: str, names: str, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Long edges of matrices stored as JSON text, ``matrix[child][parent]``; malformed ones give no rows."""
    m, n = F.from_json(matrix, "array<array<double>>"), F.from_json(names, "array<string>")
    good = df.select(*keys, m.alias("_m"), n.alias("_n")).where(F.col("_m").isNotNull() & (F.size("_m") == F.size("_n")) & F.forall("_m", lambda r: F.size(r) == F.size("_n")))
    rows = good.select(*keys, "_n", F.posexplode("_m").alias("_i", "_r"))
    return rows.select(*keys, "_n", "_i", F.posexplode("_r").alias("_j", "weight")).where("weight <> 0").select(*keys, F.col("_n")[F.col("_j")].alias("parent"), F.col("_n")[F.col("_i")].alias("child"), "weight")
