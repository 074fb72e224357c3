"""The catalog of raster files: expansion to months, completeness and registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracause.functions.columns import month_index


def upsert(catalog: DataFrame, new: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """Register ``new`` rows: rows with the same key go, new ones get the ids after the largest there was.

    ``new`` is what one run has downloaded: a few thousand rows, numbered in one task.
    """
    top = catalog.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_top"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = catalog.alias("c").join(new.select(*keys).distinct().alias("n"), same, "left_anti")
    numbered = new.withColumn("_n", F.row_number().over(Window.orderBy(*[F.col(k).asc_nulls_first() for k in keys])))
    fresh = numbered.crossJoin(F.broadcast(top)).withColumn(ident, F.col("_top") + F.col("_n")).drop("_top", "_n")
    return kept.unionByName(fresh.select(*catalog.columns))


def months(catalog: DataFrame, names: dict[str, str]) -> DataFrame:
    """(year, month, variable, file_name), yearly files standing for twelve months; the last file of a key wins."""
    known = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    bad = catalog.where(known[F.col("variable_name")].isNull() | ~F.col("frequency").isin("monthly", "yearly")).select("variable_name", "frequency").distinct().limit(5).collect()
    if bad:
        raise ValueError(f"unmapped variables or unknown frequencies: {[tuple(r) for r in bad]}")
    every = F.when(F.col("frequency") == "yearly", F.sequence(F.lit(1), F.lit(12))).otherwise(F.array("month"))
    rows = catalog.select("year", F.explode(every).alias("month"), known[F.col("variable_name")].alias("variable"), F.col("file_name"))
    last = Window.partitionBy("year", "month", "variable").orderBy(F.desc("file_name"))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def complete_months(files: DataFrame, required: list[str]) -> DataFrame:
    """Months for which every required variable has a file."""
    have = files.where(F.col("variable").isin(*required)).groupBy("year", "month").agg(F.countDistinct("variable").alias("n"))
    return have.where(F.col("n") == len(required)).select("year", "month")


def choose_months(wanted: DataFrame, observed: DataFrame, complete: DataFrame, shift: int) -> DataFrame:
    """For each wanted month its model month, ``shift`` months earlier, and why it can't be used (empty: it can)."""
    at = month_index() - shift
    moved = wanted.select("year", "month", F.floor(at / 12).cast("int").alias("model_year"), (F.pmod(at, F.lit(12)) + 1).cast("int").alias("model_month"))
    seen = observed.select("year", "month", F.lit(True).alias("_seen"))
    full = complete.select(F.col("year").alias("model_year"), F.col("month").alias("model_month"), F.lit(True).alias("_full"))
    rows = moved.join(seen, ["year", "month"], "left").join(full, ["model_year", "model_month"], "left")
    why = F.concat_ws("; ", F.when(F.col("_seen").isNull(), "target not observed"), F.when(F.col("_full").isNull(), "model month incomplete"))
    return rows.select("year", "month", "model_year", "model_month", why.alias("reason"))


def missing_files(catalog: DataFrame, listing: DataFrame, most: int) -> DataFrame:
    """The first ``most`` catalog rows whose file is not in the listing."""
    gone = catalog.join(listing.select("file_name").distinct(), "file_name", "left_anti")
    return gone.orderBy(F.col("year"), F.col("month").asc_nulls_first(), "variable_name").limit(most)


def availability(panel: DataFrame, targets: list[str]) -> DataFrame:
    """Per year and target: rows with a value, and months that have any."""
    stacked = panel.select("year", "month", F.inline(F.array(*[F.struct(F.lit(t).alias("variable"), F.col(t).alias("value")) for t in targets])))
    return stacked.where("value is not null").groupBy("variable", "year").agg(F.count("*").alias("n_rows"), F.countDistinct("month").alias("n_months"))


def missing_months(required: DataFrame, available: DataFrame) -> DataFrame:
    return required.select("year", "month").distinct().join(available.select("year", "month").distinct(), ["year", "month"], "left_anti")


def reasons(*pairs: tuple[Column, str]) -> Column:
    return F.concat_ws("; ", *[F.when(c, text) for c, text in pairs])
