"""Global ranks without a single task: ranges of rows, numbered apart, plus how many stand before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracause.sources.tables import scratch, table_replace


def ranked(df: DataFrame, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with its rows numbered from 0 in an order that tells all rows apart.

    Rows are dealt to ranges of the order and written, so that each knows its range for good; a row's
    number is its place in the range plus the sizes of the ranges before, of which there is a
    small table. Equal rows of a heavy range stay in one task, so the order should end in a key.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = table_replace(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), scratch(spark, "ranges"))
    # one row a range
    sizes = {r["_range"]: r["count"] for r in held.groupBy("_range").count().collect()}
    before, total = {}, 0
    for r in sorted(sizes):
        before[r], total = total, total + sizes[r]
    start = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])[F.col("_range")] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return held.withColumn(name, (place + start).cast("long")).drop("_range")
