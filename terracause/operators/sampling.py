"""Draws that depend on the seed, the pixel and the replicate only, never on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*parts: Column | str) -> Column:
    """A number below 2**32 from the first eight hexadecimal digits of an MD5 digest."""
    text = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def resample(panel: DataFrame, replicates: int, keys: tuple[str, ...] = ("row", "col"), order: tuple[str, ...] = ("year", "month")) -> DataFrame:
    """Each pixel's rows drawn anew with replacement, once a replicate (1 … replicates)."""
    own = Window.partitionBy(*keys)
    numbered = panel.withColumn("i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("n", F.count("*").over(own))
    places = numbered.select(*keys, F.col("i").alias("place"), "n").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    chosen = places.select(*keys, "replicate", (draw(*keys, "replicate", "place") % F.col("n")).cast("int").alias("i"))
    return chosen.join(numbered.drop("n"), [*keys, "i"]).drop("i")
