"""Connected components by alternating star contraction, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracause.llm.shared import cut, drop

#: A key with more than this share of the rows is joined by broadcast; there are at most 1 / HOT of them.
HOT = 1 / 1000


def join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with ``right``, whose keys are unique, where a few keys of ``left`` may hold most of its rows.

    Keys that each hold over a thousandth of the rows are a thousand at most: these rows of
    ``right`` are broadcast, so that no task gathers the rows of such a key.
    """
    limit = max(64, int(left.count() * HOT))
    hot = left.groupBy(key).count().where(F.col("count") > limit).select(key)
    few = F.broadcast(hot.join(right, key, "left").withColumn("_hot", F.lit(True)))
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return left.join(few, key).drop("_hot").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node it is connected to, of all nodes in ``links`` (a, b) but those that are it.

    Each round joins every node's larger neighbours, then its smaller ones, to the smallest of
    its neighbourhood (large star, small star); it ends when all edges lead to a root.
    """
    edge = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(join_spread(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_spread(large, low, "u")
        again = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, edge = edge, cut(again, "stars")
        drop(before)
        drop(large)
        if edge.join(edge.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and edge.groupBy("u").count().where("count > 1").isEmpty():
            return edge.select(F.col("u").alias("node"), F.col("v").alias("comp"))
