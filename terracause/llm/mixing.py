"""Operator 8 [native]: mixing sources to target weights by Pfair scheduling.

A source with weight w (its units over all units) gets its i-th block of documents
released at floor(i/w) and due at ceil((i+1)/w). Earliest deadline first over these
windows gives each slot to one source, and no source is ever a whole block ahead of or
behind its weight. The schedule repeats after as many slots as there are units, so it is
worked out for one period - as many rows as units - and joined to the blocks.

Documents of a source are taken in the order of a hash of their id. Their number in that
order comes from two levels of counts, so a source with a third of all rows is spread
over many tasks. All documents stay: once a source has no whole block left, its slots
stay empty; ``on_target`` marks the slots before the first empty one, and the guarantee
holds for them.

Defined cases: all sources that the weights don't name, and null, are one stream of one
unit; a null doc_id stands by the hash of its row; rows of one id follow each other in the order
of a hash of all their columns, but where a range of hashes holds over a thousandth of all rows (one id
on very many rows) the hash of the row goes first. Positions don't depend on partitions or files: only copies of
a row in all columns may change places. An empty table gives no rows. Extra columns
stay; those with the name of an output column are replaced.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracause.llm.shared import cut

NAMES = ("block", "slot", "position", "on_target")
#: Rows that a group of one source's hash range holds, about.
GROUP_ROWS = 2_048


def pattern(units: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, number of its block in the period, slot) of one period, earliest deadline first."""
    period = sum(units.values())
    waiting = [(0, math.ceil(period / u), name, 0) for name, u in units.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, due, name, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, name, i))
        _, name, i = heapq.heappop(ready)
        out.append((name, i, slot))
        if i + 1 < (u := units[name]):
            heapq.heappush(waiting, ((i + 1) * period // u, -(-(i + 2) * period // u), name, i + 1))
    return out


def content_of(docs: DataFrame, within: str = "") -> Column:
    """Hash of all columns of a row, or of the fields of the struct ``within``."""
    # maps have no hash
    return F.xxhash64(*[F.col(f"{within}`{c}`") for c, kind in docs.dtypes if "map<" not in kind])


def mix(docs: DataFrame, units: dict[str, int], block: int = 64, names: tuple[str, ...] = NAMES, content: str | None = None) -> DataFrame:
    """``docs`` with block, slot, position (its place in the mix, with gaps) and on_target, under ``names``.

    ``content`` names a column with the :func:`content_of` of rows that have had more columns: they get the places that the whole rows have.
    """
    spark, docs = docs.sparkSession, docs.drop(*names)
    rest = ""  # the stream of all sources without a weight
    while rest in units:
        rest += "_"
    source = F.when(F.col("source").isin(*units), F.col("source")).otherwise(F.lit(rest)) if units else F.lit(rest)
    # one row a weight, and one
    got = docs.groupBy(source.alias("s")).agg(F.count("*").alias("n")).collect()
    if not got:
        return docs.withColumns({n: F.lit(v).cast(kind) for n, v, kind in zip(names, (0, 0, 0, True), ("long", "long", "long", "boolean"), strict=True)})
    counts = {r.s: r.n for r in got}
    share = {name: units.get(name, 1) for name in sorted(counts)}
    period, schedule = sum(share.values()), pattern(share)
    slot_of = {(name, i): slot for name, i, slot in schedule}
    whole = {name: n // block for name, n in counts.items()}
    first_empty = min(whole[s] // u * period + slot_of[s, whole[s] % u] for s, u in share.items())

    total = sum(counts.values())
    bits = min(20, max(0, math.ceil(math.log2(max(1, total / GROUP_ROWS)))))
    limit = max(8 * GROUP_ROWS, total // 1000)
    key = F.conv(F.substring(F.md5(F.col("row.doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    told = F.col(f"row.`{content}`") if content else content_of(docs, "row.")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"), F.monotonically_increasing_id().alias("number")).withColumn("content", told)
    ranged = lambda df: df.withColumn("key", F.coalesce(key, F.shiftrightunsigned("content", 32))).withColumn("range", F.shiftright("key", 32 - bits) if bits else F.lit(0).cast("long"))
    many = lambda df, *by: df.groupBy("source", *by).count().where(F.col("count") > limit).select("source", *by)
    none = F.lit(0).cast("long")
    keyed = ranged(packed).withColumns({"part": none, "same": none, "salt": none})
    # each over a thousandth of all rows: a thousand at most
    if not many(keyed, "range").isEmpty():
        # rows have a number of their own, written once
        keyed = ranged(cut(packed, "mix"))
        heavy = F.broadcast(many(keyed, "range").withColumn("hot", F.lit(True)))
        part = F.when(F.col("hot"), F.shiftrightunsigned("content", 54)).otherwise(none)
        keyed = keyed.join(heavy, ["source", "range"], "left").withColumn("part", part)
        crowd = F.broadcast(many(keyed.where("hot"), "range", "part").withColumn("crowd", F.lit(True)))
        # copies of a row in all its columns may stand for each other, so they are dealt by number
        keyed = keyed.join(crowd, ["source", "range", "part"], "left").withColumns({"same": F.when(F.col("crowd"), F.col("content")).otherwise(none), "salt": F.when(F.col("crowd"), F.pmod(F.xxhash64("number", F.lit(5)), F.lit(1024))).otherwise(none)})
    group = ["source", "range", "part", "same", "salt"]
    groups = keyed.groupBy(*group).agg(F.count("*").alias("n"))
    # the ranges of a source, then the parts of a range, its contents and its copies
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = groups.select(*group, before(Window.partitionBy("source").orderBy(*group[1:])).alias("base"))
    inside = Window.partitionBy(*group).orderBy("key", "row.doc_id", "content", "number")
    blocks = keyed.withColumn("nth", F.row_number().over(inside)).join(bases, group).withColumn("seq", F.col("base") + F.col("nth") - 1).withColumn("block", F.floor(F.col("seq") / block).cast("long"))
    own = spark.createDataFrame([(s, i, slot) for s, i, slot in schedule], "source string, turn long, at long")
    sizes = spark.createDataFrame(list(share.items()), "source string, units long")
    # one row a weight, and one row a unit of weight
    placed = blocks.join(F.broadcast(sizes), "source").withColumn("turn", F.col("block") % F.col("units")).join(F.broadcast(own), ["source", "turn"])
    slot = F.floor(F.col("block") / F.col("units")).cast("long") * period + F.col("at")
    out = placed.withColumn("slot", slot).withColumn("position", F.col("slot") * block + F.col("seq") % block).withColumn("on_target", F.col("slot") < first_empty)
    return out.select("row.*", *[F.col(n).alias(name) for n, name in zip(NAMES, names, strict=True)])


def oracle(units: dict[str, int], block: int = 64) -> str:
    """The same in DuckDB's SQL, for tables with just the sources in ``units``."""
    values = ", ".join(f"('{s}', {i}, {slot}, {units[s]})" for s, i, slot in pattern(units))
    period = sum(units.values())
    return f"""
WITH pattern(source, turn, pos, units) AS (VALUES {values}),
ordered AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT, doc_id) - 1 AS seq FROM documents),
blocks AS (SELECT *, seq // {block} AS block FROM ordered),
short AS (
  SELECT min((n.whole // p.units) * {period} + p.pos) AS first_empty
  FROM (SELECT source, count(*) // {block} AS whole FROM documents GROUP BY source) n JOIN pattern p ON n.source = p.source AND p.turn = n.whole % p.units)
SELECT doc_id, b.source, block, (block // p.units) * {period} + p.pos AS slot, ((block // p.units) * {period} + p.pos) * {block} + seq % {block} AS position,
       (block // p.units) * {period} + p.pos < first_empty AS on_target
FROM blocks b JOIN pattern p ON b.source = p.source AND p.turn = b.block % p.units, short
"""
