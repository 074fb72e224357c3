"""Panel operators: assembly from raster cells, shifts, snapshots, windows and checked joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracause.functions.columns import month_index, ym_shift

KEYS = ["row", "col"]
TIME = ["year", "month"]


@dataclass(frozen=True)
class Shifted:
    """A panel column with a row lag; a negative shift takes later rows."""

    name: str
    shift: int = 0


def calibrate(raw: Column, nodata: Column, scale: Column, offset: Column) -> Column:
    return F.when(raw == nodata, None).otherwise(raw * scale + offset)


def cell_centres(row: Column, col: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """Affine coordinates of the centres of cells."""
    return (col + 0.5) * a + (row + 0.5) * b + c, (col + 0.5) * d + (row + 0.5) * e + f


def grid_align(reference: DataFrame, cells: DataFrame, grid: dict[str, float]) -> DataFrame:
    """For each reference row (with x, y) the value of the cell of another north-up grid that contains it; null outside."""
    c = F.floor((F.col("x") - grid["x0"]) / grid["dx"]).cast("int")
    r = F.floor((grid["y0"] - F.col("y")) / grid["dy"]).cast("int")
    placed = reference.withColumns({"_r": r, "_c": c})
    other = cells.select(*[x for x in TIME if x in reference.columns], F.col("r").alias("_r"), F.col("c").alias("_c"), "value")
    keys = [x for x in TIME if x in reference.columns] + ["_r", "_c"]
    return placed.join(other, keys, "left").drop("_r", "_c")


def assemble(cells: DataFrame, variables: list[str], reference: str) -> DataFrame:
    """One row a reference cell and month, one column a variable; cells without the reference variable give no row."""
    wide = cells.groupBy(*KEYS, *TIME).pivot("variable", variables).agg(F.first("value"))
    return wide.where(F.col(reference).isNotNull())


def point_in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule against one closed ring."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            crosses = (F.lit(y1) > y) != (F.lit(y2) > y)
            at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            inside = inside != (crosses & (x < at))
    return inside


def segment_meets_box(x: Column, y: Column, half: float, p: tuple[float, float], q: tuple[float, float]) -> Column:
    """Whether a segment meets the square of a cell: separating axes."""
    (x1, y1), (x2, y2) = p, q
    apart_x = (F.lit(max(x1, x2)) < x - half) | (F.lit(min(x1, x2)) > x + half)
    apart_y = (F.lit(max(y1, y2)) < y - half) | (F.lit(min(y1, y2)) > y + half)
    cross = F.abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1))
    return ~(apart_x | apart_y | (cross > half * (abs(y2 - y1) + abs(x2 - x1))))


def polygon_clip(cells: DataFrame, rings: list[list[tuple[float, float]]], all_touched: bool = False, half: float = 0.5) -> DataFrame:
    """Cells whose centre is inside (rings after the first are holes), or with ``all_touched`` whose square meets the boundary too."""
    x, y = F.col("x"), F.col("y")
    inside = F.lit(False)
    for ring in rings:
        inside = inside != point_in_ring(x, y, ring)
    if all_touched:
        for ring in rings:
            for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
                inside = inside | segment_meets_box(x, y, half, p, q)
    return cells.where(inside)


def bbox_tiles(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles (x0, y0, x1, y1) whose box meets the points' bounding box."""
    box = points.agg(F.min("x").alias("_a"), F.max("x").alias("_b"), F.min("y").alias("_c"), F.max("y").alias("_d"))
    # one row
    meets = (F.col("x0") <= F.col("_b")) & (F.col("x1") >= F.col("_a")) & (F.col("y0") <= F.col("_d")) & (F.col("y1") >= F.col("_c"))
    return tiles.crossJoin(F.broadcast(box)).where(meets).drop("_a", "_b", "_c", "_d")


def shift(panel: DataFrame, columns: list[Shifted], keep: list[str] | None = None) -> DataFrame:
    """Each pixel's columns lagged by rows, in place; duplicate and unknown names are refused."""
    names = [c.name for c in columns]
    if len(set(names)) < len(names):
        raise ValueError("a column is named twice")
    unknown = [n for n in names if n not in panel.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    order = Window.partitionBy(*KEYS).orderBy(*TIME)
    return panel.select(*KEYS, *TIME, *(keep or []), *[(F.lag(c.name, c.shift).over(order) if c.shift else F.col(c.name)).alias(c.name) for c in columns])


def shift_calendar(panel: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Each column's value ``k`` calendar months later, null where that month is absent."""
    out = panel.select(*KEYS, *TIME, month_index().alias("_t"), *[c for c, k in columns.items() if not k])
    for name, k in columns.items():
        if k:
            other = panel.select(*KEYS, (month_index() - k).alias("_t"), F.col(name))
            out = out.join(other, [*KEYS, "_t"], "left")
    return out.select(*KEYS, *TIME, *columns)


def snapshot(panel: DataFrame, year: int, month: int, columns: dict[str, int], rows: int, cols: int) -> DataFrame:
    """All variables at one month, each ``t`` months before it, on a dense grid."""
    spark = panel.sparkSession
    out = spark.range(rows).select(F.col("id").cast("int").alias("row")).crossJoin(F.broadcast(spark.range(cols).select(F.col("id").cast("int").alias("col"))))
    at = year * 12 + month - 1
    wide = panel.groupBy(*KEYS).agg(*[F.max(F.when(month_index() == at - t, F.col(name))).alias(name) for name, t in columns.items()])
    return out.join(wide, KEYS, "left")


def shifted_target(panel: DataFrame, target: str, expected: str, lag: int) -> DataFrame:
    """The target and its expectation ``lag`` rows on, with the month it was observed in."""
    order = Window.partitionBy(*KEYS).orderBy(*TIME)
    year, month = ym_shift("year", "month", lag)
    return panel.select(*KEYS, *TIME, F.lag(target, -lag).over(order).alias("raw"), F.lag(expected, -lag).over(order).alias("expected"), year.alias("observed_year"), month.alias("observed_month"))


def error_free(df: DataFrame) -> DataFrame:
    return df.where("error is null") if "error" in df.columns else df


def drop_incomplete(panel: DataFrame, variables: list[str], first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    rows = panel.na.drop(subset=[*KEYS, *TIME, *variables])
    if first_year is not None:
        rows = rows.where(F.col("year") >= first_year)
    return rows.where(F.col("year") <= last_year) if last_year is not None else rows


def window_pool(panel: DataFrame, reach: int, columns: list[str], centres: DataFrame | None = None) -> DataFrame:
    """Rows of all pixels within ``reach`` rows and columns of each centre; absent neighbours are skipped.

    Every pixel's rows are sent to the centres around it: an equi-join on the centre's key, no theta join.
    """
    step = F.sequence(F.lit(-reach), F.lit(reach))
    sent = panel.select(*KEYS, *columns).withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
    pooled = sent.select((F.col("row") + F.col("_i")).alias("centre_row"), (F.col("col") + F.col("_j")).alias("centre_col"), *KEYS, *columns)
    keys = (centres or panel).select(F.col("row").alias("centre_row"), F.col("col").alias("centre_col")).distinct()
    return pooled.join(keys, ["centre_row", "centre_col"], "left_semi")


def window_sums(panel: DataFrame, reach: int, columns: list[str]) -> DataFrame:
    """Count, sum and sum of squares over each centre's window, from one partial row a pixel instead of all rows."""
    own = panel.groupBy(*KEYS).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("s", F.sum), ("q", lambda x: F.sum(F.col(x) * F.col(x))))])
    parts = [f"{n}_{c}" for c in columns for n in "nsq"]
    return window_pool(own, reach, parts).groupBy("centre_row", "centre_col").agg(F.count("*").alias("n_pixels"), *[F.sum(p).alias(p) for p in parts])


def window_summary(panel: DataFrame, reach: int, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each variable over each centre's window."""
    sums = window_sums(panel, reach, columns)
    mean = lambda c: F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}"))
    spread = lambda c: F.sqrt(F.greatest(F.try_divide(F.col(f"q_{c}"), F.col(f"n_{c}")) - mean(c) * mean(c), F.lit(0.0)))
    return sums.select(F.col("centre_row").alias("row"), F.col("centre_col").alias("col"), "n_pixels", *[x for c in columns for x in (mean(c).alias(f"{c}_mean"), spread(c).alias(f"{c}_sd"))])


def window_complete(panel: DataFrame, reach: int, columns: list[str], least: int) -> DataFrame:
    """Centres whose window pixels all exist, have no nulls and one time index, and pool ``least`` rows."""
    months = F.sum(F.xxhash64("year", "month").cast("decimal(38,0)"))
    own = panel.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))).alias("nulls"), months.alias("clock"))
    pooled = window_pool(own, reach, ["n", "nulls", "clock"]).groupBy("centre_row", "centre_col").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("clock").alias("a"), F.max("clock").alias("b"))
    full = (2 * reach + 1) ** 2
    return pooled.where((F.col("k") == full) & (F.col("nulls") == 0) & (F.col("a") == F.col("b")) & (F.col("n") >= least)).select(F.col("centre_row").alias("row"), F.col("centre_col").alias("col"), F.col("n").alias("n_rows"))


def window_export(panel: DataFrame, row: int, col: int, reach: int, columns: list[str]) -> DataFrame:
    """Rows of one window, numbered from 1 in the order of pixel and time."""
    near = panel.where(F.col("row").between(row - reach, row + reach) & F.col("col").between(col - reach, col + reach))
    # one window: a bounded number of pixels
    number = F.row_number().over(Window.orderBy(*KEYS, *TIME))
    return near.select(number.alias("row_id"), *KEYS, *TIME, *columns)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", one_to_one: bool = False) -> DataFrame:
    """A join that refuses repeated keys on the right, and for one-to-one on the left."""
    for name, side in (("right", right), *([("left", left)] if one_to_one else [])):
        twice = duplicate_keys(side, keys).limit(3).collect()
        if twice:
            raise ValueError(f"repeated keys on the {name}: {[tuple(r)[:-1] for r in twice]}")
    return left.join(right, keys, how)


def graph_panel_join(panel: DataFrame, graphs: DataFrame) -> DataFrame:
    return panel.join(graphs, KEYS)


def consecutive_months(panel: DataFrame, variables: list[str]) -> DataFrame:
    """Whether each pixel's complete rows are unique and without a gap."""
    rows = panel.na.drop(subset=variables).withColumn("_t", month_index())
    n, k, span = F.count("*"), F.countDistinct("_t"), F.max("_t") - F.min("_t") + 1
    return rows.groupBy(*KEYS).agg(n.alias("n_rows"), ((n == k) & (k == span)).alias("consecutive"))


def time_index(panel: DataFrame) -> DataFrame:
    """Months since the first month of the whole panel."""
    first = panel.agg(F.min(month_index()).alias("_first"))
    return panel.crossJoin(F.broadcast(first)).withColumn("time_index", month_index() - F.col("_first")).drop("_first")


def grid_matrix(df: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    """Values on an explicit grid, one column a grid column; absent cells are null."""
    spark = df.sparkSession
    wide = df.where(F.col("col") < cols).groupBy("row").pivot("col", list(range(cols))).agg(F.first(value))
    named = wide.select("row", *[F.col(str(c)).alias(f"c{c}") for c in range(cols)])
    return spark.range(rows).select(F.col("id").cast("int").alias("row")).join(named, "row", "left")
