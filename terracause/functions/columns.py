"""Scalar and aggregate column expressions used across the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(x: ColumnLike) -> Column:
    """Six decimals; the cut lies off the halves where sums of decimals tie."""
    return F.floor(col(x) * 1e6 + 0.5031) / F.lit(1e6)


def finite_or_null(x: ColumnLike) -> Column:
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_corr(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation; null where a column is constant (``corr`` raises there in ANSI mode)."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-12, F.try_divide(F.covar_pop(a, b), spread))


def month_index(year: ColumnLike = "year", month: ColumnLike = "month") -> Column:
    return col(year) * 12 + col(month) - 1


def ym_shift(year: ColumnLike, month: ColumnLike, by: int) -> tuple[Column, Column]:
    """The (year, month) pair ``by`` months later."""
    at = month_index(year, month) + by
    return F.floor(at / 12).cast("int"), (F.pmod(at, F.lit(12)) + 1).cast("int")


def month_encoding(month: ColumnLike = "month") -> tuple[Column, Column]:
    angle = col(month) * (2 * math.pi) / 12
    return F.sin(angle), F.cos(angle)


def coerce_boolean(x: ColumnLike) -> Column:
    """1/0, true/false, yes/no in any case; anything else is null."""
    t = F.lower(F.trim(col(x)))
    return F.when(t.isin("1", "true", "yes", "1.0"), True).when(t.isin("0", "false", "no", "0.0"), False)


def minus_log10(p: ColumnLike) -> Column:
    return -F.log10(F.greatest(F.least(col(p), F.lit(1.0)), F.lit(1e-300)))


def log10_positive(x: ColumnLike) -> Column:
    return F.when(col(x) > 0, F.log10(col(x)))


def binary_entropy(p: ColumnLike) -> Column:
    """-p log2 p - (1-p) log2(1-p); 0 at both ends."""
    c = col(p)
    return F.when(c.isNull(), None).when((c <= 0) | (c >= 1), 0.0).otherwise(-c * F.log2(c) - (1 - c) * F.log2(1 - c))


def spatial_block(x: ColumnLike, y: ColumnLike, size: float) -> Column:
    return F.concat_ws("_", F.floor(col(x) / size).cast("string"), F.floor(col(y) / size).cast("string"))


#: GRS80 ellipsoid and the ETRS89 / LAEA Europe projection (EPSG:3035), as published.
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
LAEA_LAT, LAEA_LON, LAEA_E, LAEA_N = 52.0, 10.0, 4321000.0, 3210000.0


def _q(sin_lat, e: float, log=math.log):
    return (1 - e * e) * (sin_lat / (1 - e * e * sin_lat * sin_lat) - log((1 - e * sin_lat) / (1 + e * sin_lat)) / (2 * e))


def laea_project(lon: ColumnLike, lat: ColumnLike) -> tuple[Column, Column]:
    """Forward Lambert azimuthal equal-area on the ellipsoid (Snyder 1987, eq. 24-17 to 24-23)."""
    e = math.sqrt(2 * GRS80_F - GRS80_F * GRS80_F)
    qp = _q(1.0, e)
    s0 = math.sin(math.radians(LAEA_LAT))
    b0 = math.asin(_q(s0, e) / qp)
    m0 = math.cos(math.radians(LAEA_LAT)) / math.sqrt(1 - e * e * s0 * s0)
    rq = GRS80_A * math.sqrt(qp / 2)
    d = GRS80_A * m0 / (rq * math.cos(b0))
    beta = F.asin(_q(F.sin(F.radians(col(lat))), e, F.log) / qp)
    turn = F.radians(col(lon) - LAEA_LON)
    b = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(beta) + math.cos(b0) * F.cos(beta) * F.cos(turn)))
    east = LAEA_E + b * d * F.cos(beta) * F.sin(turn)
    north = LAEA_N + b / d * (math.cos(b0) * F.sin(beta) - math.sin(b0) * F.cos(beta) * F.cos(turn))
    return east, north


# Fixed values of labels.
#: Words written in capitals.
ACRONYMS = ["ci", "db", "lst", "ndvi", "sd", "spei", "vpd"]
#: Units, which stay as they are.
UNITS = ["cm", "m", "mm"]
#: Words that are written out.
WORDS = {"abs": "Absolute", "boot": "Bootstrap", "corr": "Correlation", "gt": "Greater Than", "lt": "Less Than", "prob": "Probability"}
#: Words that are lower case but for the first of a label.
SMALL_WORDS = ["and", "as", "by", "for", "from", "in", "of", "on", "or", "to", "with"]
#: Variables with a label of their own.
VARIABLE_LABELS = {
    "temperature": "2 m air temperature",
    "precipitation": "Total precipitation",
    "evaporation": "Potential evaporation",
    "soil_moisture_7_to_28_cm": "Soil moisture (7–28 cm)",
    "soil_moisture_28_to_100_cm": "Soil moisture (28–100 cm)",
    "ndvi": "NDVI",
    "month_sin": "Month (sine)",
    "month_cos": "Month (cosine)",
}


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def display_label(name: ColumnLike, overrides: dict[str, str] | None = None) -> Column:
    """A name in code as the text of a figure: words apart at blanks, ``_`` and ``-``, capital first letters, and words as listed above; numbers stay."""
    own = _lookup({w: w.upper() for w in ACRONYMS} | {u: u for u in UNITS} | WORDS)

    def word(w: Column, place: Column) -> Column:
        low = F.lower(w)
        first = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.char_length(low)))
        return F.coalesce(own[low], F.when((place > 0) & low.isin(*SMALL_WORDS), low).when(w.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), w).otherwise(first))

    words = F.filter(F.split(F.regexp_replace(col(name), "[_-]", " "), r"\s+"), lambda w: w != "")
    text = F.array_join(F.transform(words, word), " ")
    return F.coalesce(_lookup(overrides)[col(name)], text) if overrides else text


def variable_label(name: ColumnLike, overrides: dict[str, str] | None = None) -> Column:
    """A variable's label: an override of the name as it is, else that of its base, which lacks ``_residual`` or ``_resid``, or a
    listed one, or the base in sentence case; residuals are called anomalies.
    """
    c = col(name)
    base = F.regexp_replace(c, "(_residual|_resid)$", "")
    plain = F.trim(F.translate(base, "_", " "))
    sentence = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, F.lit(2), F.char_length(plain))))
    label = F.concat(F.coalesce(_lookup(VARIABLE_LABELS | (overrides or {}))[base], sentence), F.when(base != c, " anomaly").otherwise(""))
    return F.coalesce(_lookup(overrides)[c], label) if overrides else label


#: Comparison by operator text; anything with a null is false.
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def predicate(text: str) -> Column:
    """``COL<op>VALUE`` as a condition; ``null`` asks for (non-)null, and rows with nulls match nothing else."""
    for op in ("==", "!=", "<=", ">=", "<", ">"):
        left, found, right = text.partition(op)
        if found:
            break
    else:
        raise ValueError(f"no comparison in {text!r}")
    c, value = F.col(left.strip()), right.strip()
    if value.lower() == "null":
        if op not in ("==", "!="):
            raise ValueError(f"null can only be compared with == or !=: {text!r}")
        return c.isNull() if op == "==" else c.isNotNull()
    try:
        literal = F.lit(float(value))
    except ValueError:
        literal = F.lit(value.strip("'\""))
    return F.coalesce(_COMPARE[op](c, literal), F.lit(False))
