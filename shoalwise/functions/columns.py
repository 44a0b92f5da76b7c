"""Column expressions.  All of them stay inside generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_as_null(c: str | Column) -> Column:
    """NaN and NULL both mean "missing"; only NULL is kept."""
    return F.when(~F.isnan(col(c)), col(c))


# Text that reads as a number; anything else is missing.
WHOLE_TEXT = r"^\s*[+-]?\d+\s*$"
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parsed(c: str | Column, kind: str) -> Column:
    """Text as a type, NULL where it does not parse.

    Numbers are matched first: a failing try_cast raises and catches an error
    for every row, which is many times slower than the match.
    """
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.when(col(c).rlike(WHOLE_TEXT), col(c).try_cast(kind))
    if kind in ("float", "double"):
        return F.when(col(c).rlike(DECIMAL_TEXT), col(c).try_cast(kind))
    return col(c).try_cast(kind)


def sum_or_zero(c: str | Column) -> Column:
    """Sum that skips missing values and is 0 when all of them are missing."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def presence(c: str | Column) -> Column:
    """1 for a positive value, else the value itself."""
    return F.when(col(c) > 0, F.lit(1.0)).otherwise(col(c))


def standard_error(c: str | Column, n_valid: bool = False) -> Column:
    """Sample deviation over the root of the number of rows.

    Rows with a missing value count in the denominator unless ``n_valid``.
    """
    n = F.count(col(c)) if n_valid else F.count(F.lit(1))
    return F.try_divide(F.stddev_samp(col(c)), F.sqrt(n.cast("double")))


def month_start(year: str | Column, month: str | Column) -> Column:
    return F.make_date(col(year), col(month), F.lit(1))


def season(month: str | Column) -> Column:
    """Three-month seasons; December belongs to the winter of its own year."""
    m = col(month)
    return (
        F.when(m.between(3, 5), "Spring")
        .when(m.between(6, 8), "Summer")
        .when(m.between(9, 11), "Fall")
        .when(m.isin(1, 2, 12), "Winter")
    )


def period_index(date: str | Column, step: str = "month") -> Column:
    """Whole number of calendar steps since 1970; consecutive periods differ by one."""
    d = col(date)
    if step == "month":
        return (F.year(d) * 12 + F.month(d) - 1 - 1970 * 12).cast("long")
    if step == "year":
        return (F.year(d) - 1970).cast("long")
    if step == "day":
        return F.unix_date(d.cast("date")).cast("long")
    raise ValueError(f"unknown step {step!r}")


def mid_point(lower: str | Column, upper: str | Column) -> Column:
    return col(upper) - (col(upper) - col(lower)) / 2


def harmonic_terms(month: str | Column, period: float = 10.0, prefix: str = "") -> dict[str, Column]:
    """Cosine and sine of the month.  The period defaults to 10, not 12."""
    angle = 2 * math.pi * col(month) / F.lit(float(period))
    return {f"{prefix}cosine": F.cos(angle), f"{prefix}sine": F.sin(angle)}


def first_match_prefix(c: str | Column) -> Column:
    """Drop a leading ``mean.`` or ``se.`` once."""
    return F.regexp_replace(col(c), r"^(mean|se)\.", "")


def log_factorial(z: str | Column) -> Column:
    """ln(z!) for whole z: exact up to 20, Stirling's series beyond."""
    x = col(z).cast("double")
    inv = 1.0 / F.greatest(x, F.lit(1.0))
    inv2 = inv * inv
    series = inv * (1.0 / 12 - inv2 * (1.0 / 360 - inv2 * (1.0 / 1260 - inv2 / 1680)))
    stirling = (x + 0.5) * F.ln(F.greatest(x, F.lit(1.0))) - x + 0.5 * math.log(2 * math.pi) + series
    small = F.ln(F.factorial(F.least(col(z), F.lit(20)).cast("int")).cast("double"))
    return F.when(x <= 20, small).otherwise(stirling)


# Published oxygen solubility constants (fresh water, salinity
# factor, vapour pressure, pressure factor).
SOLUBILITY = (-139.34411, 1.575701e5, -6.642308e7, 1.2438e10, -8.621949e11)
SALINITY = (0.017674, -10.754, 2140.7)
VAPOUR = (11.8571, -3840.70, -216961.0)
THETA = (0.000975, -1.426e-5, 6.436e-8)


def oxygen_saturation(
    temp_c: str | Column, salinity: str | Column, pressure_atm: float | Column = 1.0
) -> Column:
    """Oxygen in mg/L at equilibrium for water temperature, salinity and pressure."""
    t = col(temp_c).cast("double")
    s = col(salinity).cast("double")
    p = pressure_atm if isinstance(pressure_atm, Column) else F.lit(float(pressure_atm))
    k = t + 273.15
    r = F.try_divide(F.lit(1.0), k)

    def poly(coefs: tuple[float, ...], v: Column) -> Column:
        out = F.lit(coefs[-1])
        for c in reversed(coefs[:-1]):
            out = out * v + F.lit(c)
        return out

    fresh = F.exp(poly(SOLUBILITY, r))
    saline = F.exp(-s * poly(SALINITY, r))
    vapour = F.exp(poly(VAPOUR, r))
    theta = poly(THETA, t)
    pressure = F.try_divide((p - vapour) * (1 - theta * p), (1 - vapour) * (1 - theta))
    return fresh * saline * pressure


def oxygen_percent(
    oxygen_mg_l: str | Column,
    temp_c: str | Column,
    salinity: str | Column,
    pressure_atm: float | Column = 1.013253,
) -> Column:
    """Measured oxygen as percent of saturation.

    The default pressure is the value the surveys use, read as atmospheres.
    """
    return F.try_divide(
        100 * col(oxygen_mg_l).cast("double"), oxygen_saturation(temp_c, salinity, pressure_atm)
    )
