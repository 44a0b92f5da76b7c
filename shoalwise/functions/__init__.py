from shoalwise.functions.columns import (
    first_match_prefix,
    harmonic_terms,
    log_factorial,
    mid_point,
    missing_as_null,
    month_start,
    oxygen_saturation,
    oxygen_percent,
    parsed,
    presence,
    season,
    standard_error,
    sum_or_zero,
    period_index,
)
from shoalwise.functions.tails import normal_two_sided, student_quantile, student_two_sided

__all__ = [
    "first_match_prefix",
    "harmonic_terms",
    "log_factorial",
    "mid_point",
    "missing_as_null",
    "month_start",
    "normal_two_sided",
    "oxygen_percent",
    "oxygen_saturation",
    "parsed",
    "period_index",
    "presence",
    "season",
    "standard_error",
    "student_quantile",
    "student_two_sided",
    "sum_or_zero",
]
