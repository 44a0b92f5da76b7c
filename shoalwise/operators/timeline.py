"""Calendar completion: gaps in a series become rows with missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalwise.frames import as_list

STEPS = ("day", "week", "month", "quarter", "year")


def complete_calendar(
    df: DataFrame, date: str = "date", keys: Sequence[str] = (), step: str = "month"
) -> DataFrame:
    """One row per key and calendar step between the key's first and last date.

    ``df`` is a series: one row per key and date, on step starts (the first of
    the month for ``month``).  Each row makes the gap rows up to the next date
    of its key, so the series is read once; a key has no more rows than its
    calendar has dates.
    """
    if step not in STEPS:
        raise ValueError(f"step must be one of {STEPS}")
    keys = as_list(keys)
    one = F.expr(f"interval 1 {step}")
    following = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    last = F.greatest(F.col(date), (F.coalesce("__next", F.col(date)) - one).cast("date"))
    dated = (
        df.where(F.col(date).isNotNull())
        .withColumn("__next", following)
        .withColumn("__date", F.explode(F.sequence(F.col(date), last, one)))
    )
    own = F.col("__date") == F.col(date)
    out = {date: F.col("__date").alias(date)} | {k: F.col(k) for k in keys}
    return dated.select(*[out.get(c, F.when(own, F.col(c)).alias(c)) for c in df.columns])
