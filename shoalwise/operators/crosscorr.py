"""Lagged cross-correlation of two columns of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwise.frames import as_list, attach, durable, null_safe_join
from shoalwise.functions.columns import missing_as_null, period_index
from shoalwise.operators.ordered import position


def cross_correlation(
    df: DataFrame,
    keys: str | Sequence[str],
    time: str,
    x: str,
    y: str,
    max_lag: int,
    index: str = "calendar",
    step: str = "month",
) -> DataFrame:
    """r(k) for k = -max_lag..max_lag: x at t+k against y at t.

    Means, deviations (divisor n) and n come from the full series at every lag.
    Rows with a missing value are dropped.  ``index='calendar'`` counts lags in
    calendar steps; ``'rows'`` treats the remaining rows as consecutive.

    Times fall into blocks at least as long as the lag range and y is copied to
    the neighbouring blocks its lags reach, so pairs meet by an equi-join on the
    block: about three copies of y move, not one per lag, and a block never has
    more rows than its length.
    """
    if index not in ("calendar", "rows"):
        raise ValueError("index must be 'calendar' or 'rows'")
    keys = as_list(keys)
    dated = isinstance(df.schema[time].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    clock = period_index(time, step) if dated else F.col(time).cast("long")
    rows = df.select(
        *keys,
        clock.alias("__t"),
        missing_as_null(F.col(x).cast("double")).alias("__x"),
        missing_as_null(F.col(y).cast("double")).alias("__y"),
    ).na.drop("any", subset=["__t", "__x", "__y"])
    # the series is read for its moments and for both sides of the lag join
    rows = durable(rows)
    if index == "rows":
        rows = position(rows, keys, "__t", "__row").drop("__t").withColumnRenamed("__row", "__t")
    stats = rows.groupBy(*keys).agg(
        F.avg("__x").alias("__mx"),
        F.avg("__y").alias("__my"),
        F.stddev_pop("__x").alias("__sx"),
        F.stddev_pop("__y").alias("__sy"),
        F.count(F.lit(1)).alias("__n"),
    )
    # rows that share a time enter the products through their sums
    centred = (
        attach(rows, stats, keys)
        .groupBy(*keys, "__t")
        .agg(
            F.sum(F.col("__x") - F.col("__mx")).alias("__dx"),
            F.sum(F.col("__y") - F.col("__my")).alias("__dy"),
        )
    )
    size = max(max_lag + 1, 64)
    block = lambda t: F.floor(t / size)
    left = centred.select(
        *keys,
        F.col("__t").alias("__tx"),
        "__dx",
        block(F.col("__t")).alias("__block"),
    )
    right = centred.select(
        *keys,
        F.col("__t").alias("__ty"),
        "__dy",
        F.explode(F.sequence(block(F.col("__t") - max_lag), block(F.col("__t") + max_lag))).alias("__block"),
    )
    lag = F.col("__tx") - F.col("__ty")
    sums = (
        null_safe_join(left, right, [*keys, "__block"])
        .where(F.abs(lag) <= max_lag)
        .groupBy(*keys, lag.alias("lag"))
        .agg(F.sum(F.col("__dx") * F.col("__dy")).alias("__sum"))
    )
    reach = F.least(F.lit(max_lag), F.col("__n") - 1)
    lags = stats.where(F.col("__n") > 0).withColumn("lag", F.explode(F.sequence(-reach, reach)))
    r = F.try_divide(
        F.coalesce("__sum", F.lit(0.0)), F.col("__n") * F.col("__sx") * F.col("__sy")
    )
    return null_safe_join(lags, sums, [*keys, "lag"], "left").select(
        *keys, F.col("lag").cast("int").alias("lag"), r.alias("r")
    )
