"""Wide and long forms, zero filling, repeated rows, composite ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwise.frames import as_list, durable, null_safe_join
from shoalwise.functions.columns import missing_as_null, parsed
from shoalwise.operators.ordered import running_in_blocks


def widen(
    df: DataFrame, ids: str | Sequence[str], names_from: str, values_from: str, values: Sequence
) -> DataFrame:
    """One row per id, one column per listed name.

    The value list is required, so Spark needs no extra job to find the names.
    """
    return df.groupBy(*as_list(ids)).pivot(names_from, list(values)).agg(F.first(values_from))


def lengthen(
    df: DataFrame,
    ids: str | Sequence[str],
    columns: str | Sequence[str],
    names_to: str = "metric",
    values_to: str = "value",
) -> DataFrame:
    """One row per id and column; missing values are kept."""
    return df.unpivot(as_list(ids), as_list(columns), names_to, values_to)


def zero_fill(
    df: DataFrame,
    keys: str | Sequence[str],
    category: str,
    value: str,
    categories: Sequence,
    fill: float = 0.0,
) -> DataFrame:
    """Every key gets every listed category; pairs that were absent get ``fill``.

    The list bounds the rows per key; rows of other categories are left out.
    """
    keys = as_list(keys)
    # both branches ask for the values, so that Spark reuses one shuffle
    periods = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    names = F.array(*[F.lit(c) for c in categories])
    grid = periods.select(*keys, F.explode(names).alias(category))
    filled = null_safe_join(grid, df.select(*keys, category, value), [*keys, category], "left")
    return filled.select(*keys, category, F.coalesce(F.col(value), F.lit(fill)).alias(value))


def repeat_rows(df: DataFrame, freq: str) -> DataFrame:
    """Each row ``freq`` times, without the frequency column.

    A missing or negative count raises.  Statistics should use ``freq`` as a
    weight instead; this literal form is for exports and checks.
    """
    times = checked_frequency(freq)
    repeated = df.withColumn("__copy", F.explode(F.sequence(F.lit(0), times)))
    return repeated.where(F.col("__copy") > 0).drop("__copy", freq)


def checked_frequency(freq: str) -> Column:
    f = F.col(freq)
    return F.when(f >= 0, f).otherwise(
        F.raise_error(F.lit(f"{freq} must be a count of 0 or more")).cast("int")
    )


def split_id(
    df: DataFrame, column: str, into: Sequence[tuple[str, str]], separator: str = "-"
) -> DataFrame:
    """Replace a composite id by typed parts; parts that do not parse are NULL."""
    rest = [c for c in df.columns if c != column]
    names = [name for name, _ in into]
    # split once, then each text part once, before the parts are matched and cast
    pieces = df.withColumn("__parts", F.split(F.col(column), f"\\Q{separator}\\E"))
    text = pieces.select(*[F.nullif(F.get("__parts", F.lit(i)), F.lit("")).alias(f"__{n}") for i, n in enumerate(names)], *rest)
    return text.select(*[parsed(f"__{name}", kind).alias(name) for name, kind in into], *rest)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column."""
    floating = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(*[missing_as_null(c).alias(c) if c in floating else F.col(c) for c in df.columns])


def drop_index_column(df: DataFrame, names: Sequence[str] = ("", "_c0", "x", "1", "...1")) -> DataFrame:
    """Drop an unnamed leading index column, if the first column is one."""
    first = df.columns[0]
    return df.drop(first) if first.lower() in names else df


def align_series(left: DataFrame, right: DataFrame, date: str = "date") -> DataFrame:
    """Rows of both series on the dates they share, without missing values."""
    return left.join(right, date, "inner").na.drop("any")


def join_covariates(
    index: DataFrame, data: DataFrame, calendar: DataFrame, date: str = "date", calendar_date: str | None = None
) -> DataFrame:
    """Index series onto the data, then both onto the calendar that drives the rows."""
    other = calendar_date or date
    last = calendar.withColumnRenamed(other, date) if other != date else calendar
    return index.join(data, date, "right").join(last, date, "right")


def order_labels(df: DataFrame, label: str, value: str, rank: str = "rank") -> DataFrame:
    """Each label's position, from 1, in the order of a value; ties by label, missing values last.

    Labels are cut into ordered ranges first, so that no task ranks them all.
    """
    place = F.struct(F.col(value).isNull().alias("missing"), F.col(value).alias("value"), F.col(label).alias("label"))
    ranged = durable(df.withColumn("__place", place).repartitionByRange("__place").withColumn("__block", F.spark_partition_id()))
    return running_in_blocks(ranged, [], "__block", "__place", F.lit(1), rank).drop("__place", "__block")
