"""Reading survey files into declared types, and writing results."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwise.functions.columns import missing_as_null, parsed
from shoalwise.operators.reshape import nan_to_null


def snake_case(name: str) -> str:
    """Column names as lower case words joined by underscores."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    return re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()


def normalise_names(df: DataFrame) -> DataFrame:
    names, seen = [], {}
    for c in df.columns:
        base = snake_case(c) or "unnamed"
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def read_table(
    spark: SparkSession,
    path: str,
    schema: Mapping[str, str] | None = None,
    fmt: str = "csv",
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read CSV or Parquet with snake-case names and missing values as NULL.

    ``columns`` renames source columns (after snake-casing) and ``schema`` gives
    the wanted columns and their types.  Types are never guessed; a value that
    does not parse becomes NULL.  Only the wanted columns are read.
    """
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, inferSchema=False, nullValue="NA", enforceSchema=False)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
    named = normalise_names(raw).withColumnsRenamed(dict(columns or {}))
    if schema is None:
        return nan_to_null(named)
    missing = [c for c in schema if c not in named.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    out, found = [], dict(named.dtypes)
    for name, kind in schema.items():
        typed = parsed(name, kind) if found[name] == "string" else F.col(name).try_cast(kind)
        out.append((missing_as_null(typed) if kind in ("double", "float") else typed).alias(name))
    return named.select(*out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Write a result; partitioning by year lets later reads skip years."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
