"""Means of environmental measurements by calendar key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwise.frames import as_list
from shoalwise.functions.columns import missing_as_null, oxygen_percent


def environment_means(
    env: DataFrame, keys: str | Sequence[str], columns: str | Sequence[str]
) -> DataFrame:
    """Mean of each column per key; NaN counts as missing, all-missing gives NULL."""
    return env.groupBy(*as_list(keys)).agg(
        *[F.avg(missing_as_null(F.col(c).cast("double"))).alias(c) for c in as_list(columns)]
    )


def with_oxygen_percent(
    env: DataFrame, layers: Sequence[str] = ("bottom", "surface"), pressure: float = 1.013253
) -> DataFrame:
    """Add ``<layer>_do_sat`` from the layer's oxygen, temperature and salinity."""
    added = {
        f"{layer}_do_sat": oxygen_percent(f"{layer}_do", f"{layer}_temp", f"{layer}_sal", pressure)
        for layer in layers
    }
    return env.withColumns(added)
