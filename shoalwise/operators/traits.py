"""Trait, latitude and length series: means over taxa, each taxon once per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwise.frames import as_list, lookup
from shoalwise.functions.columns import first_match_prefix, mid_point, standard_error
from shoalwise.operators.reshape import checked_frequency


def mean_and_error(
    df: DataFrame, keys: str | Sequence[str], columns: Sequence[str], name: str = "trait", n_valid: bool = False
) -> DataFrame:
    """Mean, SE and row count of several columns per key, one row per column."""
    keys = as_list(keys)
    stats = [
        F.struct(
            F.lit(c).alias(name), F.avg(c).alias("mean"), standard_error(c, n_valid).alias("se")
        )
        for c in columns
    ]
    wide = df.groupBy(*keys).agg(F.array(*stats).alias("__s"), F.count(F.lit(1)).alias("n"))
    return wide.select(*keys, F.inline("__s"), "n")


def trait_trend(
    obs: DataFrame,
    traits: DataFrame,
    columns: str | Sequence[str],
    keys: str | Sequence[str] = "year",
    taxon: str = "taxon_name",
    derived: Mapping[str, Column] | None = None,
    require: str | None = None,
    n_valid: bool = False,
) -> DataFrame:
    """Mean and SE over taxa of each trait per key; taxa are not weighted.

    Observations shrink to distinct key x taxon pairs before the lookup, and
    all traits share that one pass.  ``derived`` adds columns computed from the
    traits.  ``require`` leaves out taxa that lack that trait; otherwise a taxon
    with a missing trait still counts in the SE's denominator.
    """
    keys = as_list(keys)
    derived = dict(derived or {})
    named = traits.select(F.col(taxon), *[F.col(c).cast("double").alias(c) for c in as_list(columns)])
    rows = lookup(obs.select(*keys, taxon).distinct(), named, taxon)
    if derived:
        rows = rows.withColumns(derived)
    if require is not None:
        rows = rows.where(F.col(require).isNotNull())
    return mean_and_error(rows, keys, [*as_list(columns), *derived], n_valid=n_valid)


def latitude_trend(
    obs: DataFrame,
    ranges: DataFrame,
    keys: str | Sequence[str] = "year",
    taxon: str = "taxon_name",
    lower: str = "lower_lat",
    upper: str = "upper_lat",
) -> DataFrame:
    """Mean and SE of lower, middle and upper latitude of the taxa per key."""
    return trait_trend(
        obs, ranges, [lower, upper], keys, taxon, derived={"mid_lat": mid_point(lower, upper)}
    )


def length_distribution(
    lengths: DataFrame,
    keys: str | Sequence[str] = ("year", "taxon_name"),
    length: str = "length",
    freq: str = "freq",
    sentinel: float = 999.0,
    keep_freq: bool = False,
) -> DataFrame:
    """Frequency-weighted mean length per key; with ``keep_freq`` also the summed frequency.

    Lengths at or above the sentinel are missing.  The frequency is a weight;
    rows are not repeated.
    """
    times = checked_frequency(freq).cast("double")
    valid = lengths.where(F.col(length) < sentinel).withColumn("__f", times).where(F.col("__f") > 0)
    total = [F.sum("__f").cast("long").alias(freq)] if keep_freq else []
    return valid.groupBy(*as_list(keys)).agg(
        F.try_divide(F.sum(F.col(length) * F.col("__f")), F.sum("__f")).alias("length"), *total
    )


def length_trend(
    lengths: DataFrame,
    year: str = "year",
    taxon: str = "taxon_name",
    length: str = "length",
    freq: str = "freq",
    sentinel: float = 999.0,
    keys: str | Sequence[str] = (),
) -> DataFrame:
    """Mean and SE over taxa of their mean length, per year."""
    keys = [*as_list(keys), year]
    stage = length_distribution(lengths, [*keys, taxon], length, freq, sentinel)
    return mean_and_error(stage, keys, ["length"])


def mean_log_length(distribution: DataFrame, keys: str | Sequence[str] = "year") -> DataFrame:
    """Mean of ln(length) over the rows of a length distribution."""
    return distribution.groupBy(*as_list(keys)).agg(F.avg(F.ln("length")).alias("mean_log_length"))


def split_metric_names(wide: DataFrame, ids: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``mean.x`` and ``se.x`` columns to rows with the metric x, its mean and SE."""
    ids = as_list(ids)
    quoted = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    entries = F.array(
        *[F.struct(F.lit(c).alias("__name"), F.col(f"`{c}`").alias("__value")) for c in columns]
    )
    long = quoted.select(*ids, F.inline(entries))
    statistic = F.when(F.col("__name").startswith("mean."), "mean").when(F.col("__name").startswith("se."), "se")
    return (
        long.withColumns({"metric": first_match_prefix("__name"), "__statistic": statistic})
        .groupBy(*ids, "metric")
        .pivot("__statistic", ["mean", "se"])
        .agg(F.first("__value"))
    )


def metric_panel(
    frames: Sequence[DataFrame], labels: Mapping[str, str], keys: str | Sequence[str] = "year", name: str = "trait"
) -> DataFrame:
    """Stack metric series and add the group label of each metric."""
    keys = as_list(keys)
    parts = [f.select(*keys, F.col(name).alias("metric"), "mean", "se") for f in frames]
    long = reduce(lambda a, b: a.unionByName(b), parts)
    label = F.lit(None).cast("string")
    for metric, group in labels.items():
        label = F.when(F.col("metric") == metric, group).otherwise(label)
    return long.select(*keys, label.alias("group"), "metric", "mean", "se")


def error_bars(df: DataFrame, mean: str = "mean", se: str = "se") -> DataFrame:
    """Mean minus and plus one SE."""
    return df.withColumns({"lower": F.col(mean) - F.col(se), "upper": F.col(mean) + F.col(se)})
