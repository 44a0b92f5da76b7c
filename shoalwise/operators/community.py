"""Richness, diversity, composition, occurrence, first and last years.

Every operator first reduces observations to one row per key and taxon.  That
aggregation combines on the map side and shuffles on key *and* taxon, so a key
that holds a third of all rows is spread over its taxa; the second aggregation
only sees partial results.  Wide sample-by-taxon tables are never built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwise.frames import as_list, attach, lookup
from shoalwise.functions.columns import sum_or_zero
from shoalwise.operators.reshape import zero_fill


def species_totals(
    obs: DataFrame, keys: str | Sequence[str], taxon: str = "taxon", value: str = "cpue"
) -> DataFrame:
    """Summed catch per key and taxon: the base of every community metric."""
    return obs.groupBy(*as_list(keys), taxon).agg(sum_or_zero(value).alias("n"))


def richness(
    obs: DataFrame,
    keys: str | Sequence[str],
    taxon: str = "taxon",
    value: str = "cpue",
    mode: str = "distinct",
    station: str = "station",
    drop_null_taxon: bool = False,
    min_cpue: float | None = None,
) -> DataFrame:
    """Number of taxa recorded per key.

    A recorded taxon counts even when its catch is 0, and a missing taxon code
    counts as one more taxon; ``drop_null_taxon`` and ``min_cpue`` (keep taxa
    whose summed catch is above it) change that.  ``mode='incidence'`` counts
    station x taxon pairs, as the regional series do.
    """
    if mode not in ("distinct", "incidence"):
        raise ValueError("mode must be 'distinct' or 'incidence'")
    keys = as_list(keys)
    unit = [taxon] if mode == "distinct" else [station, taxon]
    rows = obs.where(F.col(taxon).isNotNull()) if drop_null_taxon else obs
    if min_cpue is None:
        pairs = rows.select(*keys, *unit).distinct()
    else:
        pairs = (
            rows.groupBy(*keys, *unit).agg(sum_or_zero(value).alias("__n")).where(F.col("__n") > min_cpue)
        )
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("richness"))


def diversity(
    obs: DataFrame,
    keys: str | Sequence[str],
    taxon: str = "taxon",
    value: str = "cpue",
    drop_null_taxon: bool = False,
) -> DataFrame:
    """Recorded taxa, total catch, Shannon entropy and Simpson index per key.

    H = ln N - sum(n ln n) / N over n > 0, so one aggregate over the totals is
    enough: no pivot and no window.  A key whose total is 0 has H = 0.
    """
    keys = as_list(keys)
    rows = obs.where(F.col(taxon).isNotNull()) if drop_null_taxon else obs
    n = F.col("n")
    sums = (
        species_totals(rows, keys, taxon, value)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("taxa"),
            F.sum(n).alias("total"),
            sum_or_zero(F.when(n > 0, n * F.ln(n))).alias("__nlogn"),
            F.sum(n * n).alias("__n2"),
        )
    )
    total = F.col("total")
    return sums.select(
        *keys,
        "taxa",
        "total",
        F.when(total > 0, F.ln(total) - F.try_divide(F.col("__nlogn"), total)).otherwise(0.0).alias("shannon"),
        F.when(total > 0, 1 - F.try_divide(F.col("__n2"), total * total)).otherwise(1.0).alias("simpson"),
    )


def with_region(obs: DataFrame, region_map: DataFrame, station: str = "station") -> DataFrame:
    """Keep the observations of mapped stations and add their region."""
    return lookup(obs, region_map, station, "inner")


def regional_richness(
    obs: DataFrame,
    region_map: DataFrame,
    keys: str | Sequence[str] = "date",
    taxon: str = "taxon",
    station: str = "station",
    mode: str = "incidence",
    drop_null_taxon: bool = True,
    driver: str | None = None,
) -> DataFrame:
    """Station x taxon pairs (or distinct taxa) per region and key.

    Observations shrink to distinct pairs before the region lookup.  With
    ``driver`` only the keys that region has are kept for the other regions.
    """
    keys = as_list(keys)
    rows = obs.where(F.col(taxon).isNotNull()) if drop_null_taxon else obs
    pairs = rows.select(*keys, station, taxon).distinct()
    counted = richness(
        with_region(pairs, region_map, station), ["region", *keys], taxon, mode=mode, station=station
    )
    if driver is None:
        return counted
    wanted = counted.where(F.col("region") == driver).select(*keys)
    return counted.join(wanted, keys, "left_semi")


def regional_diversity(
    obs: DataFrame,
    region_map: DataFrame,
    keys: str | Sequence[str] = "date",
    taxon: str = "taxon",
    value: str = "cpue",
    station: str = "station",
    drop_null_taxon: bool = True,
) -> DataFrame:
    """Shannon and Simpson per region and key, from station totals."""
    keys = as_list(keys)
    rows = obs.where(F.col(taxon).isNotNull()) if drop_null_taxon else obs
    totals = species_totals(rows, [*keys, station], taxon, value)
    return diversity(with_region(totals, region_map, station), ["region", *keys], taxon, "n")


def composition(
    obs: DataFrame,
    keys: str | Sequence[str],
    category: str,
    value: str = "cpue",
    fill: bool = False,
    categories: Sequence | None = None,
) -> DataFrame:
    """Share of the summed catch per key that falls in each category.

    Shares are of the total over all categories; rows without a category are
    left out.  ``categories`` names those to report, and with ``fill`` each key
    gets all of them, absent ones with share 0.  A key whose total is 0 gets
    missing shares.
    """
    keys = as_list(keys)
    if fill and categories is None:
        raise ValueError("filling needs the list of categories")
    sums = obs.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(sum_or_zero(value).alias("__n"))
    totals = sums.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    if fill:
        sums = zero_fill(sums, keys, category, "__n", categories)
    elif categories is not None:
        sums = sums.where(F.col(category).isin(list(categories)))
    share = F.try_divide(F.col("__n"), F.col("__total"))
    return attach(sums, totals, keys).select(*keys, category, share.alias("share"))


def occurrence(
    obs: DataFrame,
    taxon: str = "taxon_name",
    year: str = "year",
    month: str = "month",
    value: str = "cpue",
    split_year: int = 1990,
    low: float = 0.05,
    high: float = 0.95,
    keys: str | Sequence[str] = (),
) -> DataFrame:
    """Share of sampled months with each taxon before and from ``split_year``.

    Both halves come from one pass.  A share outside the open band (low, high)
    is dropped; taxa are those whose late share survives, and the early share
    (hence the difference) is missing where it did not.
    """
    keys = as_list(keys)
    months = obs.groupBy(*keys, taxon, year, month).agg(sum_or_zero(value).alias("__n"))
    early = F.col(year) < split_year
    # asking for the sum keeps this branch on the same shuffle as the next one
    sampled = (
        months.groupBy(*keys, year, month)
        .agg(F.sum("__n").alias("__n"))
        .where(F.col("__n").isNotNull())
        .groupBy(*keys)
        .agg(F.count_if(early).alias("__early_months"), F.count_if(~early).alias("__late_months"))
    )
    present = months.groupBy(*keys, taxon).agg(
        F.count_if(early & (F.col("__n") > 0)).alias("__early"),
        F.count_if(~early & (F.col("__n") > 0)).alias("__late"),
    )
    shares = attach(present, sampled, keys).select(
        *keys,
        taxon,
        F.try_divide(F.col("__early"), F.col("__early_months")).alias("__pe"),
        F.try_divide(F.col("__late"), F.col("__late_months")).alias("prop_late"),
    )
    in_band = (F.col("__pe") > low) & (F.col("__pe") < high)
    return (
        shares.where((F.col("prop_late") > low) & (F.col("prop_late") < high))
        .withColumn("prop_early", F.when(in_band, F.col("__pe")))
        .select(*keys, taxon, "prop_early", "prop_late", (F.col("prop_late") - F.col("prop_early")).alias("diff"))
    )


def turnover_years(
    obs: DataFrame,
    taxon: str = "taxon_name",
    year: str = "year",
    kind: str = "first",
    beyond: int | None = None,
    trim: int | None = None,
    fill_zero: bool = False,
    keys: str | Sequence[str] = (),
) -> DataFrame:
    """Number of taxa first (or last) recorded in each year.

    ``beyond`` drops taxa at the edge of the record (first year not after it,
    or last year not before it); ``trim`` drops years of the count table the
    same way.  Years without any taxon have no row unless ``fill_zero``.
    """
    if kind not in ("first", "last"):
        raise ValueError("kind must be 'first' or 'last'")
    keys = as_list(keys)

    def inside(edge: int | None) -> Column:
        if edge is None:
            return F.lit(True)
        return F.col(year) > edge if kind == "first" else F.col(year) < edge

    pick = F.min if kind == "first" else F.max
    ends = obs.groupBy(*keys, taxon).agg(pick(year).alias(year)).where(inside(beyond))
    counts = ends.groupBy(*keys, year).agg(F.count(F.lit(1)).alias("n")).where(inside(trim))
    if not fill_zero:
        return counts
    span = counts.groupBy(*keys).agg(F.min(year).alias("__lo"), F.max(year).alias("__hi"))
    years = span.where(F.col("__lo").isNotNull()).select(
        *keys, F.explode(F.sequence("__lo", "__hi")).alias(year)
    )
    return years.join(counts, [*keys, year], "left").na.fill(0, ["n"])


def turnover_rate(counts: DataFrame, keys: str | Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of the yearly counts."""
    return counts.groupBy(*as_list(keys)).agg(
        F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.count(F.lit(1)).alias("years")
    )
