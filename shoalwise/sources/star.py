"""The supplied star-schema tables read as survey data.

A line item is an observation: the order is the sample, the supplier the
station, the part the taxon and the quantity the catch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwise.frames import lookup
from shoalwise.functions.columns import month_start
from shoalwise.operators.community import species_totals
from shoalwise.operators.traits import length_distribution

# Part types standing in for fish groups.
FISH_TYPES = ("SMALL", "STANDARD")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("survey"),
        F.col("l_orderkey").alias("sample_id"),
        F.trunc(day, "month").alias("date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.col("l_suppkey").alias("station"),
        F.col("l_partkey").alias("taxon"),
        F.col("l_quantity").alias("cpue"),
    )


def species(spark: SparkSession, folder: str) -> DataFrame:
    """Name and group per taxon."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("taxon"), F.col("p_name").alias("taxon_name"), F.col("p_type").alias("grp")
    )


def named_totals(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Catch per key and taxon with the taxon's name and group.

    Observations are summed before the lookup, so the join moves one row per
    key and taxon and a dominant taxon is no heavier than any other.
    """
    totals = species_totals(observations(spark, folder), keys).withColumnRenamed("n", "cpue")
    return lookup(totals, species(spark, folder), "taxon")


def station_regions(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("station"), F.col("r_name").alias("region"))
    )


def traits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per species name."""
    return (
        table(spark, folder, "part")
        .groupBy(F.col("p_name").alias("taxon_name"))
        .agg(
            F.avg("p_size").alias("trophic_level"),
            F.avg("p_retailprice").alias("temp_mean"),
            F.min("p_retailprice").alias("lower_lat"),
            F.max("p_retailprice").alias("upper_lat"),
            F.min("p_type").alias("environment"),
        )
    )


def part_types(spark: SparkSession, folder: str) -> list[str]:
    """The groups of the species list: a vocabulary, one column or one row per key each."""
    found = table(spark, folder, "part").select("p_type").where("p_type IS NOT NULL").distinct().collect()
    return sorted(r["p_type"] for r in found)


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    return table(spark, folder, "lineitem").select(
        F.year(day).alias("year"),
        F.col("l_partkey").alias("taxon"),
        (F.col("l_extendedprice") / 100).alias("length"),
        F.col("l_linenumber").alias("freq"),
    )


def named_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Mean length and summed frequency per year and taxon, with the taxon's name and group.

    Lengths are reduced before the lookup, so the join moves one row per year
    and taxon; taxa outside the species list are dropped.
    """
    reduced = length_distribution(lengths(spark, folder), ["year", "taxon"], keep_freq=True)
    return lookup(reduced, species(spark, folder), "taxon", "inner")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        day.alias("day"),
        month_start(F.year(day), F.month(day)).alias("date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        (F.col("o_totalprice") / 100).alias("price"),
        F.col("o_orderstatus").alias("status"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("ts").cast("date").alias("date"), "event_type", "value")


def water(spark: SparkSession, folder: str) -> DataFrame:
    """Oxygen, temperature and salinity in plausible ranges from line items."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, folder, "lineitem").select(
        F.trunc(day, "month").alias("date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        (F.col("l_quantity") / 2).alias("bottom_temp"),
        (F.col("l_linenumber") * 4.0).alias("bottom_sal"),
        (F.col("l_discount") * 100 + 2).alias("bottom_do"),
    )
