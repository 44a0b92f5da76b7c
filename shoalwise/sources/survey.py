"""Canonical tables from the raw files of the two trawl surveys.

Column names on the left of each rename are the raw names in snake case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwise.frames import lookup
from shoalwise.functions.columns import month_start, parsed
from shoalwise.operators.reshape import drop_index_column, split_id
from shoalwise.sources.files import read_table

# Groups that count as fish, the trait columns, and the stations
# of the three bay regions.
FISH_GROUPS = ("Fin Fish", "Cartilaginous Fish")
TRAIT_COLUMNS = (
    "trophic_level",
    "temp_mean",
    "temp_max",
    "temp_min",
    "upper_lat",
    "lower_lat",
    "longevity",
    "generation_time",
    "maturity",
    "k",
    "r",
)
BAY_REGIONS = {
    "Upper Bay": (80, 81, 91, 92, 93, 94, 95, 96),
    "Mid Bay": (7, 8, 10, 11, 13, 14, 16, 20, 22, 25, 26, 32, 83, 85, 86, 87, 88, 99),
    "Lower Bay": (17, 21, 33, 40, 41, 48, 49, 55, 56, 61, 62, 63, 64, 90),
}

MEASUREMENTS = ("bottom_temp", "surface_temp", "bottom_sal", "surface_sal", "bottom_do", "surface_do")

OBSERVATION_COLUMNS = (
    "survey", "sample_id", "date", "year", "month", "station", "taxon", "taxon_name", "grp", "cpue",
)


def region_map(spark: SparkSession) -> DataFrame:
    """Station to bay region."""
    rows = [(s, region) for region, stations in BAY_REGIONS.items() for s in stations]
    return spark.createDataFrame(rows, "station int, region string")


def fish(obs: DataFrame, group: str = "grp") -> DataFrame:
    return obs.where(F.col(group).isin(*FISH_GROUPS))


def _canonical(df: DataFrame, survey: str) -> DataFrame:
    dated = df.withColumns({"survey": F.lit(survey), "date": month_start("year", "month")})
    return dated.select(*OBSERVATION_COLUMNS)


def observations_30(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Observations of the 30-foot survey."""
    schema = {
        "sample_id": "string", "year": "int", "month": "int", "taxon": "string",
        "taxon_name": "string", "grp": "string", "cpue": "double",
    }
    renames = {"trawl": "sample_id", "species_code": "taxon", "common_name": "taxon_name", "group": "grp"}
    raw = read_table(spark, path, schema, fmt, renames)
    return _canonical(raw.withColumn("station", F.lit(None).cast("int")), "30-foot")


def environment_30(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Measurements of the 30-foot survey, as recorded on each row."""
    schema = {"sample_id": "string", "year": "int", "month": "int", **dict.fromkeys(MEASUREMENTS, "double")}
    return read_table(spark, path, schema, fmt, {"trawl": "sample_id"}).withColumn("survey", F.lit("30-foot"))


def observations_16(spark: SparkSession, path: str, groups_path: str, fmt: str = "csv") -> DataFrame:
    """Observations of the 16-foot survey with their species group."""
    schema = {
        "sample_id": "string", "year": "int", "month": "int", "station": "int", "taxon": "string",
        "taxon_name": "string", "cpue": "double",
    }
    renames = {"trawl": "sample_id", "year4": "year", "spec_code": "taxon", "common_name": "taxon_name"}
    groups = read_table(
        spark, groups_path, {"taxon_name": "string", "grp": "string"}, fmt,
        {"common_name": "taxon_name", "group": "grp"},
    )
    return _canonical(lookup(read_table(spark, path, schema, fmt, renames), groups, "taxon_name"), "16-foot")


def traits(spark: SparkSession, path: str, survey: str, fmt: str = "csv") -> DataFrame:
    """One row per species; trait columns a file lacks are NULL, empty text is missing."""
    raw = read_table(spark, path, None, fmt)
    habit = "feeding_habit2" if "feeding_habit2" in raw.columns else "feeding_habit"
    raw = raw.drop("feeding_habit") if habit == "feeding_habit2" else raw
    raw = raw.withColumnsRenamed(
        {
            "common_name": "taxon_name",
            "group": "grp",
            "upperlat": "upper_lat",
            "lowerlat": "lower_lat",
            habit: "feeding_habit",
        }
    )

    def text(c: str):
        value = F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None)
        return value.cast("string").alias(c)

    def number(c: str):
        value = parsed(F.col(c).cast("string"), "double") if c in raw.columns else F.lit(None).cast("double")
        return F.when(~F.isnan(value), value).alias(c)

    return raw.select(
        F.lit(survey).alias("survey"),
        text("taxon_name"), text("grp"), text("environment"), text("feeding_habit"),
        *[number(c) for c in TRAIT_COLUMNS],
    )


def species_ranges(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Latitude limits per species; the file's unnamed index column is dropped."""
    raw = drop_index_column(read_table(spark, path, None, fmt))
    return raw.select(
        F.col("common_name").alias("taxon_name"),
        parsed(F.col("upperlat").cast("string"), "double").alias("upper_lat"),
        parsed(F.col("lowerlat").cast("string"), "double").alias("lower_lat"),
    )


def lengths_30(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Length frequencies whose year is the first part of the tow id."""
    schema = {"sample_id": "string", "taxon": "string", "length": "double", "freq": "int"}
    raw = read_table(spark, path, schema, fmt, {"trawl": "sample_id", "spec_code": "taxon"})
    parts = [("year", "int"), ("month", "int"), ("day", "int"), ("time", "string"), ("station", "string")]
    kept = raw.withColumn("tow", F.col("sample_id"))
    return split_id(kept, "tow", parts).select("sample_id", "year", "taxon", "length", "freq")


def lengths_16(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Length frequencies of the 16-foot survey; numeric species codes become text."""
    schema = {"taxon": "double", "year": "int", "length": "double", "freq": "int"}
    raw = read_table(spark, path, schema, fmt, {"spec_code": "taxon"})
    whole = F.col("taxon") == F.floor("taxon")
    code = F.when(whole, F.col("taxon").try_cast("bigint").cast("string")).otherwise(F.col("taxon").cast("string"))
    return raw.select(F.lit(None).cast("string").alias("sample_id"), "year", code.alias("taxon"), "length", "freq")


def species_list(obs: DataFrame) -> DataFrame:
    """Distinct species codes with name and group, for joins with lengths."""
    return obs.select("taxon", "taxon_name", "grp").distinct()


def fish_lengths(lengths: DataFrame, species: DataFrame) -> DataFrame:
    """Lengths of named fish species."""
    named = fish(species.where(F.col("taxon_name").isNotNull()))
    return lengths.join(named, "taxon", "inner")


def bay_regions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The wide regional file as rows of date, region, metric type and value."""
    raw = read_table(spark, path, None, fmt)
    columns = [c for c in raw.columns if c != "date"]
    entry = F.array(*[F.struct(F.lit(c).alias("metric"), parsed(F.col(c).cast("string"), "double").alias("value")) for c in columns])
    # Metric suffixes and region prefixes of the file.
    kind = (
        F.when(F.col("metric").endswith("shann"), "Diversity")
        .when(F.col("metric").endswith("simp"), "Simpson")
        .otherwise("Richness")
    )
    region = (
        F.when(F.col("metric").startswith("upper"), "Upper Bay")
        .when(F.col("metric").startswith("mid"), "Mid Bay")
        .when(F.col("metric").startswith("lower"), "Lower Bay")
    )
    return raw.select(F.col("date").try_cast("date").alias("date"), F.inline(entry)).withColumns(
        {"region": region, "type": kind, "value": F.when(~F.isnan("value"), F.col("value"))}
    )


def covariate(spark: SparkSession, path: str, columns: list[str], date: str = "date", fmt: str = "csv") -> DataFrame:
    """Dated index columns (stock index, climate) in long form: date, name, value."""
    schema = {date: "date", **dict.fromkeys(columns, "double")}
    wide = read_table(spark, path, schema, fmt).withColumnRenamed(date, "date")
    return wide.unpivot(["date"], columns, "name", "value")
