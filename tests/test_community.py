from __future__ import annotations

import datetime as dt
import math
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shoalwise import operators as op
from shoalwise.functions import season

D = dt.date
OBS = "survey string, station int, date date, year int, month int, taxon string, cpue double"


def obs(spark, data):
    return spark.createDataFrame(
        [(s, st, D(y, m, 1), y, m, t, c) for s, st, y, m, t, c in data], OBS
    )


@pytest.fixture(scope="module")
def tiny(spark):
    """Two surveys, one month absent, a null taxon, a zero catch and a null catch."""
    return obs(
        spark,
        [
            ("a", 1, 2000, 1, "x", 4.0), ("a", 1, 2000, 1, "x", 4.0), ("a", 1, 2000, 1, "y", 8.0),
            ("a", 2, 2000, 1, None, 1.0), ("a", 2, 2000, 2, "z", 0.0), ("a", 2, 2000, 2, "y", None),
            ("a", 1, 2000, 4, "x", 5.0), ("a", 2, 2000, 4, "x", 5.0),
            ("b", 3, 2000, 1, "x", 1.0), ("b", 3, 2000, 2, "y", 1.0), ("b", 3, 2000, 2, "z", 3.0),
        ],
    )


def test_species_totals_null_sums_to_zero(tiny, rows):
    got = rows(op.species_totals(tiny.where("survey = 'a'"), "date"), "date", "taxon", "n")
    assert (D(2000, 2, 1), "y", 0.0) in got
    assert (D(2000, 1, 1), "x", 8.0) in got


def test_richness_counts_null_and_zero_taxa(tiny, rows):
    got = rows(op.richness(tiny, ["survey", "date"]), "survey", "date", "richness")
    assert got == [
        ("a", D(2000, 1, 1), 3), ("a", D(2000, 2, 1), 2), ("a", D(2000, 4, 1), 1),
        ("b", D(2000, 1, 1), 1), ("b", D(2000, 2, 1), 2),
    ]


def test_richness_options(tiny, rows):
    first = tiny.where("survey = 'a' and month < 3")
    assert rows(op.richness(first, "month", drop_null_taxon=True), "month", "richness") == [(1, 2), (2, 2)]
    assert rows(op.richness(first, "month", min_cpue=0), "month", "richness") == [(1, 3)]
    april = tiny.where("survey = 'a' and month = 4")
    assert rows(op.richness(april, "month", mode="incidence"), "richness") == [(2,)]


def test_calendar_fills_each_key(tiny, rows):
    filled = op.complete_calendar(op.richness(tiny, ["survey", "date"]), keys=["survey"])
    assert rows(filled, "survey", "date", "richness") == [
        ("a", D(2000, 1, 1), 3), ("a", D(2000, 2, 1), 2), ("a", D(2000, 3, 1), None), ("a", D(2000, 4, 1), 1),
        ("b", D(2000, 1, 1), 1), ("b", D(2000, 2, 1), 2),
    ]
    assert filled.columns == ["survey", "date", "richness"]


def test_calendar_without_keys_and_day_step(spark, rows):
    df = spark.createDataFrame([(D(2000, 2, 28), 1), (D(2000, 3, 2), 2)], "date date, v int")
    assert rows(op.complete_calendar(df, step="day"), "date", "v") == [
        (D(2000, 2, 28), 1), (D(2000, 2, 29), None), (D(2000, 3, 1), None), (D(2000, 3, 2), 2)
    ]
    month_ends = spark.createDataFrame([(D(2000, 1, 1), 1), (D(2000, 12, 1), 2)], "date date, v int")
    assert op.complete_calendar(month_ends).count() == 12
    with pytest.raises(ValueError):
        op.complete_calendar(df, step="fortnight")


def test_diversity_by_hand(tiny):
    r = {x["month"]: x for x in op.diversity(tiny.where("survey = 'a'"), "month").collect()}
    shares = [8 / 17, 8 / 17, 1 / 17]
    assert r[1]["shannon"] == pytest.approx(-sum(p * math.log(p) for p in shares))
    assert r[1]["simpson"] == pytest.approx(1 - sum(p * p for p in shares))
    assert (r[2]["total"], r[2]["shannon"]) == (0.0, 0.0)
    assert r[4]["shannon"] == pytest.approx(0.0)
    assert r[1]["taxa"] == 3


def test_seasons_keep_december_in_its_year(spark, rows):
    data = obs(spark, [("a", 1, y, m, f"t{m}", 1.0) for y, m in ((2000, 11), (2000, 12), (2001, 1), (2001, 2))])
    by = op.richness(data.withColumn("season", season("month")), ["year", "season"])
    assert rows(by, "year", "season", "richness") == [(2000, "Fall", 1), (2000, "Winter", 1), (2001, "Winter", 2)]


@pytest.fixture(scope="module")
def regional(spark):
    data = obs(
        spark,
        [
            ("a", 1, 2000, 1, "x", 1.0), ("a", 2, 2000, 1, "x", 3.0), ("a", 2, 2000, 1, "y", 4.0),
            ("a", 3, 2000, 1, "x", 1.0), ("a", 3, 2000, 2, "y", 1.0), ("a", 4, 2000, 2, "x", 2.0),
            ("a", 4, 2000, 2, None, 2.0), ("a", 9, 2000, 2, "x", 2.0),
        ],
    )
    areas = spark.createDataFrame([(1, "up"), (2, "up"), (3, "mid"), (4, "low")], "station int, region string")
    return data, areas


def test_regional_richness_counts_station_taxon_pairs(regional, rows):
    data, areas = regional
    got = rows(op.regional_richness(data, areas), "region", "date", "richness")
    assert got == [
        ("low", D(2000, 2, 1), 1), ("mid", D(2000, 1, 1), 1), ("mid", D(2000, 2, 1), 1), ("up", D(2000, 1, 1), 3)
    ]
    distinct = op.regional_richness(data, areas, mode="distinct")
    assert ("up", D(2000, 1, 1), 2) in rows(distinct, "region", "date", "richness")
    driven = op.regional_richness(data, areas, driver="up")
    assert {r[1] for r in rows(driven, "region", "date")} == {D(2000, 1, 1)}


def test_regional_diversity(regional):
    data, areas = regional
    r = op.regional_diversity(data, areas).where("region = 'up'").first()
    assert r["shannon"] == pytest.approx(math.log(2))


def test_duplicate_region_key_raises(regional, spark):
    data, areas = regional
    twice = areas.union(spark.createDataFrame([(1, "mid")], areas.schema))
    with pytest.raises(PySparkException, match="not unique"):
        op.regional_diversity(data, twice).collect()


def test_composition_fills_absent_categories(spark, rows):
    data = spark.createDataFrame(
        [(2000, "p", 3.0), (2000, "q", 1.0), (2001, "p", 2.0), (2001, "r", 2.0), (2001, None, 9.0)],
        "year int, habitat string, cpue double",
    )
    got = rows(op.composition(data, "year", "habitat", fill=True, categories=("p", "q", "r")), "year", "habitat", "share")
    assert got == [
        (2000, "p", 0.75), (2000, "q", 0.25), (2000, "r", 0.0), (2001, "p", 0.5), (2001, "q", 0.0), (2001, "r", 0.5)
    ]
    assert op.composition(data, "year", "habitat").count() == 4
    with pytest.raises(ValueError, match="list of categories"):
        op.composition(data, "year", "habitat", fill=True)


def test_composition_keeps_unlisted_categories_in_the_total(spark, rows):
    data = spark.createDataFrame([(2000, "p", 3.0), (2000, "new", 1.0)], "year int, habitat string, cpue double")
    assert rows(op.composition(data, "year", "habitat", categories=("p", "q")), "habitat", "share") == [("p", 0.75)]
    filled = op.composition(data, "year", "habitat", fill=True, categories=("p", "q"))
    assert rows(filled, "habitat", "share") == [("p", 0.75), ("q", 0.0)]


def test_composition_zero_total_is_missing(spark, rows):
    data = spark.createDataFrame([(2000, "p", 0.0), (2001, "q", 1.0)], "year int, habitat string, cpue double")
    got = rows(op.composition(data, "year", "habitat", fill=True, categories=("p", "q")), "year", "habitat", "share")
    assert got == [(2000, "p", None), (2000, "q", None), (2001, "p", 0.0), (2001, "q", 1.0)]


def test_occurrence_band_and_right_join(spark, rows):
    data = []
    for m in range(1, 11):
        data.append(("a", 1, 1980, m, "always", 1.0))
        data.append(("a", 1, 2000, m, "always", 1.0))
    data += [("a", 1, 2000, m, "late", 1.0) for m in range(1, 6)]
    data += [("a", 1, 1980, m, "both", 1.0) for m in range(1, 3)] + [("a", 1, 2000, m, "both", 1.0) for m in range(1, 5)]
    data += [("a", 1, 1980, 1, "early", 1.0), ("a", 1, 2000, 1, "zero", 0.0)]
    got = rows(
        op.occurrence(obs(spark, data).withColumnRenamed("taxon", "taxon_name")),
        "taxon_name", "prop_early", "prop_late", "diff",
    )
    assert got == [("both", 0.2, 0.4, pytest.approx(0.2)), ("late", None, 0.5, None)]


def test_turnover_years(spark, rows):
    data = [("a", 1, y, 1, t, 1.0) for t, ys in {
        "p": (1966, 2019), "q": (1970, 1990), "r": (1972, 2010), "s": (1972, 2000), "t": (1975, 1990), "u": (1975, 1990),
    }.items() for y in ys]
    df = obs(spark, data)
    first = op.turnover_years(df, "taxon", beyond=1966, trim=1970)
    assert rows(first, "year", "n") == [(1972, 2), (1975, 2)]
    last = op.turnover_years(df, "taxon", kind="last", beyond=2018, trim=2005)
    assert rows(last, "year", "n") == [(1990, 3), (2000, 1)]
    filled = op.turnover_years(df, "taxon", beyond=1966, trim=1970, fill_zero=True)
    assert rows(filled, "year", "n") == [(1972, 2), (1973, 0), (1974, 0), (1975, 2)]
    rate = op.turnover_rate(last).first()
    assert (rate["mean"], rate["sd"]) == (2.0, pytest.approx(math.sqrt(2)))


def test_partitioning_does_not_change_results(tiny, rows):
    whole = op.diversity(tiny, ["survey", "date"])
    spread = op.diversity(tiny.repartition(7), ["survey", "date"])
    columns = ("survey", "date", "taxa", "total")
    assert rows(whole, *columns) == rows(spread, *columns)


def test_hot_key_is_spread_over_taxa(spark):
    """Richness of one dominant key must shuffle on key and taxon first."""
    hot = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20))
    df = spark.range(1200).select(hot.alias("key"), (F.col("id") % 50).cast("string").alias("taxon"), F.lit(1.0).alias("cpue"))
    out = op.diversity(df, "key")
    assert {r["key"]: r["taxa"] for r in out.collect()}["hot"] == 50
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().executedPlan().toString())
    assert any("key" in s and "taxon" in s for s in shuffles)
