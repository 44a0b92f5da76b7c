from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shoalwise import operators as op
from shoalwise.functions import harmonic_terms, log_factorial, oxygen_percent, oxygen_saturation, presence
from shoalwise.sources import normalise_names, read_table, snake_case, survey, write_table


def test_trait_trend_counts_missing_traits_in_the_error(spark):
    obs = spark.createDataFrame([(2000, t) for t in "aabbc"], "year int, taxon_name string")
    traits = spark.createDataFrame([("a", 2.0, 10.0), ("b", 4.0, 20.0), ("c", None, 60.0)], "taxon_name string, tl double, temp double")
    r = {x["trait"]: x for x in op.trait_trend(obs, traits, ["tl", "temp"]).collect()}
    assert (r["tl"]["mean"], r["tl"]["n"]) == (3.0, 3)
    assert r["tl"]["se"] == pytest.approx(math.sqrt(2) / math.sqrt(3))
    assert r["temp"]["mean"] == pytest.approx(30.0)
    valid = op.trait_trend(obs, traits, ["tl"], n_valid=True).first()
    assert valid["se"] == pytest.approx(math.sqrt(2) / math.sqrt(2))
    required = {x["trait"]: x for x in op.trait_trend(obs, traits, ["tl", "temp"], require="tl").collect()}
    assert (required["temp"]["mean"], required["temp"]["n"]) == (15.0, 2)


def test_latitude_trend(spark):
    obs = spark.createDataFrame([(2000, "a"), (2000, "b"), (2000, "a")], "year int, taxon_name string")
    ranges = spark.createDataFrame([("a", 40.0, 20.0), ("b", 50.0, 40.0)], "taxon_name string, upper_lat double, lower_lat double")
    r = {x["trait"]: x["mean"] for x in op.latitude_trend(obs, ranges).collect()}
    assert r == {"lower_lat": 30.0, "upper_lat": 45.0, "mid_lat": 37.5}


@pytest.fixture(scope="module")
def lengths(spark):
    data = [
        (2000, "a", 10.0, 1), (2000, "a", 20.0, 3), (2000, "a", 999.0, 5), (2000, "b", None, 2), (2000, "b", 30.0, 2),
        (2000, "b", 90.0, 0), (2001, "a", 40.0, 1),
    ]
    return spark.createDataFrame(data, "year int, taxon_name string, length double, freq int")


def test_length_trend_weights_and_sentinel(lengths, rows):
    got = op.length_trend(lengths).where("year = 2000").first()
    assert got["mean"] == pytest.approx((17.5 + 30.0) / 2)
    assert got["se"] == pytest.approx(abs(17.5 - 30.0) / math.sqrt(2) / math.sqrt(2))
    stage = op.length_distribution(lengths)
    assert rows(stage, "year", "taxon_name", "length") == [(2000, "a", 17.5), (2000, "b", 30.0), (2001, "a", 40.0)]
    logs = dict(rows(op.mean_log_length(stage), "year", "mean_log_length"))
    assert logs[2000] == pytest.approx((math.log(17.5) + math.log(30)) / 2)


def test_weights_equal_repeated_rows(lengths, rows):
    valid = lengths.where("length < 999")
    literal = op.repeat_rows(valid, "freq")
    assert literal.count() == 7 and "freq" not in literal.columns
    got = literal.groupBy("year", "taxon_name").agg(F.avg("length").alias("length"))
    assert rows(got, "year", "taxon_name", "length") == rows(op.length_distribution(lengths), "year", "taxon_name", "length")


@pytest.mark.parametrize("freq", [-1, None])
def test_bad_frequency_raises(spark, freq):
    bad = spark.createDataFrame([(2000, "a", 10.0, freq)], "year int, taxon_name string, length double, freq int")
    with pytest.raises(PySparkException, match="count of 0 or more"):
        op.length_trend(bad).collect()
    with pytest.raises(PySparkException, match="count of 0 or more"):
        op.repeat_rows(bad, "freq").collect()


def test_split_id_keeps_malformed_ids_as_missing(spark, rows):
    df = spark.createDataFrame([("1999-4-2-0830-12", 1), ("bad", 2), ("2000-x-1--7", 3)], "tow string, v int")
    into = [("year", "int"), ("month", "int"), ("day", "int"), ("time", "string"), ("station", "int")]
    got = rows(op.split_id(df, "tow", into), "v", "year", "month", "time", "station")
    assert got == [(1, 1999, 4, "0830", 12), (2, None, None, None, None), (3, 2000, None, None, 7)]


def test_split_metric_names_drops_the_prefix_once(spark, rows):
    wide = spark.createDataFrame([(2000, 1.0, 2.0, 3.0)], ["year", "mean.temp", "se.temp", "mean.se.x"])
    got = rows(op.split_metric_names(wide, "year", ["mean.temp", "se.temp", "mean.se.x"]), "metric", "mean", "se")
    assert got == [("se.x", 3.0, None), ("temp", 1.0, 2.0)]


def test_metric_panel_and_bars(spark, rows):
    a = spark.createDataFrame([(2000, "temp", 5.0, 1.0, 3)], "year int, trait string, mean double, se double, n int")
    b = spark.createDataFrame([(2000, "odd", 7.0, None, 3)], a.schema)
    panel = op.error_bars(op.metric_panel([a, b], {"temp": "Temperature", "TL": "Trophic Level", "length": "Length"}))
    got = rows(panel, "metric", "group", "mean", "lower", "upper")
    assert got == [("odd", None, 7.0, None, None), ("temp", "Temperature", 5.0, 4.0, 6.0)]


def test_reshape_round_trip(spark, rows):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 3.0)], "id int, name string, v double")
    wide = op.widen(long, "id", "name", "v", ["a", "b"])
    assert rows(wide, "id", "a", "b") == [(1, 1.0, None), (2, 3.0, None)]
    back = op.lengthen(wide, "id", ["a", "b"], "name", "v")
    assert back.count() == 4
    assert rows(op.zero_fill(long.where("v is not null"), "id", "name", "v", ["a"]), "id", "name", "v") == [(1, "a", 1.0), (2, "a", 3.0)]


def test_environment_ignores_nan(spark, rows):
    nan = float("nan")
    df = spark.createDataFrame([(1, 2.0, nan), (1, nan, nan), (1, 4.0, None), (2, None, 1.0)], "month int, temp double, sal double")
    got = rows(op.environment_means(df, "month", ["temp", "sal"]), "month", "temp", "sal")
    assert got == [(1, 3.0, None), (2, None, 1.0)]
    assert op.nan_to_null(df).where("isnan(temp)").count() == 0


def test_oxygen_spot_values(spark):
    df = spark.createDataFrame([(20.0, 0.0, 1.0, 9.0924), (20.0, 25.0, 1.013253, 7.9519)], "t double, s double, p double, want double")
    for r in df.select("want", oxygen_saturation("t", "s", F.col("p")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], abs=5e-5)
    half = df.limit(1).select(oxygen_percent(F.lit(9.0924 / 2), "t", "s", 1.0).alias("x")).first()["x"]
    assert half == pytest.approx(50.0, abs=1e-3)


def test_scalar_helpers(spark):
    got = spark.range(0, 60).select("id", log_factorial("id").alias("f")).collect()
    for r in got:
        assert r["f"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-14, abs=1e-13)
    one = spark.range(1).select(presence(F.lit(4.0)).alias("a"), presence(F.lit(0.0)).alias("b"),
                                *[c.alias(n) for n, c in harmonic_terms(F.lit(5)).items()]).first()
    assert (one["a"], one["b"]) == (1.0, 0.0)
    assert one["cosine"] == pytest.approx(-1.0)


# ------------------------------------------------------------ files


def test_names():
    assert [snake_case(n) for n in ("Common.name", "SpeciesCode", "BottomDO", "all.trips.extrapolated", "Year4", "Temp.mean")] == [
        "common_name", "species_code", "bottom_do", "all_trips_extrapolated", "year4", "temp_mean"
    ]


@pytest.fixture()
def files(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


def test_read_table_types_and_missing(spark, files, rows):
    path = files("t.csv", "Year,BottomTemp,Common name\n1999,12.5,cod\nNA,NaN,\nbad,x,eel\n")
    df = read_table(spark, path, {"year": "int", "bottom_temp": "double", "common_name": "string"})
    assert rows(df, "common_name", "year", "bottom_temp") == [("cod", 1999, 12.5), ("eel", None, None), (None, None, None)]
    with pytest.raises(ValueError, match="lacks"):
        read_table(spark, path, {"absent": "int"})
    twice = spark.createDataFrame([(1, 2)], ["A b", "a.b"])
    assert normalise_names(twice).columns == ["a_b", "a_b_2"]


def test_write_and_read_back(spark, tmp_path, rows):
    df = spark.createDataFrame([(2000, 1, 3.5), (2001, 1, None)], "year int, k int, richness double")
    for fmt in ("parquet", "csv"):
        out = str(tmp_path / fmt)
        write_table(df, out, fmt)
        back = read_table(spark, out, {"year": "int", "k": "int", "richness": "double"}, fmt)
        assert rows(back, "year", "k", "richness") == [(2000, 1, 3.5), (2001, 1, None)]
    write_table(df, str(tmp_path / "parts"), partition_by=["year"])
    kept = spark.read.parquet(str(tmp_path / "parts")).where("year = 2000")
    assert "PartitionFilters: [isnotnull(year" in kept._jdf.queryExecution().toString()


def test_survey_files(spark, files, rows):
    big = files(
        "big.csv",
        "Trawl,Year,Month,SpeciesCode,CommonName,Group,CPUE,BottomTemp,SurfaceTemp,BottomSal,SurfaceSal,BottomDO,SurfaceDO\n"
        "1990-4-2-0830-1,1990,4,101,Cod,Fin Fish,2.5,10,12,20,18,8,9\n"
        "1990-4-2-0830-1,1990,4,201,Crab,Crustacean,1,10,12,20,18,8,NaN\n",
    )
    obs = survey.observations_30(spark, big)
    assert rows(obs, "taxon", "taxon_name", "date", "cpue") == [
        ("101", "Cod", dt.date(1990, 4, 1), 2.5), ("201", "Crab", dt.date(1990, 4, 1), 1.0)
    ]
    env = op.with_oxygen_percent(survey.environment_30(spark, big))
    assert env.where("surface_do_sat is null").count() == 1 and env.where("bottom_do_sat > 50").count() == 2
    small = files("small.csv", "Trawl,Year4,Month,Station,SpecCode,Common.name,CPUE\nT1,1991,5,80,101,Cod,1\nT1,1991,5,7,102,Eel,NA\n")
    groups = files("groups.csv", "CommonName,Group\nCod,Fin Fish\n")
    obs16 = survey.observations_16(spark, small, groups)
    assert rows(obs16, "station", "grp", "cpue") == [(7, None, None), (80, "Fin Fish", 1.0)]
    assert obs.columns == obs16.columns
    region = op.regional_richness(obs16, survey.region_map(spark))
    assert rows(region, "region", "richness") == [("Mid Bay", 1), ("Upper Bay", 1)]
    traits = survey.traits(
        spark, files("traits.csv", "CommonName,Environment,Feeding.Habit2,Trophic.Level,Temp.mean,K\nCod,demersal,,4.1,NaN,0.2\n"), "30-foot"
    )
    r = traits.first()
    assert (r["feeding_habit"], r["trophic_level"], r["temp_mean"], r["k"], r["upper_lat"]) == (None, 4.1, None, 0.2, None)
    ranges = survey.species_ranges(spark, files("r.csv", ",CommonName,upperlat,lowerlat\n1,Cod,60,35\n"))
    assert rows(ranges, "taxon_name", "upper_lat", "lower_lat") == [("Cod", 60.0, 35.0)]
    lens = survey.lengths_30(spark, files("l.csv", "Trawl,SpecCode,length,freq\n1990-4-2-0830-1,101,50,2\n1990-4-2-0830-1,101,999,2\n"))
    trend = op.length_trend(survey.fish_lengths(lens, survey.species_list(obs)))
    assert rows(trend, "year", "mean") == [(1990, 50.0)]
    lens16 = survey.lengths_16(spark, files("l16.csv", "SpecCode,Year,Length,freq\n101,1991,30,1\n"))
    assert rows(lens16, "taxon", "year", "length") == [("101", 1991, 30.0)]
    bays = survey.bay_regions(spark, files("b.csv", "Date,midbay.shann,upperbay.richness\n1990-04-01,1.5,7\n"))
    assert rows(bays, "region", "type", "value") == [("Mid Bay", "Diversity", 1.5), ("Upper Bay", "Richness", 7.0)]
    cov = survey.covariate(spark, files("c.csv", "date,score\n1990-04-01,3\n"), ["score"])
    assert rows(cov, "name", "value") == [("score", 3.0)]


def test_covariate_and_aligned_joins(spark, rows):
    d = [dt.date(2000, m, 1) for m in (1, 2, 3)]
    index = spark.createDataFrame([(d[0], 5.0)], "date date, score double")
    data = spark.createDataFrame([(d[0], 1), (d[1], 2)], "date date, richness int")
    climate = spark.createDataFrame([(d[1], 7.0), (d[2], 8.0)], "day date, nao double")
    got = rows(op.join_covariates(index, data, climate, "date", "day"), "date", "score", "richness", "nao")
    assert got == [(d[1], None, 2, 7.0), (d[2], None, None, 8.0)]
    other = spark.createDataFrame([(d[0], 3), (d[1], None)], "date date, y int")
    assert rows(op.align_series(data, other), "date", "richness", "y") == [(d[0], 1, 3)]


def test_order_labels_ranks_ties_and_missing(spark, rows):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", None), ("d", 1.0)], "label string, v double").repartition(3)
    assert rows(op.order_labels(df, "label", "v"), "rank", "label") == [(1, "d"), (2, "a"), (3, "b"), (4, "c")]
