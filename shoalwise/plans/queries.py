"""Whole analyses over the supplied tables, one function per query.

Every query reads its tables whole.  Results are rounded so that two engines
that add in a different order give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwise import operators as op
from shoalwise.frames import durable, lookup
from shoalwise.functions import harmonic_terms, season
from shoalwise.session import ship
from shoalwise.sources import star, write_stage

SPLIT_YEAR = 1998
PERMUTATIONS = 100
SEED = 1

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates as yyyy-mm-dd, which reads the same from any engine."""
    return df.select(*[F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes])


#: Values a month up to which a rank test is exact: its p is then a sum over all orders.
YEARS_AT_MOST = 10


def query(f: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return dates_as_text(f(ship(spark), folder))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round the double columns; adding 0 turns -0 into 0."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.round(c, special.get(name, digits)) + 0.0).alias(name) if kind == "double" else c)
    return df.select(*out)


def by_season(df: DataFrame) -> DataFrame:
    return df.withColumn("season", season("month"))


def fish(df: DataFrame) -> DataFrame:
    return df.where(F.col("grp").isin(*star.FISH_TYPES))


def monthly_series(spark: SparkSession, folder: str) -> DataFrame:
    """Richness, Shannon entropy and mean order price per month."""
    obs = star.observations(spark, folder)
    price = star.orders(spark, folder).groupBy("date").agg((F.avg("price") / 1000).alias("price"))
    catch = op.diversity(obs, "date").select("date", F.col("taxa").alias("richness"), "shannon", "total")
    return catch.join(price, "date").withColumns({"year": F.year("date"), "month": F.month("date")})


# ------------------------------------------------------------ richness, diversity


@query
def monthly_richness(spark: SparkSession, folder: str) -> DataFrame:
    return op.complete_calendar(op.richness(star.observations(spark, folder), "date"))


@query
def seasonal_richness(spark: SparkSession, folder: str) -> DataFrame:
    return op.richness(by_season(star.observations(spark, folder)), ["year", "season"])


@query
def fish_richness(spark: SparkSession, folder: str) -> DataFrame:
    return op.complete_calendar(op.richness(fish(star.named_totals(spark, folder, ["date"])), "date"))


@query
def present_richness(spark: SparkSession, folder: str) -> DataFrame:
    """Only taxa whose catch in the month is above a threshold."""
    obs = star.observations(spark, folder)
    return op.complete_calendar(op.richness(obs, ["survey", "date"], min_cpue=40), keys=["survey"])


@query
def monthly_shannon(spark: SparkSession, folder: str) -> DataFrame:
    div = op.diversity(star.observations(spark, folder), "date")
    return rounded(op.complete_calendar(div.select("date", "total", "shannon")))


@query
def monthly_simpson(spark: SparkSession, folder: str) -> DataFrame:
    div = op.diversity(star.observations(spark, folder), ["survey", "date"])
    return rounded(op.complete_calendar(div.select("survey", "date", "simpson"), keys=["survey"]), 8)


@query
def seasonal_shannon(spark: SparkSession, folder: str) -> DataFrame:
    div = op.diversity(by_season(star.observations(spark, folder)), ["year", "season"])
    return rounded(div.select("year", "season", "shannon"))


@query
def regional_richness(spark: SparkSession, folder: str) -> DataFrame:
    counted = op.regional_richness(star.observations(spark, folder), star.station_regions(spark, folder))
    return op.complete_calendar(counted, keys=["region"])


@query
def regional_taxa(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct taxa per region, on the months one region drives."""
    return op.regional_richness(
        star.observations(spark, folder), star.station_regions(spark, folder), mode="distinct", driver="ASIA"
    )


@query
def regional_shannon(spark: SparkSession, folder: str) -> DataFrame:
    div = op.regional_diversity(star.observations(spark, folder), star.station_regions(spark, folder))
    return rounded(div.select("region", "date", "shannon"))


@query
def species_totals(spark: SparkSession, folder: str) -> DataFrame:
    return op.species_totals(star.named_totals(spark, folder, ["year", "month"]), ["year", "month"], "taxon_name")


# ------------------------------------------------------------ composition, occurrence


@query
def composition_share(spark: SparkSession, folder: str) -> DataFrame:
    totals = star.named_totals(spark, folder, ["survey", "year"])
    return rounded(op.composition(totals, ["survey", "year"], "grp", fill=True, categories=star.part_types(spark, folder)), 8)


@query
def composition_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of every group per station and month, absent groups included."""
    totals = star.named_totals(spark, folder, ["station", "date"])
    types = star.part_types(spark, folder)
    return rounded(op.composition(totals, ["station", "date"], "grp", fill=True, categories=types), 8)


@query
def composition_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the taxa caught per station and month; absent ones have no row."""
    totals = star.named_totals(spark, folder, ["station", "date"])
    return rounded(op.composition(totals, ["station", "date"], "taxon_name"), 8)


@query
def composition_wide(spark: SparkSession, folder: str) -> DataFrame:
    types = star.part_types(spark, folder)
    shares = op.composition(star.named_totals(spark, folder, ["date"]), "date", "grp", fill=True, categories=types)
    return rounded(op.widen(shares, "date", "grp", "share", types), 8)


@query
def occurrence_shift(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.occurrence(star.observations(spark, folder), "taxon", split_year=SPLIT_YEAR), 8)


@query
def occurrence_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The occurrence shares of each survey as rows."""
    shift = op.occurrence(star.observations(spark, folder), "taxon", split_year=SPLIT_YEAR, keys="survey")
    return rounded(op.lengthen(shift, ["survey", "taxon", "diff"], ["prop_early", "prop_late"], "variable"), 8)


@query
def introductions(spark: SparkSession, folder: str) -> DataFrame:
    return op.turnover_years(star.observations(spark, folder), "taxon", beyond=1995, keys="survey")


@query
def departures(spark: SparkSession, folder: str) -> DataFrame:
    return op.turnover_years(
        star.observations(spark, folder), "taxon", kind="last", beyond=2001, fill_zero=True, keys="survey"
    )


@query
def introduction_rate(spark: SparkSession, folder: str) -> DataFrame:
    counts = op.turnover_years(star.observations(spark, folder), "taxon", beyond=1992, trim=1993, keys="survey")
    return rounded(op.turnover_rate(counts, "survey"))


# ------------------------------------------------------------ accumulation


def _accumulation(spark: SparkSession, folder: str) -> DataFrame:
    return op.accumulation(
        star.observations(spark, folder), "year", "station", "taxon", permutations=PERMUTATIONS, seed=SEED
    )


@query
def accumulation_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_accumulation(spark, folder))


@query
def rarefaction_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.rarefaction(star.observations(spark, folder), "year", "station", "taxon"), 5)


def _slopes(spark: SparkSession, folder: str) -> DataFrame:
    curve = _accumulation(spark, folder).withColumn("log_k", F.ln("k"))
    return op.trend(curve, "year", "richness", "log_k")


@query
def accumulation_slope(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_slopes(spark, folder).select("year", "slope", "se", "r2", "n"))


@query
def staged_slope(spark: SparkSession, folder: str) -> DataFrame:
    """The curve written as CSV, read back by its schema, and fitted; the stage goes once the slopes are kept."""
    with write_stage(_accumulation(spark, folder), "accumulation", "csv") as stage:
        curve = stage.read().withColumn("log_k", F.ln("k"))
        slopes = durable(op.trend(curve, "year", "richness", "log_k").select("year", "slope", "n"))
    return rounded(slopes)


@query
def slope_quadratic(spark: SparkSession, folder: str) -> DataFrame:
    # curves are costly and their slopes few: written once, then fitted
    slopes = durable(_slopes(spark, folder).select("year", "slope", (1 / F.col("se")).alias("w")))
    fit = op.weighted_polynomial(slopes, [], "slope", "year", weights="w")
    return rounded(op.polynomial_values(slopes, fit, [], "year", "curve").select("year", "slope", "curve"), 5)


# ------------------------------------------------------------ traits and lengths


def _traits(spark: SparkSession, folder: str) -> DataFrame:
    obs = star.named_totals(spark, folder, ["year"])
    return op.trait_trend(obs, star.traits(spark, folder), ["trophic_level", "temp_mean"])


def _latitude(spark: SparkSession, folder: str) -> DataFrame:
    return op.latitude_trend(star.named_totals(spark, folder, ["year"]), star.traits(spark, folder))


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return op.length_trend(fish(star.named_lengths(spark, folder)))


@query
def trait_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_traits(spark, folder))


@query
def latitude_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_latitude(spark, folder))


@query
def length_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_lengths(spark, folder))


@query
def length_distribution(spark: SparkSession, folder: str) -> DataFrame:
    # means of few lengths end within ten decimals: no value is cut at a tie
    return rounded(op.length_distribution(fish(star.named_lengths(spark, folder)), ["year", "taxon"]), 10)


@query
def log_length(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.mean_log_length(op.length_distribution(fish(star.named_lengths(spark, folder)))), 8)


@query
def metric_panel(spark: SparkSession, folder: str) -> DataFrame:
    labels = {
        "trophic_level": "Trophic Level", "temp_mean": "Temperature", "lower_lat": "Latitude",
        "mid_lat": "Latitude", "upper_lat": "Latitude", "length": "Length",
    }
    frames = [_traits(spark, folder), _latitude(spark, folder), _lengths(spark, folder)]
    return rounded(op.metric_panel(frames, labels))


@query
def metric_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Wide mean and SE columns to metrics with error bars."""
    wide = star.orders(spark, folder).groupBy("year").agg(
        F.avg("price").alias("mean.price"),
        (F.stddev_samp("price") / F.sqrt(F.count(F.lit(1)))).alias("se.price"),
        F.avg(F.ln("price")).alias("mean.logprice"),
        (F.stddev_samp(F.ln("price")) / F.sqrt(F.count(F.lit(1)))).alias("se.logprice"),
    )
    columns = ["mean.price", "se.price", "mean.logprice", "se.logprice"]
    return rounded(op.error_bars(op.split_metric_names(wide, "year", columns)), 4)


@query
def repeated_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Rows repeated by frequency against the weighted form."""
    rows = op.repeat_rows(star.lengths(spark, folder), "freq")
    sums = rows.groupBy("year", "taxon").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
    named = lookup(sums, star.species(spark, folder), "taxon", "inner")
    return rounded(named.groupBy("year", "grp").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("length")))


@query
def tow_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Composite tow ids split into typed parts."""
    day = F.col("l_shipdate").cast("date")
    ids = star.table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.year(day), F.month(day), F.dayofmonth(day), F.lit("x"), "l_suppkey").alias("tow"),
        "l_quantity",
    )
    into = [("year", "int"), ("month", "int"), ("day", "int"), ("time", "int"), ("station", "int")]
    parts = op.split_id(ids, "tow", into)
    return parts.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.count("time").alias("timed"), F.max("day").alias("last_day"), F.max("station").alias("last_station"),
        F.sum("l_quantity").alias("cpue"),
    )


# ------------------------------------------------------------ environment


@query
def monthly_environment(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.complete_calendar(op.environment_means(star.orders(spark, folder), "date", "price")), 3)


@query
def daily_environment(spark: SparkSession, folder: str) -> DataFrame:
    means = op.environment_means(star.events(spark, folder), ["event_type", "date"], "value")
    return rounded(op.complete_calendar(means, keys=["event_type"], step="day"))


@query
def seasonal_environment(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.environment_means(by_season(star.orders(spark, folder)), ["year", "season"], "price"), 3)


@query
def percent_saturation(spark: SparkSession, folder: str) -> DataFrame:
    env = op.with_oxygen_percent(star.water(spark, folder), ["bottom"])
    return rounded(op.environment_means(env, ["year", "month"], ["bottom_temp", "bottom_do_sat"]))


@query
def mean_line(spark: SparkSession, folder: str) -> DataFrame:
    div = op.diversity(star.observations(spark, folder), ["survey", "date"])
    return rounded(op.reference_line(div.select("survey", "date", "shannon"), "survey", "shannon"))


@query
def covariate_join(spark: SparkSession, folder: str) -> DataFrame:
    """A monthly index, the model table, and a full calendar."""
    obs, orders = star.observations(spark, folder), star.orders(spark, folder)
    index = orders.groupBy("date").agg(F.count(F.lit(1)).alias("score"))
    data = op.richness(obs, "date")
    climate = op.complete_calendar(orders.groupBy(F.col("date").alias("day")).agg(F.max("price").alias("peak")), "day")
    return op.join_covariates(index, data, climate, "date", "day")


# ------------------------------------------------------------ trends


def _survey_richness(spark: SparkSession, folder: str) -> DataFrame:
    rich = op.richness(star.observations(spark, folder), ["survey", "date"])
    return rich.withColumns({"year": F.year("date"), "month": F.month("date")})


@query
def richness_trend(spark: SparkSession, folder: str) -> DataFrame:
    fit = op.trend(_survey_richness(spark, folder), "survey", "richness", "year")
    return rounded(fit.select("survey", "slope", "intercept", "se", "t", "p", "r2", "n"), intercept=3)


@query
def percent_change(spark: SparkSession, folder: str) -> DataFrame:
    fit = op.trend(_survey_richness(spark, folder), "survey", "richness", "year")
    return rounded(op.percent_change(fit).select("survey", "start_value", "change", "percent"), 5)


@query
def trend_band(spark: SparkSession, folder: str) -> DataFrame:
    series = op.richness(star.observations(spark, folder), ["survey", "year"])
    return rounded(op.trend_band(series, "survey", "richness", "year"), 4)


@query
def month_factor_ols(spark: SparkSession, folder: str) -> DataFrame:
    fit = op.ols(monthly_series(spark, folder), [], "richness", ["year"], factors=["month"])
    return rounded(fit.select("term", "estimate", "std_error", "t", "p"), 4)


@query
def two_term_ols(spark: SparkSession, folder: str) -> DataFrame:
    fit = op.ols(_survey_richness(spark, folder), "survey", "richness", ["year", "month"])
    return rounded(fit.select("survey", "term", "estimate", "std_error", "t", "p"), 4)


@query
def ols_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The two-term model as a whole: fit, residual scale and information criterion."""
    return rounded(op.ols_summary(_survey_richness(spark, folder), "survey", "richness", ["year", "month"]), 4)


@query
def two_term_change(spark: SparkSession, folder: str) -> DataFrame:
    """Change over the record along one term of a two-term model, from a fixed start."""
    rows = _survey_richness(spark, folder)
    line = op.ols_line(op.ols(rows, "survey", "richness", ["year", "month"]), "survey", "year")
    changed = op.percent_change(line, start_at=1990.0)
    return rounded(changed.select("survey", "start_value", "change", "percent"), 4)


@query
def vif(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.vif(monthly_series(spark, folder), [], ["year", "month", "price"]))


# ------------------------------------------------------------ rank tests, lags


@query
def mann_kendall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.mann_kendall(_survey_richness(spark, folder), "survey", "date", "richness"))


@query
def seasonal_mann_kendall(spark: SparkSession, folder: str) -> DataFrame:
    rows = _survey_richness(spark, folder)
    return rounded(op.mann_kendall(rows, "survey", "date", "richness", season="month", continuity=False))


@query
def exact_mann_kendall(spark: SparkSession, folder: str) -> DataFrame:
    """Few years a month: the share of all orders of each month's values whose scores add up to one as far from 0."""
    rows = _survey_richness(spark, folder)
    tests = op.mann_kendall(rows, "survey", "date", "richness", season="month", exact_up_to=YEARS_AT_MOST)
    return rounded(tests.select("survey", "n", "s", "exact_p"))


@query
def station_mann_kendall(spark: SparkSession, folder: str) -> DataFrame:
    """The test on every station's catch per day: many long series with ties."""
    daily = (
        star.table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("station"), F.col("l_shipdate").cast("date").alias("day"))
        .agg(F.sum("l_quantity").alias("cpue"))
    )
    return rounded(op.mann_kendall(daily, "station", "day", "cpue"))


@query
def cross_correlation(spark: SparkSession, folder: str) -> DataFrame:
    div = op.diversity(star.observations(spark, folder), ["survey", "date"])
    return rounded(op.cross_correlation(div, "survey", "date", "shannon", "total", 48))


@query
def survey_cross_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Two surveys aligned by date, remaining months taken as consecutive."""
    rich = op.richness(star.observations(spark, folder), ["survey", "date"])
    first = rich.where(F.col("survey") == "A").select("date", F.col("richness").alias("x"))
    second = rich.where(F.col("survey") == "R").select("date", F.col("richness").alias("y"))
    both = op.align_series(first, op.complete_calendar(second))
    return rounded(op.cross_correlation(both, [], "date", "x", "y", 50, index="rows"))


# ------------------------------------------------------------ Poisson models


def _terms(fits: op.PoissonFits, digits: int = 5) -> DataFrame:
    return rounded(fits.terms.select("model_id", "term", "estimate", "std_error", "z", "p"), digits, z=3, p=6)


@query
def poisson_glm(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(op.poisson_glm(monthly_series(spark, folder), "richness", ["price", "month"]))


@query
def poisson_factor_glm(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(op.poisson_glm(monthly_series(spark, folder), "richness", [], factors=["month"]))


@query
def poisson_fit_summary(spark: SparkSession, folder: str) -> DataFrame:
    fits = op.poisson_glm(monthly_series(spark, folder), "richness", ["price", "month"])
    return rounded(fits.models.select("n", "deviance", "null_deviance", "deviance_explained", "aic"), 4)


@query
def glm_one_by_one(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(op.one_by_one(monthly_series(spark, folder), "richness", ["price", "year", "shannon"], ["month"]), 4)


@query
def harmonic_glm(spark: SparkSession, folder: str) -> DataFrame:
    fits = op.poisson_glm(monthly_series(spark, folder), "richness", [], harmonics=[op.Harmonic("month")])
    return _terms(fits)


@query
def deviance_residuals(spark: SparkSession, folder: str) -> DataFrame:
    series = durable(monthly_series(spark, folder))
    fits = op.poisson_glm(series, "richness", ["price", "month"])
    return rounded(fits.residuals(series).select("date", "richness", "fit", "residual"), 4)


@query
def residual_cross_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """A covariate against the residuals of a seasonal model, by lag."""
    series = durable(monthly_series(spark, folder))
    fits = op.poisson_glm(series, "richness", [], harmonics=[op.Harmonic("month")])
    return rounded(op.cross_correlation(fits.residuals(series), [], "date", "price", "residual", 48))


@query
def model_selection(spark: SparkSession, folder: str) -> DataFrame:
    ranking, _, _ = op.model_selection(
        monthly_series(spark, folder), "richness", ["price", "year", "shannon", op.Harmonic("month")]
    )
    return rounded(ranking)


@query
def best_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """The confidence set alone, by branch and bound over the subsets."""
    ranking, _, _ = op.model_selection(
        monthly_series(spark, folder), "richness", ["price", "year", "shannon", op.Harmonic("month")], ignore=1e-9
    )
    return rounded(ranking.where("in_set"))


@query
def averaged_model(spark: SparkSession, folder: str) -> DataFrame:
    _, averaged, _ = op.model_selection(
        monthly_series(spark, folder), "richness", ["price", "year", op.Harmonic("month")]
    )
    return rounded(averaged, z=3)


@query
def poisson_gam(spark: SparkSession, folder: str) -> DataFrame:
    fits = op.poisson_gam(
        monthly_series(spark, folder), "richness", ["price", "year"], [op.Smooth("month", "cc", 10)]
    )
    return rounded(fits.terms)


@query
def gam_summary(spark: SparkSession, folder: str) -> DataFrame:
    fits = op.poisson_gam(
        monthly_series(spark, folder), "richness", [],
        [op.Smooth("price", "cr", 10), op.Smooth("year", "cr", 6), op.Smooth("month", "cc", 10)],
    )
    return rounded(fits.models)


@query
def gam_residuals(spark: SparkSession, folder: str) -> DataFrame:
    series = durable(monthly_series(spark, folder))
    fits = op.poisson_gam(series, "richness", ["year"], [op.Smooth("month", "cc", 10)])
    return rounded(fits.residuals(series).select("date", "richness", "fit", "residual"), 4)


# given, so that the penalised fit has one solution to compare with
SMOOTHING = 2.0
SMOOTH_KNOTS = 6


def _fixed_gam(series: DataFrame) -> op.PoissonFits:
    by_month = op.Smooth("month", "cc", 10)
    return op.poisson_gam(series, "richness", ["price", "year"], [by_month], smoothing={by_month: SMOOTHING})


@query
def fixed_gam_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Linear terms and the smooth's degrees of freedom at a given smoothing."""
    terms = _fixed_gam(monthly_series(spark, folder)).terms
    return rounded(terms.where(~F.col("term").startswith("s(month).")).drop("model_id"), 5, z=3)


@query
def fixed_gam_summary(spark: SparkSession, folder: str) -> DataFrame:
    fits = _fixed_gam(monthly_series(spark, folder))
    return rounded(fits.models.drop("model_id", "iterations"), 5)


@query
def fixed_gam_residuals(spark: SparkSession, folder: str) -> DataFrame:
    series = durable(monthly_series(spark, folder))
    return rounded(_fixed_gam(series).residuals(series).select("date", "richness", "fit", "residual"), 4)


@query
def default_smooth_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Thin-plate smooth of the month next to the price at a given smoothing."""
    by_month = op.Smooth("month", k=12)
    fits = op.poisson_gam(monthly_series(spark, folder), "richness", ["price"], [by_month], smoothing={by_month: SMOOTHING})
    return rounded(fits.models.drop("model_id", "iterations"), 5)


@query
def gam_smoothing(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothing chosen for default smooths, and how flat UBRE is there."""
    fits = op.poisson_gam(monthly_series(spark, folder), "richness", [], [op.Smooth("price"), op.Smooth("month", "cc", 10)])
    return fits.smoothing.select("term", F.round(F.log10("smoothing"), 3).alias("log10_smoothing"), (F.abs("gradient") < 1e-6).alias("flat"), "at_bound")


@query
def two_factor_ols(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly price and richness with factors of the year and of the month side by side."""
    fit = op.ols(monthly_series(spark, folder), [], "richness", ["price"], factors=["year", "month"])
    return rounded(fit.select("term", "estimate", "std_error"), 4)


@query
def station_month_ols(spark: SparkSession, folder: str) -> DataFrame:
    """Catch on the number of taxa within station and month, both absorbed by conjugate gradients."""
    rows = star.observations(spark, folder).groupBy("station", "date").agg(F.sum("cpue").alias("cpue"), F.countDistinct("taxon").alias("taxa"))
    fit = op.ols(rows, [], "cpue", ["taxa"], factors=["station", "date"], dense_levels=0)
    return rounded(fit.where("term = 'taxa'").select("term", "estimate", "std_error"), 4)


@query
def gam_smooth_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Test of the month's smooth at a given smoothing."""
    return rounded(_fixed_gam(monthly_series(spark, folder)).smooths.drop("model_id"), 5)


@query
def month_smooth(spark: SparkSession, folder: str) -> DataFrame:
    """Gaussian smooth of richness on the month at a given smoothing, at the twelve months."""
    fit = op.gaussian_smooth(monthly_series(spark, folder), [], "month", "richness", k=SMOOTH_KNOTS, points=12, smoothing=SMOOTHING)
    return rounded(fit.band.select(F.round("x").cast("int").alias("month"), "fit", "se"), 4)


@query
def month_smooth_summary(spark: SparkSession, folder: str) -> DataFrame:
    fit = op.gaussian_smooth(monthly_series(spark, folder), [], "month", "richness", k=SMOOTH_KNOTS, points=12, smoothing=SMOOTHING)
    return rounded(fit.models.select("n", "edf", "gcv", "scale", "r2"), 4)


@query
def smooth_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Three indices over the record, each with its smooth of least GCV and the band."""
    series = monthly_series(spark, folder)
    long = op.lengthen(series.select("date", "richness", "shannon", "total"), "date", ["richness", "shannon", "total"], "index", "value")
    return rounded(op.gaussian_smooth(long, "index", "date", "value").band, 2)


# ------------------------------------------------------------ smooth summaries


@query
def kernel_density(spark: SparkSession, folder: str) -> DataFrame:
    stage = op.length_distribution(fish(star.named_lengths(spark, folder)), ["year", "taxon"])
    return rounded(op.density(stage, "year", "length", points=128), 8, x=5)


@query
def log_density(spark: SparkSession, folder: str) -> DataFrame:
    stage = op.length_distribution(fish(star.named_lengths(spark, folder)), ["year", "taxon"])
    return rounded(op.density(stage.withColumn("log_length", F.ln("length")), "year", "log_length", points=128), 7)


@query
def local_smooth(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.local_smooth(_survey_richness(spark, folder), "survey", "date", "richness"), 4)


@query
def price_smooth(spark: SparkSession, folder: str) -> DataFrame:
    """A continuous covariate: every distinct value is its own position."""
    return rounded(op.local_smooth(monthly_series(spark, folder), [], "price", "richness", points=40), 3)


@query
def price_smooth_band(spark: SparkSession, folder: str) -> DataFrame:
    """The line again, with the errors behind its band."""
    band = op.local_smooth_band(monthly_series(spark, folder), [], "price", "richness", points=20)
    return rounded(band.select("x", "fit", "std_error", "residual_df", "scale"), 3)


@query
def length_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.exact_quantiles(star.lengths(spark, folder), ["year"], "length", [0.25, 0.5, 0.75]), 6)


@query
def label_order(spark: SparkSession, folder: str) -> DataFrame:
    """Taxa by their summed catch, with their rank."""
    totals = op.species_totals(star.observations(spark, folder), [])
    return op.order_labels(totals, "taxon", "n")


@query
def harmonic_terms_by_month(spark: SparkSession, folder: str) -> DataFrame:
    terms = harmonic_terms("month")
    return rounded(star.observations(spark, folder).withColumns(terms).groupBy("month").agg(
        *[F.max(c).alias(c) for c in terms], F.count(F.lit(1)).alias("n")
    ))

