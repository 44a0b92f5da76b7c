"""Linear and Poisson models: against dense numpy code and Spark's own GLM."""

from __future__ import annotations

import importlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from shoalwise import operators as op
from shoalwise.functions.tails import normal_sf2, student_ppf2, student_sf2
from shoalwise.operators.poisson import SplineBasis


def dense_ols(X, y, w=None):
    w = np.ones(len(y)) if w is None else w
    xtx = X.T @ (X * w[:, None])
    b = np.linalg.solve(xtx, X.T @ (w * y))
    r = y - X @ b
    dof = len(y) - X.shape[1]
    return b, np.sqrt(np.diag(np.linalg.inv(xtx)) * (w @ r**2) / dof), dof


@pytest.fixture(scope="module")
def plane(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"year": 1990.0 + np.arange(60) // 2, "month": 1 + np.arange(60) % 12})
    pdf["y"] = 20 + 0.3 * (pdf["year"] - 1990) + 0.5 * pdf["month"] + rng.normal(size=60)
    pdf["w"] = rng.uniform(0.5, 2, 60)
    pdf["k"] = "a"
    return pdf, spark.createDataFrame(pdf)


def estimates(df):
    return {r["term"]: r for r in df.collect()}


def test_tails_against_known_values():
    assert student_sf2(np.array([2.228138852]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-9)
    assert student_sf2(np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.5)
    assert student_sf2(np.array([0.0, np.inf]), np.array([5.0, 5.0])) == pytest.approx([1.0, 0.0])
    for t in (0.3, 2.0, 9.0):  # closed form with 3 degrees of freedom
        a = t / math.sqrt(3)
        want = 1 - 2 / math.pi * (a / (1 + a * a) + math.atan(a))
        assert student_sf2(np.array([t]), np.array([3.0]))[0] == pytest.approx(want, rel=1e-9)
    assert np.isnan(student_sf2(np.array([1.0]), np.array([0.0]))[0])
    assert normal_sf2(np.array([1.959963984540054]))[0] == pytest.approx(0.05)
    for dof in (1.0, 3.0, 58.0, 4000.0):
        t = student_ppf2(0.95, np.array([dof]))
        assert student_sf2(t, np.array([dof]))[0] == pytest.approx(0.05, abs=1e-12)


def test_trend_equals_dense_fit(plane):
    pdf, df = plane
    r = op.trend(df, "k", "y", "year").first()
    X = np.column_stack([np.ones(60), pdf["year"]])
    b, se, dof = dense_ols(X, pdf["y"].to_numpy())
    assert (r["intercept"], r["slope"], r["se"]) == pytest.approx((b[0], b[1], se[1]), rel=1e-9)
    assert r["p"] == pytest.approx(student_sf2(b[1] / se[1], dof)[0])
    assert r["r2"] == pytest.approx(np.corrcoef(pdf["year"], pdf["y"])[0, 1] ** 2)
    glr = GeneralizedLinearRegression(family="gaussian", featuresCol="f", labelCol="y").fit(
        VectorAssembler(inputCols=["year"], outputCol="f").transform(df)
    )
    assert glr.coefficients[0] == pytest.approx(r["slope"], rel=1e-7)


def test_trend_degenerate_groups(spark):
    df = spark.createDataFrame(
        [("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 4.0), ("same", 3.0, 1.0), ("same", 3.0, 2.0), ("nan", float("nan"), 1.0), ("nan", None, 2.0)],
        "k string, x double, y double",
    )
    got = {r["k"]: r for r in op.trend(df, "k", "y", "x").collect()}
    assert got["two"]["slope"] == pytest.approx(2.0) and got["two"]["se"] is None
    assert got["one"]["slope"] is None and got["same"]["slope"] is None
    assert "nan" not in got


def test_trend_band(plane):
    pdf, df = plane
    x, y = pdf["year"].to_numpy(), pdf["y"].to_numpy()
    b, _, dof = dense_ols(np.column_stack([np.ones(60), x]), y)
    s = math.sqrt(((y - b[0] - b[1] * x) ** 2).sum() / dof)
    q = student_ppf2(0.95, np.array([float(dof)]))[0]
    for r in op.trend_band(df, [], "y", "year").collect():
        half = q * s * math.sqrt(1 / 60 + (r["year"] - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
        assert r["fit"] == pytest.approx(b[0] + b[1] * r["year"])
        assert r["upper"] - r["fit"] == pytest.approx(half, rel=1e-8) == pytest.approx(r["fit"] - r["lower"], rel=1e-8)


def test_percent_change_start(plane):
    _, df = plane
    fit = op.trend(df, [], "y", "year")
    a, b = fit.select("intercept", "slope").first()
    own = op.percent_change(fit).first()
    assert own["percent"] == pytest.approx(100 * ((a + b * 1990 + b * 29) / (a + b * 1990) - 1))
    fixed = op.percent_change(fit, start_at=1966.0).first()
    assert fixed["change"] == pytest.approx(own["change"])
    assert fixed["start_value"] == pytest.approx(a + b * 1966)


@pytest.mark.parametrize("weights", [None, "w"])
def test_ols_numeric_and_factor(plane, weights):
    pdf, df = plane
    w = pdf["w"].to_numpy() if weights else None
    y = pdf["y"].to_numpy()
    numeric = estimates(op.ols(df, "k", "y", ["year", "month"], weights=weights))
    b, se, _ = dense_ols(np.column_stack([np.ones(60), pdf["year"], pdf["month"]]), y, w)
    for i, term in enumerate(("(Intercept)", "year", "month")):
        assert numeric[term]["estimate"] == pytest.approx(b[i], rel=1e-8)
        assert numeric[term]["std_error"] == pytest.approx(se[i], rel=1e-8)
    factor = estimates(op.ols(df, [], "y", ["year"], factors=["month"], weights=weights))
    dummies = np.column_stack([(pdf["month"] == m).astype(float) for m in range(2, 13)])
    b, se, _ = dense_ols(np.column_stack([np.ones(60), pdf["year"], dummies]), y, w)
    for i, term in enumerate(("(Intercept)", "year", *[f"month{m}" for m in range(2, 13)])):
        assert factor[term]["estimate"] == pytest.approx(b[i], rel=1e-7)
        assert factor[term]["std_error"] == pytest.approx(se[i], rel=1e-7)
    line = op.ols_line(op.ols(df, [], "y", ["year"], factors=["month"], weights=weights), [], "year").first()
    assert line["slope"] == factor["year"]["estimate"]


def test_aliased_term_is_null(plane):
    _, df = plane
    got = estimates(op.ols(df.withColumn("twice", F.col("year") * 2), [], "y", ["year", "twice"]))
    alone = estimates(op.ols(df, [], "y", ["year"]))
    assert got["twice"]["estimate"] is None
    assert got["year"]["estimate"] == pytest.approx(alone["year"]["estimate"])
    assert got["year"]["std_error"] == pytest.approx(alone["year"]["std_error"])


def test_weighted_quadratic(spark):
    rng = np.random.default_rng(2)
    year = np.arange(1966, 2020).astype(float)
    exact = 3.0 + 0.5 * (year - 1990) - 0.02 * (year - 1990) ** 2
    se = rng.uniform(0.5, 3, len(year))
    noisy = exact + rng.normal(size=len(year))
    df = spark.createDataFrame([(float(a), float(b), float(c), float(1 / d)) for a, b, c, d in zip(year, exact, noisy, se)], "year double, exact double, est double, w double")
    values = op.polynomial_values(df, op.weighted_polynomial(df, [], "exact", "year", "w"), [], "year").collect()
    assert [r["fit"] for r in values] == pytest.approx([r["exact"] for r in values], abs=1e-6)
    fit = estimates(op.weighted_polynomial(df, [], "est", "year", "w"))
    z = year - 1990
    b, s, _ = dense_ols(np.vander(z, 3, increasing=True), noisy, 1 / se)
    assert fit["year^2"]["estimate"] == pytest.approx(b[2], rel=1e-6)
    assert fit["year^2"]["std_error"] == pytest.approx(s[2], rel=1e-6)
    assert fit["year"]["estimate"] == pytest.approx(b[1] - 2 * 1990 * b[2], rel=1e-6)


def test_vif(spark):
    rng = np.random.default_rng(3)
    x1, x2 = rng.normal(size=80), rng.normal(size=80)
    x3 = x1 + 0.1 * rng.normal(size=80)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x1, x2, x3)], "x1 double, x2 double, x3 double")
    got = {r["term"]: r["vif"] for r in op.vif(df, [], ["x1", "x2", "x3"]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef([x1, x2, x3])))
    assert [got["x1"], got["x2"], got["x3"]] == pytest.approx(want.tolist())
    assert min(got.values()) >= 1
    same = op.vif(df.withColumn("x4", F.col("x1")), [], ["x1", "x4"]).collect()
    assert all(r["vif"] is None for r in same)


# ------------------------------------------------------------ Poisson


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(4)
    n = 240
    pdf = pd.DataFrame({"year": 1990 + np.arange(n) // 12, "month": 1 + np.arange(n) % 12})
    pdf["temp"] = np.round(12 - 8 * np.cos(2 * np.pi * pdf["month"] / 12) + rng.normal(size=n), 2)
    rate = np.exp(0.4 + 0.02 * (pdf["year"] - 2000) + 0.08 * pdf["temp"] + 0.3 * np.sin(pdf["month"]))
    pdf["y"] = rng.poisson(rate)
    pdf.loc[0, "y"] = 0
    return pdf, spark.createDataFrame(pdf)


def dense_poisson(X, y, penalty=None):
    P = np.zeros((X.shape[1],) * 2) if penalty is None else penalty
    eta = np.log(y + 0.1)
    for _ in range(60):
        mu = np.exp(eta)
        z = eta + (y - mu) / mu
        A = X.T @ (X * mu[:, None]) + P
        b = np.linalg.solve(A, X.T @ (mu * z))
        eta = X @ b
    mu = np.exp(eta)
    XWX = X.T @ (X * mu[:, None])
    inv = np.linalg.inv(XWX + P)
    dev = 2 * (np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu)).sum()
    loglik = (y * np.log(mu) - mu).sum() - sum(math.lgamma(v + 1) for v in y)
    return b, np.sqrt(np.diag(inv)), dev, loglik, mu, np.trace(inv @ XWX)


def test_poisson_glm_three_ways(counts):
    pdf, df = counts
    fits = op.poisson_glm(df, "y", ["temp", "year"])
    got = {r["term"]: r for r in fits.terms.collect()}
    model = fits.models.first()
    X = np.column_stack([np.ones(len(pdf)), pdf["temp"], pdf["year"] - 2000.0])
    b, se, dev, loglik, _, _ = dense_poisson(X, pdf["y"].to_numpy(float))
    assert got["temp"]["estimate"] == pytest.approx(b[1], rel=1e-6)
    assert got["temp"]["std_error"] == pytest.approx(se[1], rel=1e-6)
    assert got["(Intercept)"]["estimate"] == pytest.approx(b[0] - 2000 * b[2], rel=1e-6)
    assert model["deviance"] == pytest.approx(dev)
    assert model["aic"] == pytest.approx(-2 * loglik + 6)
    glr = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="f", labelCol="y", tol=1e-10).fit(
        VectorAssembler(inputCols=["temp", "year"], outputCol="f").transform(df)
    )
    assert glr.coefficients[0] == pytest.approx(got["temp"]["estimate"], rel=1e-6)
    assert glr.summary.aic == pytest.approx(model["aic"], rel=1e-8)
    assert glr.summary.coefficientStandardErrors[0] == pytest.approx(got["temp"]["std_error"], rel=1e-5)
    assert glr.summary.pValues[0] == pytest.approx(got["temp"]["p"], rel=1e-4)


def test_factor_and_harmonic_terms(counts):
    pdf, df = counts
    fits = op.poisson_glm(df, "y", [], factors=["month"], harmonics=[])
    got = {r["term"]: r["estimate"] for r in fits.terms.collect()}
    means = pdf.groupby("month")["y"].mean()
    assert got["(Intercept)"] == pytest.approx(math.log(means[1]))
    assert got["month7"] == pytest.approx(math.log(means[7] / means[1]))
    fits = op.poisson_glm(df, "y", ["temp"], harmonics=[op.Harmonic("month")])
    a = 2 * np.pi * pdf["month"] / 10
    b, *_ = dense_poisson(np.column_stack([np.ones(len(pdf)), pdf["temp"], np.cos(a), np.sin(a)]), pdf["y"].to_numpy(float))
    got = {r["term"]: r["estimate"] for r in fits.terms.collect()}
    assert [got["temp"], got["cosine"], got["sine"]] == pytest.approx(b[1:].tolist(), rel=1e-6)


def test_models_use_their_own_complete_rows(counts):
    pdf, df = counts
    holed = df.withColumn("temp", F.when(F.col("year") > 1995, F.col("temp")))
    fits = op.one_by_one(holed, "y", ["temp", "year"], ["month"])
    n = {r["model_id"]: r["n"] for r in fits.models.collect()}
    assert n == {"temp": (pdf["year"] > 1995).sum(), "year": len(pdf)}
    alone = op.poisson_glm(holed.where("temp is not null"), "y", ["temp", "month"]).terms.where("term = 'temp'").first()
    both = fits.terms.where("model_id = 'temp' and term = 'temp'").first()
    assert both["estimate"] == pytest.approx(alone["estimate"], rel=1e-8)


def test_residuals_square_to_the_deviance(counts):
    pdf, df = counts
    fits = op.poisson_glm(df, "y", ["temp", "month"])
    r = fits.residuals(df)
    total = r.agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    assert total == pytest.approx(fits.models.first()["deviance"])
    zero = r.where("y = 0").first()
    assert zero["residual"] == pytest.approx(-math.sqrt(2 * zero["fit"]))


def test_model_selection(counts):
    pdf, df = counts
    ranking, averaged, fits = op.model_selection(df, "y", ["temp", "year"])
    table = ranking.orderBy("rank").collect()
    assert len(table) == 4 and sum(r["weight"] for r in table) == pytest.approx(1)
    assert [r["aic"] for r in table] == sorted(r["aic"] for r in table)
    for r in table:
        assert r["weight"] == pytest.approx(
            math.exp(-r["delta"] / 2) / sum(math.exp(-q["delta"] / 2) for q in table)
        )
    best = {r["term"]: r["estimate"] for r in fits.terms.where(F.col("model_id") == table[0]["model_id"]).collect()}
    avg = {r["term"]: r for r in averaged.collect()}
    if sum(r["in_set"] for r in table) <= 1:
        assert avg["temp"]["full_average"] == pytest.approx(best["temp"])
    assert all(r["importance"] <= 1 + 1e-12 for r in avg.values())


def test_spline_bases_are_smooth_and_cyclic():
    kn = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    cr = SplineBasis(kn, False)
    assert cr.raw(kn) == pytest.approx(np.eye(5), abs=1e-12)
    x = np.linspace(0, 7, 200)
    line = 3 + 2 * kn
    assert cr.raw(x) @ line == pytest.approx(3 + 2 * x)
    assert line @ cr.penalty @ line == pytest.approx(0, abs=1e-10)
    assert cr.raw(np.array([8.0])) @ line == pytest.approx([19.0])
    f = np.array([0.0, 2.0, -1.0, 0.5, 1.0])
    fine = np.linspace(0, 7, 20001)
    second = np.gradient(np.gradient(cr.raw(fine) @ f, fine), fine)[5:-5]
    assert np.trapezoid(second**2, fine[5:-5]) == pytest.approx(f @ cr.penalty @ f, rel=1e-2)
    cc = SplineBasis(np.linspace(1, 12, 8), True)
    assert cc.raw(np.array([1.0])) == pytest.approx(cc.raw(np.array([12.0])))
    h = 1e-5
    slope = lambda a: (cc.raw(np.array([a + h])) - cc.raw(np.array([a]))) / h
    assert slope(1.0) == pytest.approx(slope(12.0 - h), abs=1e-3)


def test_gam_equals_dense_penalised_fit(counts):
    pdf, df = counts
    fits = op.poisson_gam(df, "y", ["year"], [op.Smooth("temp", "cr", 8), op.Smooth("month", "cc", 6)], refine=False)
    model = fits.fitted["model"]
    blocks = [fits.blocks[b] for b in model.blocks]
    data = {c: pdf[c].to_numpy(float) for c in ("year", "temp", "month")}
    X = np.hstack([np.ones((len(pdf), 1)), *[b.matrix(data) for b in blocks]])
    assert X[:, 2:].sum(axis=0) == pytest.approx(np.zeros(X.shape[1] - 2), abs=1e-6)
    P = np.zeros((X.shape[1],) * 2)
    for (at, s), log_lambda in zip(model.penalties, model.log_lambda):
        P[np.ix_(at, at)] += math.exp(log_lambda) * s
    b, se, dev, loglik, mu, edf = dense_poisson(X, pdf["y"].to_numpy(float), P)
    row = fits.models.first()
    assert row["deviance"] == pytest.approx(dev, rel=1e-6)
    assert row["edf"] == pytest.approx(edf, rel=1e-5)
    assert row["aic"] == pytest.approx(-2 * loglik + 2 * edf, rel=1e-6)
    assert row["ubre"] == pytest.approx(dev / 240 + 2 * edf / 240 - 1, rel=1e-5)
    fitted = fits.residuals(df).orderBy("year", "month").toPandas()
    assert fitted["fit"].to_numpy() == pytest.approx(mu, rel=1e-5)


def test_gam_smoothing_choice(counts):
    pdf, df = counts
    tuned = op.poisson_gam(df, "y", ["year"], [op.Smooth("month", "cc", 8)])
    rough = op.poisson_gam(df, "y", ["year"], [op.Smooth("month", "cc", 8)], refine=False)
    assert tuned.models.first()["ubre"] <= rough.models.first()["ubre"] + 1e-9
    plain = op.poisson_glm(df, "y", ["year"]).models.first()
    assert tuned.models.first()["deviance"] < plain["deviance"]
    edf = tuned.terms.where("term = 's(month)'").first()["edf"]
    assert 0 < edf < 7


def test_huge_penalty_is_the_linear_model(counts):
    module = importlib.import_module("shoalwise.operators.poisson")
    pdf, df = counts
    merged, _ = module._merge(df, "y", [op.Smooth("temp", "cr", 8)])
    table = merged.cache()
    blocks = module._blocks(table, [op.Smooth("temp", "cr", 8)])
    s = blocks[0].penalty
    model = module.Model("m", [0], np.arange(8), [(np.arange(1, 8), s / np.abs(s).max())], np.array([30.0]), False)
    module._fit_all(table, blocks, [model])
    linear = op.poisson_glm(df, "y", ["temp"]).models.first()
    assert model.result["deviance"] == pytest.approx(linear["deviance"], rel=1e-5)


def test_ols_with_very_many_levels_and_keys(spark):
    """601 levels: slopes within levels, each level against the smallest of its key."""
    rng = np.random.default_rng(3)
    rows = [(k, int(f), float(x), float(0.5 * x + (f % 7) + e))
            for k in ("a", "b") for f, x, e in zip(np.arange(1803) % 601, rng.normal(size=1803), rng.normal(size=1803))]
    df = spark.createDataFrame(rows, "k string, f int, x double, y double")
    got = {(r["k"], r["term"]): r for r in op.ols(df, "k", "y", ["x"], factors=["f"]).collect()}
    assert len(got) == 2 * 602
    for k in ("a", "b"):
        mine = [r for r in rows if r[0] == k]
        X = np.zeros((1803, 602))
        X[:, 0], X[:, 1] = 1, [r[2] for r in mine]
        for i, r in enumerate(mine):
            if r[1]:
                X[i, r[1] + 1] = 1
        y = np.array([r[3] for r in mine])
        inverse = np.linalg.inv(X.T @ X)
        b = inverse @ X.T @ y
        s2 = ((y - X @ b) ** 2).sum() / (1803 - 602)
        for j, name in ((0, "(Intercept)"), (1, "x"), (2, "f1"), (601, "f600")):
            assert got[k, name]["estimate"] == pytest.approx(b[j], rel=1e-8)
            assert got[k, name]["std_error"] == pytest.approx(np.sqrt(s2 * inverse[j, j]), rel=1e-8)
    assert got["a", "x"]["x_min"] == min(r[2] for r in rows if r[0] == "a")


def test_text_factor_is_its_numbered_twin(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i % 3), "xyz"[i % 3], float(rng.normal()), int(rng.poisson(4 + i % 3))) for i in range(300)]
    df = spark.createDataFrame(rows, "n int, s string, x double, y int")
    by_number = {r["term"]: r for r in op.poisson_glm(df, "y", ["x"], factors=["n"]).terms.collect()}
    fits = op.poisson_glm(df, "y", ["x"], factors=["s"])
    by_text = {r["term"]: r for r in fits.terms.collect()}
    assert set(by_text) == {"(Intercept)", "x", "sy", "sz"}
    for a, b in (("sy", "n1"), ("sz", "n2"), ("x", "x")):
        assert by_text[a]["estimate"] == pytest.approx(by_number[b]["estimate"], rel=1e-9)
    mean = fits.residuals(df).groupBy("s").agg(F.avg("fit").alias("f"), F.avg("y").alias("y")).collect()
    assert all(r["f"] == pytest.approx(r["y"]) for r in mean)
    model = fits.models.first()
    assert model["converged"] and model["iterations"] > 1 and not model["at_bound"]


def test_best_model_alone_is_in_the_set(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(float(a), int(c)) for a, c in zip(x, rng.poisson(np.exp(1 + 2 * x)))], "x double, y int")
    ranking, averaged, _ = op.model_selection(df, "y", ["x"])
    top = ranking.orderBy("rank").collect()
    assert top[0]["weight"] > 0.95 and top[0]["in_set"] and not top[1]["in_set"]
    row = {r["term"]: r for r in averaged.collect()}["x"]
    assert row["importance"] == 1 and row["std_error"] > 0 and row["p"] < 1e-6
