"""Choice of smoothing by Newton's method, thin-plate splines and best subsets."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoalwise import operators as op
from shoalwise.operators.poisson import Bench, SplineBasis, _fit_all, ubre_slopes
from shoalwise.operators.thinplate import ThinPlateBasis


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    n = 300
    pdf = pd.DataFrame({"x": np.round(rng.uniform(0, 10, n), 1), "z": np.round(rng.normal(size=n), 1)})
    for i in range(6):
        pdf[f"v{i}"] = np.round(rng.normal(size=n), 2)
    rate = np.exp(1.5 + 0.5 * np.sin(pdf["x"]) + 0.1 * pdf["z"] + 0.15 * pdf["v0"] - 0.05 * pdf["v1"])
    pdf["y"] = rng.poisson(rate)
    return spark.createDataFrame(pdf)


def ubre_at(bench, smooths, log_lambda):
    model = bench.model("m", smooths)
    model.log_lambda, model.tune = np.array(log_lambda), False
    _fit_all(bench.table, bench.blocks, [model])
    return model


def test_slopes_of_ubre_against_differences(rows):
    smooths = [op.Smooth("x", "cr", 8), op.Smooth("z", "tp", 6)]
    bench = Bench(rows, "y", smooths)
    at = np.array([1.0, 2.0])
    gradient, hessian, slopes = ubre_slopes(bench.table, bench.blocks, ubre_at(bench, smooths, at))
    h = 0.01
    for j in range(2):
        step = np.eye(2)[j] * h
        up, down = ubre_at(bench, smooths, at + step), ubre_at(bench, smooths, at - step)
        assert gradient[j] == pytest.approx((up.result["ubre"] - down.result["ubre"]) / (2 * h), rel=1e-3)
        assert slopes[j] == pytest.approx((up.beta - down.beta) / (2 * h), rel=1e-2, abs=1e-5)
        higher = ubre_slopes(bench.table, bench.blocks, up)[0]
        lower = ubre_slopes(bench.table, bench.blocks, down)[0]
        assert hessian[j] == pytest.approx((higher - lower) / (2 * h), rel=1e-3, abs=1e-8)


def test_chosen_smoothing_is_a_minimum(rows):
    smooths = [op.Smooth("x"), op.Smooth("z")]
    fits = op.poisson_gam(rows, "y", [], smooths)
    chosen = {r["term"]: r for r in fits.smoothing.collect()}
    assert set(chosen) == {"s(x)", "s(z)"}
    assert all(abs(r["gradient"]) < 1e-6 for r in chosen.values())
    best = fits.models.first()["ubre"]
    for factors in itertools.product((0.5, 1.0, 2.0), repeat=2):
        given = {s: chosen[s.label]["smoothing"] * f for s, f in zip(smooths, factors)}
        assert op.poisson_gam(rows, "y", [], smooths, smoothing=given).models.first()["ubre"] >= best - 1e-8


def test_a_line_ends_at_large_smoothing(spark):
    x = np.repeat(np.linspace(0, 1, 40), 30)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.round(np.exp(2 + x))}))
    fits = op.poisson_gam(df, "y", [], [op.Smooth("x", "cr", 8)])
    line = op.poisson_glm(df, "y", ["x"]).models.first()
    smooth = fits.models.first()
    assert smooth["converged"] and smooth["deviance"] <= line["deviance"] + 1e-6
    assert abs(fits.smoothing.first()["gradient"]) < 1e-6


# ------------------------------------------------------------ thin plates


def test_full_thin_plate_is_the_natural_cubic_spline():
    centres = np.array([0.0, 1.0, 1.5, 4.0, 7.0, 7.25, 11.0])
    plate, natural = ThinPlateBasis(centres, 7), SplineBasis(centres, False)
    values = np.array([1.0, -2.0, 0.5, 3.0, 3.5, -1.0, 0.0])
    coefs = np.linalg.solve(plate.raw(centres), values)
    x = np.linspace(0, 11, 101)
    assert plate.raw(x) @ coefs == pytest.approx(natural.raw(x) @ values, abs=1e-9)
    assert coefs @ plate.penalty @ coefs == pytest.approx(values @ natural.penalty @ values, rel=1e-9)


def test_cut_thin_plate_against_dense():
    centres = np.sort(np.random.default_rng(5).uniform(-3, 40, 60))
    plate = ThinPlateBasis(centres, 9)
    assert np.linalg.matrix_rank(plate.raw(centres)) == 9
    line = np.linalg.lstsq(plate.raw(centres), 3 - 2 * centres, rcond=None)[0]
    assert plate.raw(centres) @ line == pytest.approx(3 - 2 * centres)
    assert line @ plate.penalty @ line == pytest.approx(0, abs=1e-9)
    # the span of the leading eigenvectors, without those that a line's moments forbid
    radial = np.abs(centres[:, None] - centres[None, :]) ** 3 / 12
    value, vector = np.linalg.eigh(radial)
    lead = vector[:, np.argsort(-np.abs(value))[:9]]
    sides = np.stack([np.ones(60), centres], axis=1)
    free = np.linalg.svd(sides.T @ lead)[2][2:].T
    dense = np.hstack([radial @ lead @ free, sides])
    shown = dense @ np.linalg.lstsq(dense, plate.raw(centres), rcond=None)[0]
    assert shown == pytest.approx(plate.raw(centres), abs=1e-7)
    d = np.random.default_rng(6).normal(size=7)
    u = lead @ free @ d
    shape = np.linalg.lstsq(plate.raw(centres), radial @ u, rcond=None)[0]
    assert shape @ plate.penalty @ shape == pytest.approx(u @ radial @ u, rel=1e-6)


def test_default_smooth_of_the_months_equals_the_cubic_one(spark):
    rng = np.random.default_rng(8)
    month = np.tile(np.arange(1, 13), 15)
    df = spark.createDataFrame(pd.DataFrame({"month": month, "y": rng.poisson(np.exp(1 + np.sin(month / 2)))}))
    plate, cubic = op.Smooth("month", k=12), op.Smooth("month", "cr", 12)
    assert plate.basis == "tp"
    a = op.poisson_gam(df, "y", [], [plate], smoothing={plate: 0.7})
    b = op.poisson_gam(df, "y", [], [cubic], smoothing={cubic: 0.7})
    one, two = a.models.first(), b.models.first()
    for c in ("edf", "deviance", "aic"):
        assert one[c] == pytest.approx(two[c], rel=1e-7)
    fit = {r["month"]: r["fit"] for r in b.residuals(df).collect()}
    assert all(r["fit"] == pytest.approx(fit[r["month"]], rel=1e-6) for r in a.residuals(df).collect())


def test_centres_beyond_the_limit_are_quantiles_of_the_values(rows):
    few = op.Smooth("x", k=5, most_centres=20)
    fits = op.poisson_gam(rows, "y", [], [few], smoothing={few: 1.0})
    assert len(fits.blocks[0].spline.centres) == 20 and fits.models.first()["n"] == 300
    with pytest.raises(ValueError):
        op.poisson_gam(rows.where("x < 0.2"), "y", [], [few], smoothing={few: 1.0})


# ------------------------------------------------------------ best subsets


def test_best_subsets_are_those_of_all(rows):
    terms = [f"v{i}" for i in range(6)]
    every, averaged, all_fits = op.model_selection(rows, "y", terms, ["x"])
    found, means, fits = op.model_selection(rows, "y", terms, ["x"], ignore=1e-4)
    assert len(all_fits.fitted) == 64
    assert len(fits.fitted) < 64
    columns = ["rank", "model_id", "aic", "delta", "weight", "cumulative"]
    a = every.where("in_set").select(columns).orderBy("rank").collect()
    b = found.where("in_set").select(columns).orderBy("rank").collect()
    assert [r["model_id"] for r in a] == [r["model_id"] for r in b]
    for p, q in zip(a, b):
        assert q["aic"] == pytest.approx(p["aic"], rel=1e-9) and q["weight"] == pytest.approx(p["weight"], rel=2e-4)
    one = {r["term"]: r["full_average"] for r in averaged.collect()}
    assert {r["term"]: r["full_average"] for r in means.collect()} == pytest.approx(one, rel=1e-3, abs=1e-9)
    left = 1 - sum(math.exp(-m.result["aic"] / 2 + a[0]["aic"] / 2) for m in fits.fitted.values()) / sum(
        math.exp(-m.result["aic"] / 2 + a[0]["aic"] / 2) for m in all_fits.fitted.values()
    )
    assert 0 <= left <= 1e-4


def test_best_subsets_with_copies_of_a_term(rows):
    df = rows.withColumn("twin", F.col("v0") * 2 + 1)
    every, _, _ = op.model_selection(df, "y", ["v0", "twin", "v1"])
    found, _, _ = op.model_selection(df, "y", ["v0", "twin", "v1"], ignore=1e-6)
    names = lambda t: sorted(r["model_id"] for r in t.where("in_set").collect())
    assert names(found) == names(every)


def test_smooths_have_no_bound(rows):
    with pytest.raises(ValueError):
        op.model_selection(rows, "y", ["v0", op.Smooth("x")], ignore=1e-6)


def test_large_counts_that_fit_closely_settle(spark):
    """Sums of y ln y of 10^9 against a deviance near 0: their difference is mere rounding."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(size=84), "z": rng.normal(size=84), "u": rng.normal(size=84)})
    pdf["y"] = np.round(np.exp(17 + 0.1 * pdf["x"] + 0.02 * pdf["z"]))
    df = spark.createDataFrame(pdf)
    found, _, fits = op.model_selection(df, "y", ["x", "z", "u"], ignore=1e-9)
    eta = {r["x"]: math.log(r["fit"]) for r in fits.residuals(df, "x + z").collect()}
    assert sorted(r["model_id"] for r in found.where("in_set").collect()) == ["x + z", "x + z + u"]
    assert max(abs(eta[x] - 17 - 0.1 * x - 0.02 * z) for x, z in zip(pdf["x"], pdf["z"])) < 1e-7
    best = fits.fitted["x + z"].result
    want = sum(2 * y * (math.expm1(d := eta[x] - math.log(y)) - d) for x, y in zip(pdf["x"], pdf["y"]))
    assert best["deviance"] == pytest.approx(want, abs=1e-7)
