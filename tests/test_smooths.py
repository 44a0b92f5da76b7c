"""Tests of smooths, and Gaussian smooths with their band, against dense computation."""

from __future__ import annotations

import math

import numpy as np
import pytest

from shoalwise import operators as op
from shoalwise.functions.tails import chi_mixture_sf, chi_square_sf, student_ppf2
from shoalwise.operators.poisson import SplineBasis, smooth_test


def test_chi_square_tails():
    assert chi_square_sf(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-13)
    assert chi_square_sf(40.0, 2) == pytest.approx(math.exp(-20), rel=1e-12)
    assert chi_square_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-10)
    assert chi_square_sf(2.5, 4) == pytest.approx(math.exp(-1.25) * 2.25, rel=1e-12)


@pytest.mark.parametrize("whole,first,second", [(0, 0.7, 0.7), (1, 1.0, 1.0), (3, 1.0, 1.0), (2, 1.0, 0.0), (5, 1.0, 1e-9)])
def test_mixture_is_a_chi_square_at_equal_weights(whole, first, second):
    for q in (0.5, 3.0, 12.0, 40.0):
        ends = {0.7: (q / 0.7, 2), 1.0: (q, whole + 2)}
        value, df = ends[first] if first == second else (q, whole + 1)
        assert chi_mixture_sf(q, whole, first, second) == pytest.approx(chi_square_sf(value, df), rel=1e-3 if second < 1e-3 else 1e-9)


def test_mixture_against_simulation():
    rng = np.random.default_rng(1)
    draws = rng.chisquare(3, 400_000) + 0.95 * rng.chisquare(1, 400_000) + 0.35 * rng.chisquare(1, 400_000)
    for q in (2.0, 5.0, 10.0):
        assert chi_mixture_sf(q, 3, 0.95, 0.35) == pytest.approx((draws > q).mean(), abs=0.003)


def test_smooth_test_at_whole_rank_is_the_plain_wald_test():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    gram = x.T @ x
    cov, beta = np.linalg.inv(gram), rng.normal(size=4) / 10
    reference, statistic, p = smooth_test(beta, cov, gram, np.arange(1, 4))
    assert reference == pytest.approx(3)
    # without a penalty the block of the covariance is inverted as a whole
    assert statistic == pytest.approx(beta[1:] @ np.linalg.inv(cov[1:, 1:]) @ beta[1:])
    assert p == pytest.approx(chi_square_sf(statistic, 3))


@pytest.mark.parametrize("penalty_share,most", [(2e-5, 0.05), (0.05, None)])
def test_smooth_test_of_noise(penalty_share, most):
    """Under the null, p is about uniform with little penalty, and too large rather than too small with more."""
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 1, 200))
    basis = SplineBasis(np.linspace(0, 1, 8), False)
    basis.absorb(basis.raw(x).sum(axis=0))
    design = np.column_stack([np.ones(200), basis(x)])
    penalty = np.zeros((8, 8))
    penalty[1:, 1:] = basis.null.T @ basis.penalty @ basis.null * penalty_share
    gram = design.T @ design
    cov = np.linalg.inv(gram + penalty)
    found = []
    for _ in range(800):
        beta = cov @ design.T @ rng.normal(size=200)
        reference, _, p = smooth_test(beta, cov, gram, np.arange(1, 8))
        found.append(p)
    assert 2 < reference < 7 and reference != int(reference)
    for level in (0.05, 0.2, 0.5, 0.8):
        share = np.mean(np.array(found) < level)
        assert share < level + 0.05
        assert most is None or share > level - most


def test_fits_carry_tests_of_their_smooths(spark):
    rng = np.random.default_rng(4)
    a, b = np.round(rng.uniform(0, 1, 300), 2), np.round(rng.uniform(0, 1, 300), 2)
    counts = rng.poisson(np.exp(1 + np.sin(6 * a)))
    rows = [(float(x), float(z), int(c)) for x, z, c in zip(a, b, counts, strict=True)]
    df = spark.createDataFrame(rows, "x double, z double, y int")
    first, second = op.Smooth("x", "cr", 8), op.Smooth("z", "cr", 8)
    fits = op.poisson_gam(df, "y", [], [first, second], smoothing={first: 0.01, second: 0.01})
    got = {r["term"]: r for r in fits.smooths.collect()}
    assert got["s(x)"]["p"] < 1e-6 < 0.01 < got["s(z)"]["p"]
    assert got["s(x)"]["edf"] < got["s(x)"]["ref_df"] < 7


def dense_smooth(x, y, knots, smoothing, grid):
    basis = SplineBasis(knots, False)
    design, penalty = basis.raw(x), basis.penalty
    inverse = np.linalg.inv(design.T @ design + smoothing * penalty)
    beta = inverse @ design.T @ y
    rss, edf = float(((y - design @ beta) ** 2).sum()), float(np.trace(inverse @ design.T @ design))
    at = basis.raw(grid)
    scale = rss / (len(y) - edf)
    return at @ beta, np.sqrt(scale * np.einsum("ij,jk,ik->i", at, inverse, at)), len(y) * rss / (len(y) - edf) ** 2, edf


def test_gaussian_smooths_against_dense(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n, freq in (("a", 150, 6.0), (None, 90, 2.0)):
        x = np.round(rng.uniform(0, 10, n), 1)
        rows += [(key, float(v), float(50 + np.sin(freq * v / 10) + rng.normal() / 3)) for v in x]
    odd = [("a", None, 1.0), ("a", 1.0, None), ("a", float("nan"), 1.0), *[("few", float(i % 3), 1.0) for i in range(9)]]
    df = spark.createDataFrame(rows + odd, "k string, x double, y double")
    for given in (None, 0.5):
        found = op.gaussian_smooth(df, "k", "x", "y", k=9, points=20, smoothing=given)
        models = {r["k"]: r for r in found.models.collect()}
        assert set(models) == {"a", None}
        bands = found.band.orderBy("x").collect()
        for key in ("a", None):
            x = np.array([r[1] for r in rows if r[0] == key])
            y = np.array([r[2] for r in rows if r[0] == key])
            knots = np.quantile(np.unique(x), np.linspace(0, 1, 9))
            grid = np.linspace(x.min(), x.max(), 20)
            m = models[key]
            fit, se, gcv, edf = dense_smooth(x, y, knots, m["smoothing"], grid)
            mine = [r for r in bands if r["k"] == key]
            assert np.allclose([r["fit"] for r in mine], fit, rtol=1e-9) and np.allclose([r["se"] for r in mine], se, rtol=1e-7)
            assert m["edf"] == pytest.approx(edf, rel=1e-8) and m["gcv"] == pytest.approx(gcv, rel=1e-8) and m["n"] == len(x)
            t = student_ppf2(0.95, np.array([len(x) - edf]))[0]
            assert np.allclose([r["upper"] - r["fit"] for r in mine], t * se, rtol=1e-6)
            if given is None:
                assert not m["at_bound"]
                for step in (-0.5, -0.05, 0.05, 0.5):  # the least GCV
                    assert dense_smooth(x, y, knots, m["smoothing"] * math.exp(step), grid)[2] > gcv
    assert op.gaussian_smooth(df.limit(0), "k", "x", "y").band.count() == 0
