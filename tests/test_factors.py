"""Factors side by side against dense least squares."""

from __future__ import annotations

import numpy as np
import pytest

from shoalwise import operators as op
from shoalwise.operators import factors


def dense_fit(columns, y, w=None):
    X = np.column_stack(columns)
    w = np.ones(len(y)) if w is None else np.asarray(w)
    gram = X.T @ (X * w[:, None])
    b = np.linalg.solve(gram, X.T @ (w * y))
    rss = float((w * (y - X @ b) ** 2).sum())
    s2 = rss / (len(y) - X.shape[1])
    return b, np.sqrt(s2 * np.diag(np.linalg.inv(gram))), rss


def made(seed, n, a, b, holes=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        f, g = int(rng.integers(a)), int(rng.integers(b))
        if holes and (f + g) % 3 == 0 and f % 2:
            g = (g + 1) % b
        x = float(rng.normal() + 0.1 * f)
        rows.append((f, f"g{g:02d}", x, float(2 * x + 0.3 * f - 0.5 * g + rng.normal()), float(rng.uniform(0.5, 3))))
    return rows


def expected(rows, weighted=False):
    fs, gs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    cols = [np.ones(len(rows)), [r[2] for r in rows]]
    names = ["(Intercept)", "x"]
    for f in fs[1:]:
        cols.append([float(r[0] == f) for r in rows])
        names.append(f"f{f}")
    for g in gs[1:]:
        cols.append([float(r[1] == g) for r in rows])
        names.append(f"g{g}")
    b, se, rss = dense_fit(cols, np.array([r[3] for r in rows]), [r[4] for r in rows] if weighted else None)
    return dict(zip(names, zip(b, se, strict=True), strict=True)), rss, len(names)


@pytest.mark.parametrize("dense", [64, 0])
@pytest.mark.parametrize("weights", [None, "w"])
def test_two_factors(spark, dense, weights):
    rows = made(1, 600, 14, 9)
    df = spark.createDataFrame([*rows, (None, "g00", 1.0, 1.0, 1.0), (1, "g00", None, 1.0, 1.0)], "f int, g string, x double, y double, w double")
    want, rss, size = expected(rows, weights is not None)
    got = {r["term"]: r for r in op.ols(df, [], "y", ["x"], factors=["g", "f"], weights=weights, dense_levels=dense).collect()}
    assert set(got) == set(want)
    for term, (b, se) in want.items():
        assert got[term]["estimate"] == pytest.approx(b, rel=1e-7, abs=1e-8)
        if dense or term == "x":
            assert got[term]["std_error"] == pytest.approx(se, rel=1e-7)
        else:
            assert got[term]["std_error"] is None
    if weights is None:
        s = op.ols_summary(df, [], "y", ["x"], ["f", "g"], dense_levels=dense).first()
        y = np.array([r[3] for r in rows])
        assert s["n"] == 600 and s["deviance"] == pytest.approx(rss, rel=1e-9)
        assert s["null_deviance"] == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-9)
        assert s["sigma"] == pytest.approx(np.sqrt(rss / (600 - size)), rel=1e-9)


@pytest.mark.parametrize("dense", [64, 0])
def test_keys_have_their_own_levels_and_aliases(spark, dense):
    one, two = made(2, 200, 6, 4, False), [r for r in made(3, 150, 5, 5) if r[0] > 0 and r[1] > "g01"]
    df = spark.createDataFrame([("a", *r, 7.0) for r in one] + [(None, *r, float(r[0])) for r in two], "k string, f int, g string, x double, y double, w double, z double")
    got = {(r["k"], r["term"]): r for r in op.ols(df, "k", "y", ["x", "z"], factors=["f", "g"], dense_levels=dense).collect()}
    for key, rows in (("a", one), (None, two)):
        want, _, _ = expected(rows)
        for term, (b, _) in want.items():
            assert got[key, term]["estimate"] == pytest.approx(b, rel=1e-7, abs=1e-7)
        assert got[key, "z"]["estimate"] is None  # constant within f
        assert len([t for k, t in got if k == key]) == len(want) + 1


def test_three_factors(spark):
    rng = np.random.default_rng(5)
    rows = [(*r, int(rng.integers(3))) for r in made(4, 500, 12, 10)]
    df = spark.createDataFrame(rows, "f int, g string, x double, y double, w double, h int")
    a = {r["term"]: r["estimate"] for r in op.ols(df, [], "y", ["x"], factors=["f", "g", "h"]).collect()}
    b = {r["term"]: r["estimate"] for r in op.ols(df, [], "y", ["x"], factors=["h", "f", "g"], dense_levels=3).collect()}
    assert a.keys() == b.keys() and {"h1", "h2", "f3", "gg05"} < a.keys()
    for term, value in a.items():
        assert b[term] == pytest.approx(value, rel=1e-6, abs=1e-8)
    with pytest.raises(ValueError, match="levels beside two larger"):
        op.ols(df, [], "y", ["x"], factors=["h", "f", "g"], dense_levels=2)


def test_unconnected_levels_have_no_contrast(spark):
    rows = [(f, f"g{g}", float(f * g % 5), float(f + g + (f * g) % 3), 1.0) for f in range(6) for g in range(6) if (f < 3) == (g < 3)]
    df = spark.createDataFrame(rows, "f int, g string, x double, y double, w double")
    got = {r["term"]: r["estimate"] for r in op.ols(df, [], "y", [], factors=["f", "g"], dense_levels=0).collect()}
    assert got["f1"] is not None and got["gg2"] is not None and got["f4"] is None and got["gg5"] is None
    s = op.ols_summary(df, [], "y", [], factors=["f", "g"], dense_levels=0).first()
    assert s["n"] == 18 and s["sigma"] == pytest.approx(np.sqrt(s["deviance"] / (18 - 10)))


def test_ten_thousand_levels_each(spark):
    """Two factors of 10,000 levels: the normal equations hold at the end, level by level."""
    from pyspark.sql import functions as F

    n = 10_000
    lot = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(m))
    df = spark.range(60_000).select((F.col("id") % n).alias("f"), lot(0, n).alias("g"), (lot(1, 1000) / 500 - 1).alias("x"), (lot(2, 1000) / 1000).alias("e"))
    df = df.select("f", "g", "x", (2 * F.col("x") + F.col("f") % 7 - F.col("g") % 5 + F.col("e")).alias("y"))
    terms = op.ols(df, [], "y", ["x"], factors=["f", "g"]).toPandas().set_index("term")["estimate"]
    rows = df.toPandas()
    effect = lambda name, levels: np.array([terms.get(f"{name}{v}", 0.0) for v in levels])
    fit = terms["(Intercept)"] + terms["x"] * rows["x"] + effect("f", rows["f"]) + effect("g", rows["g"])
    rows["left"] = rows["y"] - fit
    assert abs((rows["left"] * rows["x"]).sum()) < 1e-5
    assert rows.groupby("f")["left"].sum().abs().max() < 1e-6 and rows.groupby("g")["left"].sum().abs().max() < 1e-6
    assert factors.level_counts(df, ["f"]) == {"f": n} and len(terms) > 19_900


def poisson_rows(seed, n, a, b):
    rng = np.random.default_rng(seed)
    f, g, x = rng.integers(0, a, n), rng.integers(0, b, n), np.round(rng.normal(size=n), 1)
    mu = np.exp(1.2 + 0.3 * x + 0.1 * (f % 5) - 0.15 * (g % 4))
    return [(int(i), f"g{j:02d}", float(v), int(c)) for i, j, v, c in zip(f, g, x, rng.poisson(mu), strict=True)]


def test_poisson_two_factors_against_dense(spark):
    df = spark.createDataFrame([*poisson_rows(1, 400, 6, 4), (None, "g00", 1.0, 3), (2, "g01", 1.0, None)], "f int, g string, x double, y int")
    dense = op.poisson_glm(df, "y", ["x"], factors=["f", "g"])
    free = op.poisson_glm(df, "y", ["x"], factors=["g", "f"], dense_levels=0)
    want = {r["term"]: r for r in dense.terms.collect()}
    got = {r["term"]: r for r in free.terms.collect()}
    assert want.keys() == got.keys()
    for term, r in want.items():
        assert got[term]["estimate"] == pytest.approx(r["estimate"], rel=1e-6, abs=1e-7)
    for column in ("std_error", "z", "p"):
        assert got["x"][column] == pytest.approx(want["x"][column], rel=1e-5)
    a, b = dense.models.first(), free.models.first()
    for column in ("n", "edf", "deviance", "null_deviance", "deviance_explained", "loglik", "aic", "ubre"):
        assert b[column] == pytest.approx(a[column], rel=1e-8)
    assert b["converged"]
    left = {(r["f"], r["g"], r["x"], r["y"]): r["residual"] for r in dense.residuals(df).collect()}
    for r in free.residuals(df).collect():
        wanted = left[r["f"], r["g"], r["x"], r["y"]]
        assert r["residual"] is None if wanted is None else r["residual"] == pytest.approx(wanted, abs=1e-5)
