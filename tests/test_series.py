"""Rank tests, lagged correlation, smoothing: against dense numpy code."""

from __future__ import annotations

import datetime as dt
import importlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalwise import operators as op
from shoalwise.functions.tails import inversion_shares, student_sf2

ordered = importlib.import_module("shoalwise.operators.ordered")


def kendall(t, x):
    s = sum(np.sign(x[j] - x[i]) for i in range(len(x)) for j in range(len(x)) if t[i] < t[j])
    n = len(x)
    _, c = np.unique(x, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - (c * (c - 1) * (2 * c + 5)).sum()) / 18
    pairs = n * (n - 1) / 2
    d = math.sqrt(pairs * (pairs - (c * (c - 1) / 2).sum()))
    return s, var, d


def test_mann_kendall_ties_and_null(spark):
    data = [(1, 3.0), (2, 1.0), (3, None), (4, 1.0), (5, 4.0), (6, float("nan")), (7, 6.0), (8, 6.0)]
    df = spark.createDataFrame(data, "t int, x double")
    r = op.mann_kendall(df, [], "t", "x").first()
    s, var, d = kendall([1, 2, 4, 5, 7, 8], np.array([3.0, 1, 1, 4, 6, 6]))
    assert (r["n"], r["s"]) == (6, s)
    assert r["var_s"] == pytest.approx(var)
    assert r["tau"] == pytest.approx(s / d)
    z = (s - 1) / math.sqrt(var)
    assert r["z"] == pytest.approx(z)
    assert r["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_mann_kendall_many_shapes(spark):
    rng = np.random.default_rng(4)
    data, want = [], {}
    for key, n, levels, span in (("short", 2, 5, 5), ("one", 1, 5, 5), ("flat", 30, 1, 40), ("long", 700, 60, 5000), ("wide", 90, 9, 2**33)):
        t = rng.choice(span, size=n, replace=False) - span // 2
        x = rng.integers(0, levels, n).astype(float)
        data += [(key, int(a), float(b)) for a, b in zip(t, x)]
        want[key] = kendall(t, x)
    df = spark.createDataFrame(data, "key string, t bigint, x double").repartition(5)
    got = {r["key"]: r for r in op.mann_kendall(df, "key", "t", "x", continuity=False).collect()}
    assert got.keys() == want.keys()
    for key, (s, var, d) in want.items():
        assert got[key]["s"] == s, key
        assert got[key]["var_s"] == pytest.approx(var)
        assert -1 <= (got[key]["tau"] or 0) <= 1
    assert got["flat"]["z"] is None and got["one"]["tau"] is None


def test_seasonal_mann_kendall_sums_seasons(spark):
    rng = np.random.default_rng(5)
    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 1), i % 12 + 1, float(rng.integers(0, 8))) for i in range(72)]
    df = spark.createDataFrame(rows, "date date, month int, x double")
    r = op.mann_kendall(df, [], "date", "x", season="month").first()
    parts = [kendall(range(6), np.array([v for _, m, v in rows if m == month])) for month in range(1, 13)]
    assert r["s"] == sum(p[0] for p in parts)
    assert r["var_s"] == pytest.approx(sum(p[1] for p in parts))
    assert r["tau"] == pytest.approx(r["s"] / sum(p[2] for p in parts))


def ccf(x, y, t, lag):
    n = len(x)
    at = {v: i for i, v in enumerate(t)}
    total = sum((x[at[v + lag]] - x.mean()) * (y[at[v]] - y.mean()) for v in t if v + lag in at)
    return total / (n * x.std() * y.std())


@pytest.mark.parametrize("index", ["calendar", "rows"])
def test_cross_correlation_with_gap(spark, monkeypatch, index):
    monkeypatch.setattr(ordered, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = rng.normal(size=200)
    t = np.array([i for i in range(-20, 170) if i != 30])
    x, y = base[t + 25], base[t + 22] + 0.1 * rng.normal(size=len(t))
    start = 1970 * 12
    data = [("k", dt.date((start + int(v)) // 12, (start + int(v)) % 12 + 1, 1), float(a), float(b)) for v, a, b in zip(t, x, y)]
    data.append(("k", dt.date(1972, 7, 1), None, 1.0))
    df = spark.createDataFrame(data, "key string, date date, x double, y double")
    got = {r["lag"]: r["r"] for r in op.cross_correlation(df, "key", "date", "x", "y", 70, index=index).collect()}
    assert sorted(got) == list(range(-70, 71))
    clock = t if index == "calendar" else np.arange(len(t))
    for lag in (-70, -33, -3, -1, 0, 1, 3, 17, 70):
        assert got[lag] == pytest.approx(ccf(x, y, clock.tolist(), lag))
    assert max(got, key=got.get) == -3
    corr = df.na.drop().agg(F.corr("x", "y")).first()[0]
    assert got[0] == pytest.approx(corr)


def test_cross_correlation_short_series(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0), (3, 5.0, 4.0)], "t int, x double, y double")
    got = op.cross_correlation(df, [], "t", "x", "y", 48).collect()
    assert sorted(r["lag"] for r in got) == [-2, -1, 0, 1, 2]


def test_cross_correlation_repeated_times(spark):
    """Rows that share a time are all paired, without being paired one by one."""
    rng = np.random.default_rng(10)
    t = rng.integers(0, 6, 120)
    x, y = rng.normal(size=120), rng.normal(size=120)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(t, x, y)], "t int, x double, y double")
    dx, dy = x - x.mean(), y - y.mean()
    for r in op.cross_correlation(df, [], "t", "x", "y", 3).collect():
        want = sum(dx[i] * dy[j] for i in range(120) for j in range(120) if t[i] - t[j] == r["lag"])
        assert r["r"] == pytest.approx(want / (120 * x.std() * y.std()))


@pytest.mark.parametrize("ties", [(1,), (3,), (1, 1, 1, 1), (2, 1, 3), (1, 2, 2, 1, 1), (3, 3, 1), (1,) * 8, (2, 3, 3)])
def test_exact_shares_by_enumeration(ties):
    values = [i for i, t in enumerate(ties) for _ in range(t)]
    orders = np.array(sorted(set(itertools.permutations(values))))
    n = len(values)
    inversions = sum((orders[:, i] > orders[:, j]).astype(int) for i in range(n) for j in range(i + 1, n)) + np.zeros(len(orders), int)
    shares = inversion_shares(ties)
    assert shares == pytest.approx(np.bincount(inversions, minlength=len(shares)) / len(orders))


def test_exact_mann_kendall(spark):
    """Two short seasons of one key by enumeration; long series and shared times have no exact p."""
    first, second = [3.0, 1.0, 2.0, 2.0, 5.0], [1.0, 4.0, 4.0, 6.0]
    data = [("a", 1, i, v) for i, v in enumerate(first)] + [("a", 2, i, v) for i, v in enumerate(second)]
    data += [("long", 1, i, float(i)) for i in range(9)] + [("same", 1, i // 2, float(i)) for i in range(4)]
    data += [(None, 1, i, float(i % 3)) for i in range(6)] + [("a", 1, 99, None), ("single", 1, 0, 1.0)]
    df = spark.createDataFrame(data, "key string, m int, t int, x double")

    def score(v):
        return sum(np.sign(v[j] - v[i]) for i in range(len(v)) for j in range(i + 1, len(v)))

    def share(*series):
        sums = [sum(score(o) for o in orders) for orders in itertools.product(*[list(itertools.permutations(v)) for v in series])]
        return np.mean([abs(s) >= abs(sum(score(v) for v in series)) for s in sums])

    got = {r["key"]: r for r in op.mann_kendall(df, "key", "t", "x", season="m", exact_up_to=8).collect()}
    assert got["a"]["exact_p"] == pytest.approx(share(first, second))
    assert got[None]["exact_p"] == pytest.approx(share([0.0, 1.0, 2.0, 0.0, 1.0, 2.0]))
    assert got["long"]["exact_p"] is None and got["same"]["exact_p"] is None
    assert got["single"]["exact_p"] == 1
    one = df.where("key = 'a' and m = 1")
    assert op.mann_kendall(one, [], "t", "x", exact_up_to=8).collect()[0]["exact_p"] == pytest.approx(share(first))
    assert op.mann_kendall(one, [], "t", "x", season="m", exact_up_to=8).collect()[0]["exact_p"] == pytest.approx(share(first))
    assert "exact_p" not in op.mann_kendall(one, "key", "t", "x").columns


def loess(x, y, g, span):
    q = max(int(math.floor(len(x) * min(span, 1) + 1e-5)), 1)
    h = np.sort(np.abs(x - g))[q - 1] * max(span, 1)
    u = (x - g) / h
    w = np.where(np.abs(u) < 1, (1 - np.abs(u) ** 3) ** 3, 0)
    X = np.vander(u, 3, increasing=True) * np.sqrt(w)[:, None]
    return np.linalg.lstsq(X, y * np.sqrt(w), rcond=None)[0][0]


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("span", [0.3, 0.75])
def test_local_smooth(spark, monkeypatch, whole, span):
    monkeypatch.setattr(ordered, "BLOCK", 32)
    rng = np.random.default_rng(7)
    frames, data = {}, []
    for key, n in (("a", 400), ("b", 25)):
        x = rng.integers(0, 120, n) if whole else np.exp(rng.normal(size=n) * 1.5)
        y = np.sin(x / 20.0) + rng.normal(size=n)
        frames[key] = (np.asarray(x, float), y)
        data += [(key, int(a) if whole else float(a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(data, f"key string, x {'int' if whole else 'double'}, y double")
    got = op.local_smooth(df, "key", "x", "y", span=span, points=15).collect()
    assert len(got) == 30
    for r in got:
        x, y = frames[r["key"]]
        assert r["value"] == pytest.approx(loess(x, y, r["x"], span), rel=1e-6, abs=1e-8)


@pytest.mark.parametrize("whole", [True, False])
def test_local_smooth_band(spark, monkeypatch, whole):
    """Against the whole smoother of all rows: L, and both deltas from (I - L)(I - L)'."""
    monkeypatch.setattr(ordered, "BLOCK", 32)
    rng = np.random.default_rng(17)
    frames, data = {}, [("a", None, 1.0), ("a", 3, None), ("a", 3, float("nan")), ("one", 5, 1.0), ("one", 5, 2.0)]
    for key, n in (("a", 300), (None, 40)):
        x = rng.integers(0, 90, n) if whole else np.exp(rng.normal(size=n))
        y = np.sin(x / 20.0) + rng.normal(size=n)
        frames[key] = (np.asarray(x, float), y)
        data += [(key, int(a) if whole else float(a), float(b)) for a, b in zip(x, y)]
    data = [(k, a if a is None or whole else float(a), b) for k, a, b in data]
    df = spark.createDataFrame(data, f"key string, x {'int' if whole else 'double'}, y double")
    got = op.local_smooth_band(df, "key", "x", "y", points=20, level=0.9).collect()
    assert all(r["std_error"] is None or r["std_error"] > 0 for r in got)
    assert [r["fit"] for r in got if r["key"] == "one"] == pytest.approx([1.5])
    for key, (x, y) in frames.items():
        rows = sorted((r for r in got if r["key"] == key), key=lambda r: r["x"])
        grid = np.array([r["x"] for r in rows])
        assert len(rows) == 20
        V = np.array([[loess(x, e, g, 0.75) for e in np.eye(len(x))] for g in grid])
        PHI = np.array([np.interp(x, grid, e) for e in np.eye(20)]).T
        rest = np.eye(len(x)) - PHI @ V
        A = rest @ rest.T
        one, two = np.trace(A), (A * A).sum()
        scale = math.sqrt(((rest @ y) ** 2).sum() / one)
        for i, r in enumerate(rows):
            se = scale * math.sqrt((V[i] ** 2).sum())
            assert r["fit"] == pytest.approx(V[i] @ y, rel=1e-6, abs=1e-8)
            assert (r["std_error"], r["residual_df"], r["scale"]) == pytest.approx((se, one * one / two, scale), rel=1e-6)
            half = r["upper"] - r["fit"]
            assert half == pytest.approx(r["fit"] - r["lower"])
            assert float(student_sf2(half / se, r["residual_df"])[0]) == pytest.approx(0.1, abs=1e-6)
    assert op.local_smooth_band(df.limit(0), "key", "x", "y").count() == 0
    plain = {r["x"]: r["value"] for r in op.local_smooth(df.where("key = 'a'"), [], "x", "y", points=20).collect()}
    alone = {r["x"]: r["fit"] for r in op.local_smooth_band(df.where("key = 'a'"), [], "x", "y", points=20).collect()}
    assert plain == pytest.approx(alone)


def nrd0(x):
    q = np.percentile(x, [25, 75])
    return 0.9 * min(x.std(ddof=1), (q[1] - q[0]) / 1.34) * len(x) ** -0.2


def test_density_and_bandwidth(spark):
    rng = np.random.default_rng(8)
    parts = {2000: rng.normal(10, 2, 300).round(1), 2001: rng.gamma(3, 4, 150).round(1)}
    df = spark.createDataFrame([(k, float(v)) for k, a in parts.items() for v in a], "year int, x double")
    widths = {r["year"]: r["bandwidth"] for r in op.bandwidths(df, "year", "x").collect()}
    for k, a in parts.items():
        assert widths[k] == pytest.approx(nrd0(a))
    b = np.mean([nrd0(a) for a in parts.values()])
    got = op.density(df, "year", "x", points=64).collect()
    assert len(got) == 128
    for r in got:
        a = parts[r["year"]]
        want = np.exp(-(((r["x"] - a) / b) ** 2) / 2).sum() / (len(a) * b * math.sqrt(2 * math.pi))
        assert r["value"] == pytest.approx(want, rel=1e-9, abs=1e-15)
    lo, hi = min(a.min() for a in parts.values()), max(a.max() for a in parts.values())
    assert min(r["x"] for r in got) == pytest.approx(lo - 3 * b)
    assert max(r["x"] for r in got) == pytest.approx(hi + 3 * b)


def test_quantiles_positions_and_running_totals(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 16)
    rng = np.random.default_rng(9)
    data = [("hot" if i % 3 else f"k{i % 7}", float(rng.integers(0, 40))) for i in range(3000)]
    df = spark.createDataFrame(data, "key string, x double").repartition(6)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for r in op.exact_quantiles(df, "key", "x", probs).collect():
        want = np.quantile([v for k, v in data if k == r["key"]], probs)
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(want.tolist())
    alone = op.exact_quantiles(df, [], "x", [0.5]).first()["q0"]
    assert alone == pytest.approx(np.median([v for _, v in data]))
    index = spark.range(0, 500, 3).select((F.col("id") - 100).alias("t"))
    got = [r["position"] for r in ordered.position(index, [], "t").orderBy("t").collect()]
    assert got == list(range(1, 168))
    line = ordered.number_line(spark.createDataFrame([("a", 40), ("b", 0), ("c", 1)], "k string, n bigint"), ["k"], "n", "i")
    assert [(r["k"], r["i"]) for r in line.orderBy("k", "i").collect()] == [("a", i) for i in range(1, 41)] + [("c", 1)]


def test_reference_line(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 7.0)], "k string, v double")
    assert rows(op.reference_line(df, "k", "v"), "k", "v", "reference") == [
        ("a", 1.0, 2.0), ("a", 3.0, 2.0), ("a", None, 2.0), ("b", 7.0, 7.0)
    ]
