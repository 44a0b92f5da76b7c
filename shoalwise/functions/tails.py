"""Tail probabilities of the normal and Student t distributions.

Spark has no such functions.  These are Arrow-batched and are only applied to
fitted rows (one per model term), never to observations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])


def normal_sf2(z: np.ndarray) -> np.ndarray:
    """P(|Z| > |z|)."""
    return _ERFC(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def beta_regularized(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, x = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, b, x))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(
        _LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(inside) + b * np.log1p(-inside)
    )
    low = inside < (a + 1.0) / (a + b + 2.0)
    direct = front * _beta_fraction(a, b, np.where(low, inside, 0.5)) / a
    mirror = 1.0 - front * _beta_fraction(b, a, np.where(low, 0.5, 1.0 - inside)) / b
    out = np.where(low, direct, mirror)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def student_sf2(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) with ``df`` degrees of freedom; NaN where df < 1."""
    t = np.atleast_1d(np.asarray(t, float))
    df = np.broadcast_to(np.asarray(df, float), t.shape)
    ok = np.isfinite(t) & (df > 0)
    dd = np.where(ok, df, 1.0)
    tt = np.where(ok, t, 0.0)
    p = beta_regularized(dd / 2.0, np.full_like(dd, 0.5), dd / (dd + tt * tt))
    p = np.where(ok, p, np.nan)
    return np.where(np.isinf(t) & (df > 0), 0.0, p)


def student_ppf2(level: float, df: np.ndarray) -> np.ndarray:
    """t with P(|T| <= t) = level, by bisection on the tail."""
    df = np.atleast_1d(np.asarray(df, float))
    ok = df > 0
    dd = np.where(ok, df, 1.0)
    lo = np.zeros_like(dd)
    hi = np.full_like(dd, 2.0)
    while True:
        short = student_sf2(hi, dd) > 1.0 - level
        if not short.any():
            break
        hi = np.where(short, hi * 4.0, hi)
    for _ in range(200):
        mid = (lo + hi) / 2.0
        above = student_sf2(mid, dd) > 1.0 - level
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(ok, (lo + hi) / 2.0, np.nan)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi_square_sf(q: float, df: float) -> float:
    """P(X > q) of a chi-square variable."""
    return gamma_upper(df / 2, q / 2)


def chi_mixture_sf(q: float, whole: int, first: float, second: float) -> float:
    """P(A + first * B + second * C > q) for a chi-square A with ``whole`` degrees of freedom, B and C with one.

    B and C are a circle of directions with a common exponential length, so
    the tail is a mean over directions of a one-dimensional integral.
    """
    if q <= 0:
        return 1.0
    angles = (np.arange(256) + 0.5) * (math.pi / 256)
    w = np.maximum(first * np.cos(angles) ** 2 + second * np.sin(angles) ** 2, 1e-12)
    if whole == 0:
        return float(np.exp(-q / (2 * w)).mean())
    # a = q s^2 takes the density's pole at 0 away
    nodes, weights = np.polynomial.legendre.leggauss(200)
    s = (nodes + 1) / 2
    a = q * s * s
    log_density = (whole / 2 - 1) * np.log(a) - a / 2 - whole / 2 * math.log(2) - math.lgamma(whole / 2)
    inner = np.exp(log_density[None, :] - (q - a)[None, :] / (2 * w[:, None])) @ (weights / 2 * 2 * q * s)
    return chi_square_sf(q, whole) + float(inner.mean())


@lru_cache(maxsize=4096)
def inversion_shares(ties: tuple[int, ...]) -> np.ndarray:
    """Shares of the orders of n values by their number of inversions, from none to all untied pairs.

    ``ties`` are the sizes of the groups of equal values, which add up to n.
    Inserting value by value multiplies the counts by 1 + q + ... + q^(j-1) at
    the j-th; the same product of every tied group is divided out.  As power
    series these are factors 1 - q^j and 1 / (1 - q^i), exact in whole numbers.
    """
    n = sum(ties)
    pairs = (n * (n - 1) - sum(t * (t - 1) for t in ties)) // 2
    counts = [1] + [0] * pairs
    for j in range(1, n + 1):
        for k in range(pairs, j - 1, -1):
            counts[k] -= counts[k - j]
    for i in (i for t in ties for i in range(1, t + 1)):
        for k in range(i, pairs + 1):
            counts[k] += counts[k - i]
    total = sum(counts)
    return np.array([c / total for c in counts])


def kendall_exact_p(series: Sequence[Sequence[int]], s: int) -> float:
    """P(|S| >= |s|) over all orders within each of several series, from the sizes of their tied groups."""
    shares = np.ones(1)
    for ties in series:
        shares = np.convolve(shares, inversion_shares(tuple(sorted(int(t) for t in ties))))
    pairs = len(shares) - 1
    return min(1.0, float(shares[np.abs(pairs - 2 * np.arange(pairs + 1)) >= abs(s)].sum()))


def _nullable(values: np.ndarray) -> pd.Series:
    return pd.Series(values, dtype="float64").astype(object).where(np.isfinite(values), None)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _nullable(normal_sf2(z.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(student_sf2(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def student_quantile(level: pd.Series, df: pd.Series) -> pd.Series:
    lv = level.to_numpy(float)
    dof = df.to_numpy(float)
    out = np.full(len(lv), np.nan)
    for one in np.unique(lv):
        pick = lv == one
        out[pick] = student_ppf2(float(one), dof[pick])
    return _nullable(out)


@F.pandas_udf(T.DoubleType())
def kendall_exact(ties: pd.Series, s: pd.Series) -> pd.Series:
    return pd.Series([kendall_exact_p(t, int(v)) for t, v in zip(ties, s, strict=True)], dtype="float64")
