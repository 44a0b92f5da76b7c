"""Local regression and kernel density, as numbers on a grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwise.frames import as_list, attach, durable, null_safe_join
from shoalwise.functions.columns import missing_as_null
from shoalwise.functions.tails import student_ppf2
from shoalwise.operators.ordered import BLOCK, cumulative_weights, exact_quantiles, running_in_blocks
from shoalwise.operators.regression import each_group


def _is_whole(df: DataFrame, column: str) -> bool:
    whole = (T.DateType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return isinstance(df.schema[column].dataType, whole)


def _as_number(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.DateType):
        return F.unix_date(column).cast("double")
    return missing_as_null(F.col(column).cast("double"))


def _neighbour_spans(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """For every x the nearest x' >= x such that [x, x'] holds q points.

    x' sits at the rank q - 1 above the first rank of x.  It is the largest
    value whose first rank is not above that: values and look-ups are put on
    one line of ranks, and a running maximum over blocks of ranks answers all.
    """
    first = F.col("__upto") - F.col("__n") + 1
    wanted = first + F.col("__q") - 1
    values = ranked.select(
        *keys, "__lo", "__hi", "__size", first.alias("__rank"),
        F.col("__x").alias("__value"), F.lit(None).cast("double").alias("__left"),
    )
    starts = ranked.where(wanted <= F.col("__size")).select(
        *keys, "__lo", "__hi", "__size", wanted.alias("__rank"),
        F.lit(None).cast("double").alias("__value"), F.col("__x").alias("__left"),
    )
    width = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("__size")))
    line = values.unionByName(starts).withColumn("__block", F.floor(F.col("__rank") / width))
    answered = running_in_blocks(line, keys, "__block", "__rank", F.col("__value"), "__right", "max")
    return answered.where(F.col("__left").isNotNull())


def _merged(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One row per key and distinct x: rows, sum of y, and squares of y around its mean there."""
    rows = (
        df.select(*keys, _as_number(df, x).alias("__x"), missing_as_null(F.col(y).cast("double")).alias("__y"))
        .na.drop("any", subset=["__x", "__y"])
        .groupBy(*keys, "__x")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.sum("__y").alias("__y"),
            (F.var_pop("__y") * F.count(F.lit(1))).alias("__within"),
        )
    )
    return durable(rows)


def _grid(rows: DataFrame, keys: list[str], whole: bool, span: float, points: int) -> DataFrame:
    """Per key the grid points g with the width h of their neighbourhoods."""
    if whole:
        blocked = rows.withColumn("__block", F.floor(F.col("__x") / BLOCK))
        ranked = running_in_blocks(blocked, keys, "__block", "__x", F.col("__n"), "__upto").drop("__block")
    else:
        ranked = cumulative_weights(rows, keys, "__x", "__n", "__upto")
    stats = rows.groupBy(*keys).agg(
        F.sum("__n").alias("__size"),
        F.count(F.lit(1)).alias("__distinct"),
        F.min("__x").alias("__lo"),
        F.max("__x").alias("__hi"),
    )
    reach = F.floor(F.col("__size") * min(span, 1.0) + 1e-5)
    stats = stats.withColumn("__q", F.greatest(reach, F.lit(1)))
    spans = _neighbour_spans(attach(ranked, stats, keys), keys)

    share = [k / max(points - 1, 1) for k in range(points)]
    least = [
        f"min(greatest(__lo + (__hi - __lo) * {s!r}D - __left, __right - __lo - (__hi - __lo) * {s!r}D))" for s in share
    ]
    grid = [f"struct(__lo + (__hi - __lo) * {s!r}D AS g, __h[{k}] * {max(span, 1.0)!r}D AS h)" for k, s in enumerate(share)]
    return (
        spans.groupBy(*keys)
        .agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.expr(f"array({', '.join(least)})").alias("__h"))
        .select(*keys, F.expr(f"array({', '.join(grid)})").alias("__grid"))
    )


def _moments(rows: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and grid point x of width h: tricube moments s of the scaled distance, and t of those times y."""
    placed = attach(rows, grid, keys).select(*keys, "__x", "__n", "__y", F.inline("__grid"))
    u = F.try_divide(F.col("__x") - F.col("g"), F.col("h"))
    u = F.when(F.col("h") > 0, u).when(F.col("__x") == F.col("g"), 0.0)
    near = placed.withColumn("__u", u).where(F.abs("__u") < 1)
    cube = F.abs("__u") * F.col("__u") * F.col("__u")
    w = (1 - cube) * (1 - cube) * (1 - cube)
    v = F.col("__u")
    powers = [F.lit(1.0), v, v * v, v * v * v, v * v * v * v]
    return (
        near.withColumn("__w", w)
        .groupBy(*keys, F.col("g").alias("x"), "h")
        .agg(
            F.array(*[F.sum(F.col("__w") * F.col("__n") * p) for p in powers]).alias("s"),
            F.array(*[F.sum(F.col("__w") * F.col("__y") * p) for p in powers[:3]]).alias("t"),
        )
    )


def _weights(s: Sequence[float]) -> np.ndarray:
    """What gives a point's fit from its three sums with y.

    With fewer than three distinct points near, it is that of the least-norm fit.
    """
    gram = np.array([[s[i + j] for j in range(3)] for i in range(3)])
    return np.linalg.pinv(gram, rcond=1e-10, hermitian=True)[0]


def local_smooth(
    df: DataFrame,
    keys: str | Sequence[str],
    x: str,
    y: str,
    span: float = 0.75,
    points: int = 80,
) -> DataFrame:
    """Local quadratic regression at evenly spaced points between the ends of x.

    At each point the ``span`` share of nearest rows is fitted with tricube
    weights.  Rows shrink to one per distinct x; the width of each
    neighbourhood is the least max(g - x_i, x_(i+q-1) - g) over runs of q
    points, a minimum that combines on the map side; the fits need eight sums.
    A date x is counted in days.
    """
    keys = as_list(keys)
    rows = _merged(df, keys, x, y)
    sums = _moments(rows, _grid(rows, keys, _is_whole(df, x), span, points), keys).drop("h")

    def solve(row: dict) -> list[tuple]:
        return [(float(_weights(row["s"]) @ np.array(row["t"])),)]

    return each_group(sums, [*keys, "x"], [T.StructField("value", T.DoubleType())], solve)


def _operator_sums(row: dict) -> np.ndarray:
    """What one block of a key's rows adds to the products of its smoother, packed into one array.

    The fit at any x lies on the straight lines between the grid's fits, so the
    smoother of n rows is L = PHI V: V holds each grid point's weight on each
    row and PHI each row's two shares of grid points.  Packed are n, the
    residual squares, PHI'PHI, VV' and V PHI, all of the grid's size.
    """
    g, h, value = (np.array([p[c] for p in row["__grid"]], dtype=float) for c in ("x", "h", "value"))
    coef = np.array([p["w"] for p in row["__grid"]], dtype=float)
    x, n, y, within = (np.array([p[c] for p in row["__rows"]], dtype=float) for c in ("__x", "__n", "__y", "__within"))
    off = x[None, :] - g[:, None]
    u = np.divide(off, h[:, None], out=np.where(off == 0, 0.0, np.inf), where=h[:, None] > 0)
    near = np.abs(u) < 1
    u = np.where(near, u, 0.0)
    v = np.where(near, (1 - np.abs(u) ** 3) ** 3, 0.0) * (coef[:, :1] + coef[:, 1:2] * u + coef[:, 2:] * u * u)
    phi = np.zeros((len(x), len(g)))
    at = np.arange(len(x))
    if len(g) > 1:
        left = np.clip(np.searchsorted(g, x, side="right") - 1, 0, len(g) - 2)
        share = np.clip((x - g[left]) / (g[left + 1] - g[left]), 0.0, 1.0)
        phi[at, left], phi[at, left + 1] = 1 - share, share
    else:
        phi[:, 0] = 1.0
    residual = float((within + n * (y / n - phi @ value) ** 2).sum())
    products = [(phi.T * n) @ phi, (v * n) @ v.T, (v * n) @ phi]
    return np.concatenate([[n.sum(), residual], *[m.ravel() for m in products]])


def local_smooth_band(
    df: DataFrame,
    keys: str | Sequence[str],
    x: str,
    y: str,
    span: float = 0.75,
    points: int = 80,
    level: float = 0.95,
) -> DataFrame:
    """The line of :func:`local_smooth` with its pointwise band: x, fit, std_error, residual_df, scale, lower, upper.

    Rows are taken to be fitted by straight lines between the grid's fits, so
    their smoother has the rank of the grid, and all that the residual scale
    asks of it (the traces behind its two deltas) follows from matrices of the
    grid's size: one pass over the distinct x sums them, whatever the number
    of rows.  ``scale`` is the root of the residual squares over the first
    delta, ``residual_df`` the squared first delta over the second.  Where the
    line takes up all residuals the scale, the errors and the band are NULL.
    NULL and NaN values are dropped, rows with equal x count each; an empty
    frame gives no rows.
    """
    keys = as_list(keys)
    rows = _merged(df, keys, x, y)
    grid = _grid(rows, keys, _is_whole(df, x), span, points).withColumn("__grid", F.array_distinct("__grid"))
    double = T.DoubleType()

    def line(row: dict) -> list[tuple]:
        w = _weights(row["s"])
        return [(float(w @ np.array(row["t"])), w.tolist())]

    fits = each_group(
        _moments(rows, grid, keys), [*keys, "x", "h"],
        [T.StructField("value", double), T.StructField("w", T.ArrayType(double))], line,
    )
    # one key more, so that frames without keys join the same way
    by = ["__all", *keys]
    lines = durable(
        fits.withColumn("__all", F.lit(1)).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "h", "value", "w"))).alias("__grid"))
    )
    distinct = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__distinct"))
    blocks = (
        attach(rows, distinct, keys)
        .withColumn("__all", F.lit(1))
        .withColumn("__block", F.pmod(F.xxhash64("__x"), F.ceil(F.col("__distinct") / BLOCK)))
        .groupBy(*by, "__block")
        .agg(F.collect_list(F.struct("__x", "__n", "__y", "__within")).alias("__rows"))
        .drop("__block")
    )
    sums = each_group(
        null_safe_join(blocks, lines, by), by, [T.StructField("__sums", T.ArrayType(double))],
        lambda row: [(_operator_sums(row).tolist(),)],
    )
    whole = (
        sums.select(*by, F.posexplode("__sums").alias("__at", "__sum"))
        .groupBy(*by, "__at")
        .agg(F.sum("__sum").alias("__sum"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("__at", "__sum")))["__sum"].alias("__sums"))
    )

    def band(row: dict) -> list[tuple]:
        n, residual = row["__sums"][:2]
        size = len(row["__grid"])
        p, q, r = np.array(row["__sums"][2:]).reshape(3, size, size)
        qp = q @ p
        # with L = PHI V: traces of L, LL', LL, LLL' and LL'LL'
        first, both, twice = np.trace(r), np.trace(qp), np.trace(r @ r)
        thrice, fourth = np.trace(r @ qp), np.trace(qp @ qp)
        one = n - 2 * first + both
        two = n - 2 * (2 * first - both) + 2 * twice + 2 * both - 4 * thrice + fourth
        if one < 1e-6 * n or two < 1e-9 * n:
            return [(p["x"], p["value"], None, None, None, None, None) for p in row["__grid"]]
        scale, freedom = math.sqrt(residual / one), one * one / two
        out = []
        t = float(student_ppf2(level, np.array([freedom]))[0])
        for i, point in enumerate(row["__grid"]):
            se = scale * math.sqrt(max(q[i, i], 0.0))
            out.append((point["x"], point["value"], se, freedom, scale, point["value"] - t * se, point["value"] + t * se))
        return out

    names = ("x", "fit", "std_error", "residual_df", "scale", "lower", "upper")
    found = each_group(null_safe_join(whole, lines, by), by, [T.StructField(c, double) for c in names], band)
    return found.drop("__all")


def bandwidths(df: DataFrame, keys: str | Sequence[str], x: str) -> DataFrame:
    """Rule-of-thumb bandwidth per key: 0.9 min(sd, IQR / 1.34) n^(-1/5)."""
    keys = as_list(keys)
    rows = df.select(*keys, _as_number(df, x).alias("__x")).where(F.col("__x").isNotNull())
    return _bandwidths(durable(rows.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__n"))), keys)


def _bandwidths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bandwidths from distinct values and their counts."""
    quartiles = exact_quantiles(rows, keys, "__x", [0.25, 0.75], weight="__n")
    n, x = F.col("__n"), F.col("__x")
    centre = rows.groupBy(*keys).agg((F.sum(n * x) / F.sum(n)).alias("__m"))
    off = x - F.col("__m")
    spread = (
        attach(rows, centre, keys)
        .groupBy(*keys)
        .agg(F.sum(n).cast("double").alias("__n"), F.sum(n * off * off).alias("__ss"))
        .withColumn("__sd", F.sqrt(F.try_divide(F.col("__ss"), F.col("__n") - 1)))
    )
    both = attach(spread, quartiles, keys)
    robust = (F.col("q1") - F.col("q0")) / 1.34
    width = F.when(F.least(F.col("__sd"), robust) > 0, F.least(F.col("__sd"), robust)).otherwise(
        F.when(F.col("__sd") > 0, F.col("__sd")).otherwise(1.0)
    )
    return both.where(F.col("__n") > 1).select(*keys, (0.9 * width * F.pow("__n", F.lit(-0.2))).alias("bandwidth"))


def density(
    df: DataFrame,
    keys: str | Sequence[str],
    x: str,
    points: int = 512,
    bandwidth: float | None = None,
    margin: float = 3.0,
    reach: float | None = None,
) -> DataFrame:
    """Gaussian kernel density of x per key on one shared grid.

    The bandwidth is shared: the mean of the keys' rule-of-thumb bandwidths.
    The grid runs ``margin`` bandwidths beyond the data.  Equal values are
    merged first.  By default each value meets every grid point; with ``reach``
    only those within so many bandwidths, which lowers a density by at most
    exp(-reach^2 / 2) / (bandwidth sqrt(2 pi)).
    """
    keys = as_list(keys)
    rows = (
        df.select(*keys, _as_number(df, x).alias("__x"))
        .where(F.col("__x").isNotNull())
        .groupBy(*keys, "__x")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    rows = durable(rows)
    ends = rows.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    if bandwidth is None:
        shared = _bandwidths(rows, keys).agg(F.avg("bandwidth").alias("b")).scalar()
    else:
        shared = F.lit(float(bandwidth))
    grid = ends.withColumn("__b", shared).select(
        (F.col("__lo") - margin * F.col("__b")).alias("__from"),
        ((F.col("__hi") - F.col("__lo") + 2 * margin * F.col("__b")) / max(points - 1, 1)).alias("__step"),
        "__b",
    )
    placed = attach(rows, grid, [])
    b, step, start = F.col("__b"), F.col("__step"), F.col("__from")
    low, high = F.lit(0).cast("long"), F.lit(points - 1).cast("long")
    if reach is not None:
        low = F.greatest(low, F.ceil((F.col("__x") - reach * b - start) / step))
        high = F.least(high, F.floor((F.col("__x") + reach * b - start) / step))
    reached = placed.where(low <= high).withColumn("__k", F.explode(F.sequence(low, high)))
    u = (start + step * F.col("__k") - F.col("__x")) / b
    sums = reached.groupBy(*keys, "__k").agg(F.sum(F.col("__n") * F.exp(-u * u / 2)).alias("__sum"))
    sizes = rows.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    line = attach(sizes, grid, []).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    value = F.coalesce("__sum", F.lit(0.0)) / (F.col("__size") * b * math.sqrt(2 * math.pi))
    return null_safe_join(line, sums, [*keys, "__k"], "left").select(
        *keys, (start + step * F.col("__k")).alias("x"), value.alias("value")
    )
