"""Linear models.  Spark aggregates the sums; only terms x terms systems are solved.

Centred sums (Spark's covariance aggregates) are used throughout, because years
near 2000 ruin plain sums of squares.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwise.frames import as_list, attach, durable, null_safe_join
from shoalwise.functions.columns import missing_as_null
from shoalwise.functions.tails import student_quantile, student_sf2, student_two_sided

# A term is aliased when this share or less of its variance is left.
TOLERANCE = 1e-11


def trend(df: DataFrame, keys: str | Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line per key: slope, intercept, SE, t, p, R squared, n.

    Also keeps the mean, sum of squares and range of x for bands and changes.
    """
    keys = as_list(keys)
    pair = df.select(
        *keys,
        missing_as_null(F.col(y).cast("double")).alias("__y"),
        missing_as_null(F.col(x).cast("double")).alias("__x"),
    ).na.drop("any", subset=["__y", "__x"])
    sums = pair.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__x").alias("x_mean"),
        F.avg("__y").alias("__ym"),
        F.min("__x").alias("x_min"),
        F.max("__x").alias("x_max"),
        F.regr_sxx("__y", "__x").alias("sxx"),
        F.regr_syy("__y", "__x").alias("__syy"),
        F.regr_sxy("__y", "__x").alias("__sxy"),
    )
    slope = F.when(F.col("sxx") > 0, F.try_divide(F.col("__sxy"), F.col("sxx")))
    dof = (F.col("n") - 2).cast("double")
    fit = (
        sums.withColumn("slope", slope)
        .withColumn("intercept", F.col("__ym") - F.col("slope") * F.col("x_mean"))
        .withColumn("__rss", F.greatest(F.col("__syy") - F.col("slope") * F.col("__sxy"), F.lit(0.0)))
        .withColumn("sigma", F.when(dof > 0, F.sqrt(F.try_divide(F.col("__rss"), dof))))
        .withColumn("se", F.try_divide(F.col("sigma"), F.sqrt("sxx")))
        .withColumn("t", F.try_divide(F.col("slope"), F.col("se")))
        .withColumn("r2", 1 - F.try_divide(F.col("__rss"), F.col("__syy")))
    )
    return fit.select(
        *keys,
        *("slope", "intercept", "se", "t"),
        student_two_sided("t", dof).alias("p"),
        *("r2", "n", "sigma", "x_mean", "sxx", "x_min", "x_max"),
    )


def trend_band(
    df: DataFrame, keys: str | Sequence[str], y: str, x: str, level: float = 0.95
) -> DataFrame:
    """Every row with its fitted value and the confidence band of the line."""
    keys = as_list(keys)
    fit = trend(df, keys, y, x)
    fit = fit.withColumn("__q", student_quantile(F.lit(level), (F.col("n") - 2).cast("double"))).select(
        *keys, *[F.col(c).alias(f"__{c}") for c in ("slope", "intercept", "sigma", "n", "x_mean", "sxx")], "__q"
    )
    at = F.col(x).cast("double")
    width = (
        F.col("__q")
        * F.col("__sigma")
        * F.sqrt(
            F.try_divide(F.lit(1.0), F.col("__n"))
            + F.try_divide((at - F.col("__x_mean")) * (at - F.col("__x_mean")), F.col("__sxx"))
        )
    )
    fitted = F.col("__intercept") + F.col("__slope") * at
    return attach(df, fit, keys).select(
        *df.columns, fitted.alias("fit"), (fitted - width).alias("lower"), (fitted + width).alias("upper")
    )


def percent_change(
    fit: DataFrame, start: str | float | Column = "x_min", end: str | float | Column = "x_max",
    start_at: str | float | Column | None = None,
) -> DataFrame:
    """Change of the fitted line over the record, in percent of its start value.

    The change is slope x (end - start) in x; it is applied at ``start_at``
    (default: the start), which may be a fixed year.  Other terms of the model
    are ignored.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))
    begin, stop = as_col(start), as_col(end)
    origin = begin if start_at is None else as_col(start_at)
    value = F.col("intercept") + F.col("slope") * origin
    change = F.col("slope") * (stop - begin)
    return fit.withColumns(
        {
            "start_value": value,
            "change": change,
            "percent": (F.try_divide(value + change, value) - 1) * 100,
        }
    )


def reference_line(df: DataFrame, keys: str | Sequence[str], value: str, out: str = "reference") -> DataFrame:
    """The series mean, missing values ignored, next to every row."""
    keys = as_list(keys)
    means = df.groupBy(*keys).agg(F.avg(missing_as_null(F.col(value).cast("double"))).alias(out))
    return attach(df, means, keys)


def factor_levels(df: DataFrame, factors: Sequence[str]) -> dict[str, list]:
    """Sorted levels of each factor, from one pass over ``df``.

    They become terms of a Poisson model, so terms x terms sums must fit the
    driver; factors of :func:`ols` do not come here.
    """
    if not factors:
        return {}
    found = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f).cast("string").alias("level")) for i, f in enumerate(factors)
    ]))).where(F.col("level").isNotNull()).distinct().collect()
    levels: dict[str, list] = {}
    for i, name in enumerate(factors):
        kind = df.schema[name].dataType
        texts = [r["level"] for r in found if r["i"] == i]
        as_value = str if isinstance(kind, (T.StringType, T.DateType)) else float if isinstance(kind, (T.DoubleType, T.FloatType)) else int
        if isinstance(kind, T.BooleanType):
            as_value = lambda v: v == "true"
        levels[name] = sorted(as_value(v) for v in texts)
    return levels


def each_group(
    df: DataFrame, keys: Sequence[str], fields: Sequence[T.StructField], solve: Callable[[dict], list[tuple]]
) -> DataFrame:
    """Run a small solve on every row of an aggregated frame.

    ``solve`` gets the row's non-key values and returns rows for ``fields``.
    The keys pass through as Arrow columns, so their types never change.
    """
    keys = list(keys)
    schema = T.StructType([*[df.schema[k] for k in keys], *fields])
    kinds = {"double": pa.float64(), "string": pa.string(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64())}
    arrow = [kinds[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [c for c in batch.schema.names if c not in keys]
            lists = {c: batch.column(c).to_pylist() for c in values}
            origin: list[int] = []
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                made = solve({c: lists[c][i] for c in values})
                origin.extend([i] * len(made))
                rows.extend(made)
            pick = pa.array(origin, pa.int64())
            columns = [batch.column(k).take(pick) for k in keys]
            for j, kind in enumerate(arrow):
                items = [r[j] for r in rows]
                if kind == pa.float64():
                    items = [v if v is not None and math.isfinite(v) else None for v in items]
                columns.append(pa.array(items, kind))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


TERM_FIELDS = [
    T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()),
    T.StructField("std_error", T.DoubleType()),
    T.StructField("t", T.DoubleType()),
    T.StructField("p", T.DoubleType()),
]


def solve_centred(cov: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Solve the centred normal equations of the last column on the others.

    Terms are swept in order; one that is a combination of earlier terms is
    aliased and gets NaN.  Returns slopes, inverse, kept mask, residual sum of
    squares and rank.
    """
    p = len(cov) - 1
    scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    a = cov / np.outer(scale, scale)
    kept = np.zeros(p, bool)
    for j in range(p):
        pivot = a[j, j]
        if cov[j, j] <= 0 or pivot <= TOLERANCE:
            continue
        kept[j] = True
        row, column = a[j].copy(), a[:, j].copy()
        a -= np.outer(column, row) / pivot
        a[j] = row / pivot
        a[:, j] = -column / pivot
        a[j, j] = 1.0 / pivot
    slopes = np.where(kept, a[:p, p] * scale[p] / scale[:p], np.nan)
    inverse = np.where(np.outer(kept, kept), a[:p, :p] / np.outer(scale[:p], scale[:p]), np.nan)
    rss = max(float(a[p, p]) * scale[p] ** 2, 0.0)
    return slopes, inverse, kept, rss, int(kept.sum())


def _upper(flat: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


def _term_rows(names, coef, var, kept, dof):
    rows = []
    for name, b, v, ok in zip(names, coef, var, kept):
        if not ok:
            rows.append((name, None, None, None, None))
            continue
        se = math.sqrt(v) if dof > 0 and v >= 0 else math.nan
        t = b / se if se > 0 else math.nan
        rows.append((name, float(b), se, t, float(student_sf2(np.array([t]), np.array([dof]))[0])))
    return rows


def _centred_sums(df: DataFrame, keys: list[str], columns: list[str], weight: str | None) -> DataFrame:
    """n, means and centred cross-products per key, in one pass (two with weights)."""
    size = len(columns)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    if weight is None:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(c) for c in columns]).alias("means"),
            F.array(*[F.covar_pop(columns[i], columns[j]) * F.count(F.lit(1)) for i, j in pairs]).alias("sums"),
            F.sum(F.lit(1.0)).alias("weight"),
            *_ranges(columns),
        )
    w = F.col(weight)
    df = durable(df)
    means = df.groupBy(*keys).agg(
        *[F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"__m{i}") for i, c in enumerate(columns)]
    )
    d = [F.col(c) - F.col(f"__m{i}") for i, c in enumerate(columns)]
    return (
        attach(df, means, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.any_value(f"__m{i}") for i in range(size)]).alias("means"),
            F.array(*[F.sum(w * d[i] * d[j]) for i, j in pairs]).alias("sums"),
            F.sum(w).alias("weight"),
            *_ranges(columns),
        )
    )


def _ranges(columns: list[str]) -> list[Column]:
    return [F.array(*[f(c) for c in columns]).alias(name) for f, name in ((F.min, "lows"), (F.max, "highs"))]


def _design(df: DataFrame, keys: list[str], y: str, xs: Sequence[str], weights: str | None) -> tuple[DataFrame, list[str]]:
    columns = {x: missing_as_null(F.col(x).cast("double")) for x in xs}
    names = list(columns)
    extra = [F.col(weights).cast("double").alias("__w")] if weights else []
    rows = df.select(
        *keys,
        *[c.alias(f"__x{i}") for i, c in enumerate(columns.values())],
        missing_as_null(F.col(y).cast("double")).alias("__y"),
        *extra,
    ).na.drop("any", subset=[*[f"__x{i}" for i in range(len(names))], "__y", *(["__w"] if weights else [])])
    return rows, names


OLS_FIELDS = [*TERM_FIELDS, T.StructField("x_min", T.DoubleType()), T.StructField("x_max", T.DoubleType())]


def ols(
    df: DataFrame,
    keys: str | Sequence[str],
    y: str,
    xs: Sequence[str],
    factors: Sequence[str] = (),
    weights: str | None = None,
    dense_levels: int | None = None,
) -> DataFrame:
    """Gaussian linear model per key: one row per term, with the range of each numeric term.

    ``factors`` are columns used as categories; a key's smallest level is the
    reference.  They may have any number of levels, which stay rows of tables.
    While all factors but the largest have at most ``dense_levels`` levels
    together (default :data:`factors.DENSE_LEVELS`), every term has its
    standard error.  Beyond that two factors are solved by conjugate gradients
    and further ones must stay within that number; numeric terms then have
    exact errors, levels have estimates only, since each error would be a
    solve of its own.  A level that no cells connect with the reference has a
    NULL estimate there.  Rows with a missing value are dropped.
    """
    keys = as_list(keys)
    if factors:
        from shoalwise.operators.factors import DENSE_LEVELS, fit_factors

        return fit_factors(df, keys, y, list(xs), list(factors), weights, DENSE_LEVELS if dense_levels is None else dense_levels).terms
    rows, names = _design(df, keys, y, xs, weights)
    size = len(names) + 1
    columns = [*[f"__x{i}" for i in range(len(names))], "__y"]
    sums = _centred_sums(rows, keys, columns, "__w" if weights else None)

    def solve(row: dict) -> list[tuple]:
        n, means = row["n"], np.array(row["means"], float)
        slopes, inverse, kept, rss, rank = solve_centred(_upper(row["sums"], size), n)
        dof = n - rank - 1
        s2 = rss / dof if dof > 0 else math.nan
        at = means[:-1]
        b, v = np.where(kept, slopes, 0.0), np.where(np.isnan(inverse), 0.0, inverse)
        intercept = means[-1] - float(at @ b)
        var0 = s2 * (1.0 / row["weight"] + float(at @ v @ at))
        coef = [intercept, *slopes]
        var = [var0, *(s2 * np.diag(v))]
        terms = _term_rows(["(Intercept)", *names], coef, var, [True, *kept], dof)
        ends = [(None, None), *zip(row["lows"][:-1], row["highs"][:-1], strict=True)]
        return [(*t, *e) for t, e in zip(terms, ends, strict=True)]

    return each_group(sums, keys, OLS_FIELDS, solve)


def ols_summary(
    df: DataFrame, keys: str | Sequence[str], y: str, xs: Sequence[str], factors: Sequence[str] = (), dense_levels: int | None = None
) -> DataFrame:
    """Model-level row per key: n, r2, sigma, deviance, null_deviance and aic of the linear model.

    ``factors`` and ``dense_levels`` are those of :func:`ols`.
    """
    keys = as_list(keys)
    if factors:
        return _factor_summary(df, keys, y, list(xs), list(factors), dense_levels)
    rows, names = _design(df, keys, y, xs, None)
    size = len(names) + 1
    sums = _centred_sums(rows, keys, [*[f"__x{i}" for i in range(len(names))], "__y"], None)

    def solve(row: dict) -> list[tuple]:
        n, total = row["n"], _upper(row["sums"], size)
        _, _, _, rss, rank = solve_centred(total, n)
        null, dof = float(total[-1, -1]), n - rank - 1
        return [(
            n,
            1 - rss / null if null > 0 else math.nan,
            math.sqrt(rss / dof) if dof > 0 else math.nan,
            rss,
            null,
            n * (math.log(2 * math.pi * rss / n) + 1) + 2 * (rank + 2) if rss > 0 else math.nan,
        )]

    fields = [T.StructField("n", T.LongType())] + [
        T.StructField(c, T.DoubleType()) for c in ("r2", "sigma", "deviance", "null_deviance", "aic")
    ]
    return each_group(sums, keys, fields, solve)


def _factor_summary(df: DataFrame, keys: list[str], y: str, xs: list[str], factors: list[str], dense_levels: int | None) -> DataFrame:
    from shoalwise.operators.factors import DENSE_LEVELS, fit_factors

    fit = fit_factors(df, keys, y, xs, factors, None, DENSE_LEVELS if dense_levels is None else dense_levels).numbers
    value = missing_as_null(F.col(y).cast("double"))
    whole = df.where(value.isNotNull()).na.drop("any", subset=factors)
    for x in xs:
        whole = whole.where(missing_as_null(F.col(x).cast("double")).isNotNull())
    total = whole.groupBy(*keys).agg((F.var_pop(value) * F.count(F.lit(1))).alias("__null"))
    n, rss, null, rank = F.col("n"), F.col("rss"), F.col("__null"), F.col("rank")
    dof = n - rank - 1
    return attach(fit, total, keys).select(
        *keys,
        n.cast("long").alias("n"),
        F.when(null > 0, 1 - rss / null).alias("r2"),
        F.when(dof > 0, F.sqrt(rss / dof)).alias("sigma"),
        rss.alias("deviance"),
        null.alias("null_deviance"),
        F.when(rss > 0, n * (F.log(2 * math.pi * rss / n) + 1) + 2 * (rank + 2)).alias("aic"),
    )


def ols_line(fit: DataFrame, keys: str | Sequence[str], x: str) -> DataFrame:
    """Intercept, slope and range of one term of a fitted model, ready for percent_change."""
    def of(term, column="estimate"):
        return F.max(F.when(F.col("term") == term, F.col(column)))

    return fit.groupBy(*as_list(keys)).agg(
        of("(Intercept)").alias("intercept"), of(x).alias("slope"), of(x, "x_min").alias("x_min"), of(x, "x_max").alias("x_max")
    )


def weighted_polynomial(
    df: DataFrame,
    keys: str | Sequence[str],
    y: str,
    x: str,
    weights: str | None = None,
    degree: int = 2,
) -> DataFrame:
    """Polynomial in raw powers of x per key, optionally weighted.

    The fit uses powers of x centred at its mean and is expanded to raw
    coefficients with their full covariance.
    """
    keys = as_list(keys)
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    rows = df.select(
        *keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), w.alias("__w")
    ).na.drop("any", subset=["__x", "__y", "__w"])
    rows = durable(rows)
    centre = rows.groupBy(*keys).agg(F.avg("__x").alias("__c"))
    d = F.col("__x") - F.col("__c")
    power = lambda k: d if k == 1 else power(k - 1) * d
    centred = attach(rows, centre, keys).withColumns({f"__x{k}": power(k) for k in range(1, degree + 1)})
    columns = [*[f"__x{k}" for k in range(1, degree + 1)], "__y"]
    sums = _centred_sums(centred, keys, columns, "__w")
    if keys:
        sums = null_safe_join(sums, centre, keys)
    else:
        sums = attach(sums, centre, keys)
    size = degree + 1

    def solve(row: dict) -> list[tuple]:
        n, means, c = row["n"], np.array(row["means"], float), row["__c"]
        slopes, inverse, kept, rss, rank = solve_centred(_upper(row["sums"], size), n)
        dof = n - rank - 1
        s2 = rss / dof if dof > 0 else math.nan
        b, v = np.where(kept, slopes, 0.0), np.where(np.isnan(inverse), 0.0, inverse)
        at = means[:-1]
        full = np.concatenate([[means[-1] - at @ b], b])
        cov = np.zeros((size, size))
        cov[1:, 1:] = v
        cov[0, 1:] = cov[1:, 0] = -(v @ at)
        cov[0, 0] = 1.0 / row["weight"] + at @ v @ at
        expand = np.zeros((size, size))
        for k in range(size):
            for j in range(k + 1):
                expand[j, k] = math.comb(k, j) * (-c) ** (k - j)
        raw, raw_cov = expand @ full, expand @ cov @ expand.T
        names = ["(Intercept)", *[x if k == 1 else f"{x}^{k}" for k in range(1, size)]]
        return _term_rows(names, raw, s2 * np.diag(raw_cov), [True, *kept], dof)

    return each_group(sums, keys, TERM_FIELDS, solve)


def polynomial_values(df: DataFrame, fit: DataFrame, keys: str | Sequence[str], x: str, out: str = "fit") -> DataFrame:
    """Fitted values of a polynomial next to every row."""
    keys = as_list(keys)
    caret = F.regexp_extract("term", r"\^(\d+)$", 1)
    degree = F.when(F.col("term") == "(Intercept)", 0).when(caret == "", 1).otherwise(caret.try_cast("int"))
    entry = F.struct(degree.alias("k"), "estimate")
    coefs = fit.groupBy(*keys).agg(F.array_sort(F.collect_list(entry))["estimate"].alias("__b"))
    at = F.col(x).cast("double")
    value = F.aggregate(F.reverse("__b"), F.lit(0.0), lambda acc, b: acc * at + b)
    return attach(df, coefs, keys).withColumn(out, value).drop("__b")


def vif(df: DataFrame, keys: str | Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Variance inflation factor of each predictor, per key.

    The diagonal of the inverse correlation matrix, which comes from one
    aggregate.  Predictors that are exact combinations get NULL.
    """
    keys = as_list(keys)
    names = list(xs)
    rows = df.select(
        *keys, *[missing_as_null(F.col(x).cast("double")).alias(f"__x{i}") for i, x in enumerate(names)]
    ).na.drop("any", subset=[f"__x{i}" for i in range(len(names))])
    sums = _centred_sums(rows, keys, [f"__x{i}" for i in range(len(names))], None)

    def solve(row: dict) -> list[tuple]:
        cov = _upper(row["sums"], len(names))
        sd = np.sqrt(np.diag(cov))
        if np.any(sd <= 0):
            return [(x, None) for x in names]
        corr = cov / np.outer(sd, sd)
        if np.linalg.matrix_rank(corr, tol=1e-12) < len(names):
            return [(x, None) for x in names]
        return [(x, float(v)) for x, v in zip(names, np.diag(np.linalg.inv(corr)))]

    fields = [T.StructField("term", T.StringType()), T.StructField("vif", T.DoubleType())]
    return each_group(sums, keys, fields, solve)
