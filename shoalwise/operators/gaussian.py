"""Penalised smooths of Gaussian series, with their band.

Rows shrink to one per distinct x.  Tasks sum the spline's cross-products of
each key; a key's fit is then one small system, diagonalised once, so that
generalised cross-validation costs a sum per trial of the smoothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwise.frames import as_list, attach, durable
from shoalwise.functions.columns import missing_as_null
from shoalwise.functions.tails import student_ppf2
from shoalwise.operators.ordered import exact_quantiles
from shoalwise.operators.poisson import LOG_LAMBDA, SplineBasis
from shoalwise.operators.regression import each_group
from shoalwise.operators.smooth import _as_number

#: Fewer distinct x than this make no smooth.
LEAST_VALUES = 4


@dataclass
class GaussianSmooth:
    """``band``: keys, x, fit, se, lower, upper at the grid; ``models``: keys, n, edf, smoothing, gcv, scale, r2, at_bound."""

    band: DataFrame
    models: DataFrame


class Spectrum:
    """A penalised least-squares problem in the basis where both its matrices are diagonal."""

    def __init__(self, gram: np.ndarray, penalty: np.ndarray, xy: np.ndarray, yy: float, n: float) -> None:
        self.share = np.trace(gram) / max(np.trace(penalty), 1e-300)
        whole = gram + self.share * penalty
        root = np.linalg.cholesky(whole)
        inner = np.linalg.solve(root, np.linalg.solve(root, gram).T)
        d, u = np.linalg.eigh((inner + inner.T) / 2)
        self.d = np.clip(d, 0.0, 1.0)
        self.map = np.linalg.solve(root.T, u)
        self.z, self.yy, self.n = self.map.T @ xy, yy, n

    def weights(self, smoothing: float) -> np.ndarray:
        return 1 / np.maximum(self.d + smoothing / self.share * (1 - self.d), 1e-300)

    def fit(self, smoothing: float) -> tuple[float, float, float]:
        """Residual sum of squares, effective degrees of freedom and GCV."""
        w = self.weights(smoothing)
        rss = max(self.yy - 2 * w @ self.z**2 + (w**2 * self.d) @ self.z**2, 0.0)
        edf = float(w @ self.d)
        room = self.n - edf
        return float(rss), edf, self.n * rss / room**2 if room > 0 else math.inf

    def best(self) -> tuple[float, bool]:
        """The smoothing of least GCV: the best of a grid of logarithms, then golden sections around it."""
        at = np.linspace(*LOG_LAMBDA, 221) + math.log(self.share)
        scores = [self.fit(math.exp(v))[2] for v in at]
        i = int(np.argmin(scores))
        if i in (0, len(at) - 1):
            return math.exp(at[i]), True
        low, high, golden = at[i - 1], at[i + 1], (math.sqrt(5) - 1) / 2
        while high - low > 1e-9:
            a, b = high - golden * (high - low), low + golden * (high - low)
            if self.fit(math.exp(a))[2] <= self.fit(math.exp(b))[2]:
                high = b
            else:
                low = a
        return math.exp((low + high) / 2), False


def gaussian_smooth(
    df: DataFrame, keys: str | Sequence[str], x: str, y: str, k: int = 10, points: int = 80, level: float = 0.95, smoothing: float | None = None
) -> GaussianSmooth:
    """A penalised cubic spline of y on x per key, with its pointwise band.

    Knots are the ``k`` even quantiles of the distinct x of a key; the
    smoothing, the multiplier of the integrated squared second derivative, is
    the one of least GCV unless given.  The band is fit -+ t * se with se from
    the posterior covariance, the residual scale rss / (n - edf) and Student's
    t with n - edf degrees of freedom.  The grid runs evenly over a key's x.

    Rows without x or y are dropped; NaN counts as missing; a date x is in
    days.  NULL is a key of its own; repeated rows count as often.  Keys with
    fewer than four different x are left out; one without more rows than
    effective degrees of freedom has a NULL band.
    """
    keys = as_list(keys)
    v = F.col("__y")
    rows = durable(
        df.select(*keys, _as_number(df, x).alias("__x"), missing_as_null(F.col(y).cast("double")).alias("__y"))
        .na.drop("any", subset=["__x", "__y"])
        .groupBy(*keys, "__x")
        .agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg(v).alias("__mean"), (F.var_pop(v) * F.count(F.lit(1))).alias("__ss"))
    )
    quantiles = exact_quantiles(rows, keys, "__x", np.linspace(0, 1, k).tolist())
    knots = quantiles.select(*keys, F.array_distinct(F.array(*[f"q{i}" for i in range(k)])).alias("knots"))
    centre = rows.groupBy(*keys).agg(
        (F.sum(F.col("__n") * F.col("__mean")) / F.sum("__n")).alias("centre"), F.count(F.lit(1)).alias("__values")
    )
    shape = durable(attach(knots, centre, keys).where(F.col("__values") >= LEAST_VALUES).drop("__values"))
    placed = attach(rows, shape, keys).where(F.col("knots").isNotNull()).select(
        *keys, "knots", "__x", "__n", (F.col("__mean") - F.col("centre")).alias("__mean"), "__ss"
    )
    fields = [*[placed.schema[c] for c in keys], T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in keys], strict=True)) if keys else [()] * batch.num_rows
            members: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                members.setdefault(name, []).append(i)
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("__x", "__n", "__mean", "__ss")}
            origin, pos, value = [], [], []
            for own in members.values():
                basis = SplineBasis(np.array(batch.column("knots")[own[0]].as_py()), False)
                n, mean = column["__n"][own], column["__mean"][own]
                design = basis.raw(column["__x"][own])
                gram = design.T @ (design * n[:, None])
                sums = np.concatenate(
                    [gram[np.triu_indices(len(gram))], design.T @ (n * mean), [n.sum(), n @ mean**2 + column["__ss"][own].sum(), n @ mean]]
                )
                origin.append(np.full(len(sums), own[0]))
                pos.append(np.arange(len(sums)))
                value.append(sums)
            if origin:
                take = pa.array(np.concatenate(origin))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(take) for c in keys], pa.array(np.concatenate(pos)), pa.array(np.concatenate(value))],
                    names=[f.name for f in fields],
                )

    sums = (
        placed.mapInArrow(partial, T.StructType(fields))
        .groupBy(*keys, "pos")
        .agg(F.sum("value").alias("value"))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("sums"))
    )

    def solve(row: dict) -> list[tuple]:
        places = np.array(row["knots"])
        basis, size = SplineBasis(places, False), len(places)
        flat = np.array(row["sums"])
        edge = size * (size + 1) // 2
        gram = np.zeros((size, size))
        gram[np.triu_indices(size)] = flat[:edge]
        gram += np.triu(gram, 1).T
        xy, (n, yy, total) = flat[edge : edge + size], flat[edge + size :]
        problem = Spectrum(gram, basis.penalty, xy, yy, n)
        chosen, bound = (smoothing, False) if smoothing is not None else problem.best()
        rss, edf, gcv = problem.fit(chosen)
        dof = n - edf
        scale = rss / dof if dof > 1e-9 else math.nan
        w = problem.weights(chosen)
        grid = np.linspace(places[0], places[-1], points)
        turned = basis.raw(grid) @ problem.map
        fit = turned @ (w * problem.z) + row["centre"]
        error = np.sqrt(scale * (turned**2 @ w))
        t = float(student_ppf2(level, np.array([dof]))[0]) if dof > 1e-9 else math.nan
        null = yy - total**2 / n
        nothing = (None,) * 7
        out = [(None, None, None, None, None, n, edf, float(chosen), gcv, scale, 1 - rss / null if null > 0 else math.nan, float(bound))]
        out += [(float(g), float(f), float(e), float(f - t * e), float(f + t * e), *nothing) for g, f, e in zip(grid, fit, error, strict=True)]
        return out

    columns = ("x", "fit", "se", "lower", "upper", "n", "edf", "smoothing", "gcv", "scale", "r2", "at_bound")
    found = durable(each_group(attach(sums, shape, keys), keys, [T.StructField(c, T.DoubleType()) for c in columns], solve))
    return GaussianSmooth(
        found.where("x IS NOT NULL").select(*keys, *columns[:5]),
        found.where("x IS NULL").select(*keys, *columns[5:11], (F.col("at_bound") > 0).alias("at_bound")),
    )
