"""Poisson models whose factors have too many levels to be columns.

Every least-squares step is a weighted projection on the two largest factors
(:func:`factors.two_way`): the effects of their levels stay tables, and only
the other columns' small system reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalwise.frames import written
from shoalwise.functions.columns import harmonic_terms, log_factorial, missing_as_null
from shoalwise.functions.tails import normal_sf2
from shoalwise.operators import factors as fa
from shoalwise.operators import poisson as po
from shoalwise.operators import regression as reg

#: Residuals of the projections while the fit still moves, and once it has nearly settled.
ROUGH, FINE = 1e-8, 1e-10


@dataclass
class AbsorbedFit:
    """Like PoissonFits for one model; ``first`` and ``second`` hold the effects of the two largest factors."""

    terms: DataFrame
    models: DataFrame
    y: str
    first_factor: str
    second_factor: str | None
    first: DataFrame
    second: DataFrame
    parts: list[tuple[Column, float]]

    def residuals(self, df: DataFrame, model_id: str | None = None) -> DataFrame:
        """Every row with its fitted mean and deviance residual; NULL where the model lacks a level or a value."""
        second = F.lit("") if self.second_factor is None else F.col(self.second_factor)
        eta = sum((F.lit(b) * c for c, b in self.parts), F.col("__e0") + F.col("__e1"))
        placed = (
            df.withColumns({"__k0": F.col(self.first_factor), "__k1": second})
            .join(self.first.select(F.col("__f0").alias("__k0"), F.col("effect").alias("__e0")), "__k0", "left")
            .join(self.second.select(F.col("__f1").alias("__k1"), F.col("effect").alias("__e1")), "__k1", "left")
        )
        mu, y = F.col("fit"), F.col(self.y).cast("double")
        unit = F.when(y > 0, y * F.ln(F.try_divide(y, mu))).otherwise(0.0) - (y - mu)
        residual = F.signum(y - mu) * F.sqrt(F.greatest(2 * unit, F.lit(0.0)))
        return placed.select(*df.columns, F.exp(eta).alias("fit")).withColumn("residual", residual)


def fit_absorbed(
    df: DataFrame, y: str, xs: Sequence[str], factors: Sequence[str], harmonics: Sequence[po.Harmonic], model_id: str, most: int
) -> AbsorbedFit:
    """Fit by iterated least squares; steps that raise the deviance are halved."""
    counts = fa.level_counts(df, factors)
    order = sorted(factors, key=lambda f: (-counts[f], list(factors).index(f)))
    large, second, others = order[0], order[1] if len(order) > 1 else None, order[2:]
    named: dict[str, Column] = {x: missing_as_null(F.col(x).try_cast("double")) for x in xs}
    for f in others:
        values, texts = fa.few_levels(df, f, max(most, fa.DENSE_LEVELS))
        named |= {f"{f}{t}": (F.col(f) == F.lit(v)).cast("double") for v, t in zip(values[1:], texts[1:], strict=True)}
    for h in harmonics:
        cycle = harmonic_terms(missing_as_null(F.col(h.column).try_cast("double")), h.period)
        named |= dict(zip(harmonic_terms(h.column), cycle.values(), strict=True))
    p = len(named)
    columns = [f"__x{i}" for i in range(p)]
    value = missing_as_null(F.col(y).cast("double"))
    # rows with equal covariates are one; equal means keep sums near 0 and scales near 1
    rows = df.select(
        F.col(large).alias("__f0"), (F.lit("") if second is None else F.col(second)).alias("__f1"),
        *[c.alias(n) for c, n in zip(named.values(), columns, strict=True)], value.alias("__v"),
    ).na.drop("any")
    v = F.col("__v")
    table = written(
        rows.groupBy("__f0", "__f1", *columns).agg(
            F.count(F.lit(1)).cast("double").alias("__n"), F.sum(v).alias("__sum"),
            F.sum(F.when(v > 0, v * F.ln(v)).otherwise(0.0)).alias("__ylogy"), F.sum(log_factorial(v)).alias("__logfact"),
        )
    )
    fixed = table.agg(*[F.sum(c).alias(c) for c in ("__n", "__sum", "__ylogy", "__logfact")]).first()
    if not fixed["__n"]:
        raise ValueError(f"model {model_id} has no complete rows")
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]

    def placed(first: DataFrame, second: DataFrame, beta: np.ndarray) -> DataFrame:
        known = table.join(first.withColumnRenamed("effect", "__e0"), "__f0").join(second.withColumnRenamed("effect", "__e1"), "__f1")
        return known.withColumn("__eta", sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, columns, strict=True)), F.col("__e0") + F.col("__e1")))

    def likelihood(at: DataFrame) -> tuple[float, float]:
        row = at.agg(F.sum(F.col("__sum") * F.col("__eta")), F.sum(F.col("__n") * F.exp("__eta"))).first()
        deviance = 2 * (fixed["__ylogy"] - row[0] - fixed["__sum"] + row[1])
        return deviance, row[0] - row[1] - fixed["__logfact"]

    def step(at: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame, np.ndarray, dict]:
        mu, mean = F.exp("__eta"), F.col("__sum") / F.col("__n")
        working = at.select("__f0", "__f1", *columns, (F.col("__eta") + (mean - mu) / mu).alias("__z"), (F.col("__n") * mu).alias("__w"))
        cells = written(reg._centred_sums(working, ["__f0", "__f1"], [*columns, "__z"], "__w"))
        done = fa.two_way(cells, [], p + 1, tolerance)
        left = F.col("left")
        outside = done.left.agg(F.array(*[F.sum(F.col("weight") * left[i] * left[j]) for i, j in pairs])).first()[0]
        inside = cells.agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(len(pairs))])).first()[0]
        slopes, inverse, kept, _, rank = reg.solve_centred(reg._upper(np.array(inside) + np.array(outside), p + 1), 0)
        beta = np.where(kept, slopes, 0.0)
        own = F.col("effect")[p] - sum((F.lit(float(b)) * F.col("effect")[i] for i, b in enumerate(beta)), F.lit(0.0))
        return (
            written(done.first.select("__f0", own.alias("effect"))), written(done.second.select("__f1", own.alias("effect"))),
            beta, {"inverse": inverse, "kept": kept, "rank": rank},
        )

    start = table.withColumn("__eta", F.ln(F.col("__sum") / F.col("__n") + 0.1))
    current = (*step(start, ROUGH), math.inf)
    deviance, loglik = likelihood(placed(*current[:3]))
    steps, tolerance = 1, ROUGH
    while True:
        steps += 1
        moved = step(placed(*current[:3]), tolerance)
        first, second_level, beta = moved[:3]
        after, after_loglik = likelihood(placed(first, second_level, beta))
        limit = po.DEVIANCE_TOLERANCE * (abs(deviance) + 0.1)
        halvings = 0
        while not after <= deviance + limit:
            halvings += 1
            if halvings > po.MOST_HALVINGS:
                raise ValueError(f"model {model_id}: no step lowers the deviance of {deviance:g}")
            half = lambda new, old, key: written(
                new.join(old.withColumnRenamed("effect", "__old"), key).select(key, ((F.col("effect") + F.col("__old")) / 2).alias("effect"))
            )
            first, second_level, beta = half(first, current[0], "__f0"), half(second_level, current[1], "__f1"), (beta + current[2]) / 2
            after, after_loglik = likelihood(placed(first, second_level, beta))
        settled = abs(deviance - after) <= limit and tolerance == FINE
        if abs(deviance - after) <= 1e-3 * (abs(deviance) + 0.1):
            tolerance = FINE
        current = (first, second_level, beta, moved[3], after)
        deviance, loglik = after, after_loglik
        if settled:
            break

    first, second_level, beta, small, _ = current
    parts0, parts1 = fa.connected_parts(table, [])
    numbers = parts1.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
    edf = float(parts0.count() + numbers[0] - numbers[1] + small["rank"])
    spark = df.sparkSession
    rows_of = []
    for j, name in enumerate(named):
        if not small["kept"][j]:
            rows_of.append((model_id, name, None, None, None, None, 0.0))
            continue
        error = math.sqrt(max(small["inverse"][j, j], 0.0))
        z = float(beta[j]) / error if error > 0 else math.nan
        rows_of.append(po._clean((model_id, name, float(beta[j]), error, z, float(normal_sf2(np.array([z]))[0]), 1.0)))
    zero, one = first.join(parts0, "__f0"), second_level.join(parts1, "__f1")
    ref0, ref1 = (t.agg(F.min_by(F.struct(F.col("effect"), F.col("part")), k)).first()[0] for t, k in ((zero, "__f0"), (one, "__f1")))
    rows_of.append(po._clean((model_id, "(Intercept)", ref0["effect"] + ref1["effect"] if ref0["part"] == ref1["part"] else None, None, None, None, 1.0)))
    terms = spark.createDataFrame(rows_of, po.TERM_SCHEMA)
    for known, key, name, ref in ((zero, "__f0", large, ref0), (one, "__f1", second, ref1)):
        if name is None:
            continue
        smallest = known.agg(F.min(key)).first()[0]
        nothing = F.lit(None).cast("double")
        estimate = F.when(F.col("part") == ref["part"], F.col("effect") - F.lit(ref["effect"]))
        terms = terms.unionByName(
            known.where(F.col(key) != F.lit(smallest)).select(
                F.lit(model_id).alias("model_id"), F.concat(F.lit(name), F.col(key).cast("string")).alias("term"), estimate.alias("estimate"),
                *[nothing.alias(c) for c in ("std_error", "z", "p")], F.lit(1.0).alias("edf"),
            )
        )
    mean = fixed["__sum"] / fixed["__n"]
    null = 2 * (fixed["__ylogy"] - (fixed["__sum"] * math.log(mean) if mean > 0 else 0.0))
    n = fixed["__n"]
    row = (model_id, n, edf, deviance, null, 1 - deviance / null if null > 0 else math.nan, loglik, -2 * loglik + 2 * edf,
           deviance / n + 2 * edf / n - 1, True, steps, False)
    models = spark.createDataFrame([po._clean(row)], po.MODEL_SCHEMA)
    return AbsorbedFit(terms, models, y, large, second, first, second_level, list(zip(named.values(), map(float, beta), strict=True)))
