"""Models with factors side by side, whatever the number of their levels.

Rows are first reduced to cells, one per combination of levels.  The factor
with the most levels is eliminated level by level.  If few levels are left in
the other factors, they stay as columns of a small dense system per key, and
every term has its standard error.  Otherwise the next largest factor's
effects come from conjugate gradients on the level x level incidence: each
product is two joins and two sums over the cells, levels stay rows of a table,
and only the remaining columns form a small system.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwise.frames import attach, null_safe_join, written
from shoalwise.functions.columns import missing_as_null
from shoalwise.operators import regression as reg

#: Levels of all factors but the largest that may become columns of a dense system.
DENSE_LEVELS = 64
#: Conjugate gradients end when every column's residual is this share of its first one.
CG_TOLERANCE = 1e-11
#: Or when it is this share of the column itself, which is rounding: the first factor explains the column.
CG_ROUNDING = 1e-14
MOST_ITERATIONS = 500


def level_counts(df: DataFrame, factors: Sequence[str]) -> dict[str, int]:
    """Number of distinct levels of each factor; only the numbers reach the driver."""
    if not factors:
        return {}
    row = df.agg(*[F.count_distinct(F.col(f)).alias(f"n{i}") for i, f in enumerate(factors)]).first()
    return {f: int(row[i]) for i, f in enumerate(factors)}


def few_levels(df: DataFrame, factor: str, most: int) -> tuple[list, list[str]]:
    """Sorted levels, as values and as texts, of a factor known to have at most ``most``."""
    rows = df.where(F.col(factor).isNotNull()).select(factor).distinct().orderBy(factor).limit(most + 1)
    found = rows.select(factor, F.col(factor).cast("string").alias("__text")).collect()
    if len(found) > most:
        raise ValueError(f"factor {factor} has more than {most} levels beside two larger factors")
    return [r[0] for r in found], [r["__text"] for r in found]


@dataclass
class LinearFit:
    """``terms``: a row per term; ``numbers``: n, rss and rank (without the intercept) per key."""

    terms: DataFrame
    numbers: DataFrame


def fit_factors(
    df: DataFrame, keys: list[str], y: str, xs: list[str], factors: Sequence[str], weights: str | None, dense_levels: int
) -> LinearFit:
    """Least squares with at least one factor, by the way that its numbers of levels ask for."""
    names = [f"__f{i}" for i in range(len(factors))]
    rows = written(
        df.select(
            *keys,
            *[F.col(f).alias(n) for f, n in zip(factors, names, strict=True)],
            *[missing_as_null(F.col(x).cast("double")).alias(f"__x{i}") for i, x in enumerate(xs)],
            missing_as_null(F.col(y).cast("double")).alias("__y"),
            *([F.col(weights).cast("double").alias("__w")] if weights else []),
        ).na.drop("any", subset=[*names, *[f"__x{i}" for i in range(len(xs))], "__y", *(["__w"] if weights else [])])
    )
    counts = level_counts(rows, names)
    order = sorted(range(len(factors)), key=lambda i: -counts[names[i]])
    rest = sum(counts[names[i]] for i in order[1:])
    title = dict(zip(names, factors, strict=True))
    way = _dense if rest <= dense_levels else _gradients
    return way(rows, keys, xs, [names[i] for i in order], title, "__w" if weights else None, dense_levels)


def _steady(value: float) -> float:
    """To 13 digits, so that reruns agree: the order in which tasks' sums arrive shows beyond them."""
    return float(f"{value:.13g}")


# ---------------------------------------------------------------- few levels besides the largest factor


def _dense(
    rows: DataFrame, keys: list[str], xs: list[str], order: list[str], title: dict[str, str], weight: str | None, most: int
) -> LinearFit:
    large, small = order[0], sorted(order[1:])
    numeric = [*[f"__x{i}" for i in range(len(xs))], "__y"]
    p = len(xs)
    texts = {f: few_levels(rows, f, most)[1] for f in small}
    starts, at = {}, p
    for f in small:
        starts[f] = at
        at += len(texts[f])
    size = at + 1
    cells = reg._centred_sums(rows, [*keys, *order], numeric, weight)
    code = [
        (F.array_position(F.array(*[F.lit(t) for t in texts[f]]), F.col(f).cast("string")) - 1 + starts[f]).cast("int").alias(f)
        for f in small
    ]
    held = F.struct(F.array(*code).alias("at") if small else F.array().cast("array<int>").alias("at"), "weight", "n", "means", "sums", "lows", "highs")
    # a level meets at most as many cells as there are combinations of the few levels
    blocks = written(cells.select(*keys, F.col(large).alias("__level"), held.alias("cell")).groupBy(*keys, "__level").agg(F.array_sort(F.collect_list("cell")).alias("cells")).sortWithinPartitions(*keys, "__level"))
    upper = np.triu_indices(size)
    inner = np.triu_indices(p + 1)
    places = np.array([*range(p), size - 1])

    def block(found: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Weight per cell, the cells' rows of the design, and the sums inside cells."""
        w = np.array([c["weight"] for c in found])
        design = np.zeros((len(found), size))
        inside = np.zeros((size, size))
        for i, c in enumerate(found):
            design[i, c["at"]] = 1.0
            design[i, places] = c["means"]
            part = np.zeros((p + 1, p + 1))
            part[inner] = c["sums"]
            inside[np.ix_(places, places)] += part + np.triu(part, 1).T
        return w, design, inside, sum(c["n"] for c in found)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key_lists = [batch.column(k).to_pylist() for k in keys]
            groups: dict[tuple, int] = {}
            first, totals = [], []
            for i, found in enumerate(batch.column("cells").to_pylist()):
                key = tuple(k[i] for k in key_lists)
                w, design, inside, n = block(found)
                total = w.sum()
                off = design - (w @ design) / total if total > 0 else design
                cross = off.T @ (off * w[:, None]) + inside
                lows = np.min([c["lows"] for c in found], axis=0)
                highs = np.max([c["highs"] for c in found], axis=0)
                sums = np.concatenate([cross[upper], w @ design, [n, 1.0]])
                if key not in groups:
                    groups[key] = len(first)
                    first.append(i)
                    totals.append([sums, lows, highs])
                else:
                    held = totals[groups[key]]
                    held[0] = held[0] + sums
                    held[1], held[2] = np.minimum(held[1], lows), np.maximum(held[2], highs)
            take = pa.array(first, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(take) for k in keys], *[pa.array([t[j].tolist() for t in totals], pa.list_(pa.float64())) for j in range(3)]],
                names=[*keys, "sums", "lows", "highs"],
            )

    numbers = T.ArrayType(T.DoubleType())
    parts = written(
        blocks.mapInArrow(partial, T.StructType([*[blocks.schema[k] for k in keys], *[T.StructField(c, numbers) for c in ("sums", "lows", "highs")]]))
    )
    added = (
        parts.select(*keys, F.posexplode("sums"))
        .groupBy(*keys, "pos")
        .agg(F.sum("col").alias("value"))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("sums"))
    )
    ends = parts.groupBy(*keys).agg(
        *[F.array(*[f(F.col(c)[i]) for i in range(p + 1)]).alias(c) for c, f in (("lows", F.min), ("highs", F.max))]
    )

    def means(row: dict) -> list[tuple]:
        w, design, _, _ = block(row["cells"])
        total = float(w.sum())
        return [((w @ design / total if total > 0 else np.zeros(size)).tolist(), total)]

    levels = written(reg.each_group(blocks, [*keys, "__level"], [T.StructField("mean", numbers), T.StructField("weight", T.DoubleType())], means))
    smallest = levels.groupBy(*keys).agg(F.min_by(F.struct("__level", "mean", "weight"), "__level").alias("first"))
    joined = attach(attach(added, ends, keys), smallest.select(*keys, F.col("first.mean").alias("first_mean"), F.col("first.weight").alias("first_weight")), keys)
    fields = [
        *reg.OLS_FIELDS, T.StructField("slopes", numbers), T.StructField("inverse", numbers),
        *[T.StructField(c, T.DoubleType()) for c in ("s2", "dof", "rss", "n", "rank")],
    ]

    def solve(row: dict) -> list[tuple]:
        flat = np.array(row["sums"])
        cross = np.zeros((size, size))
        cross[upper] = flat[: len(upper[0])]
        cross += np.triu(cross, 1).T
        present = flat[len(upper[0]) : len(upper[0]) + size]
        n, count = flat[-2], flat[-1]
        chosen, labels = list(range(p)), list(xs)
        for f in small:
            here = [starts[f] + j for j in range(len(texts[f])) if present[starts[f] + j] > 0]
            chosen += here[1:]
            labels += [f"{title[f]}{texts[f][j - starts[f]]}" for j in here[1:]]
        order_of = [*chosen, size - 1]
        slopes, inverse, kept, rss, rank = reg.solve_centred(cross[np.ix_(order_of, order_of)], int(n))
        dof = n - count - rank
        s2 = rss / dof if dof > 0 else math.nan
        b, v = np.zeros(size - 1), np.zeros((size - 1, size - 1))
        b[chosen] = np.where(kept, slopes, 0.0)
        v[np.ix_(chosen, chosen)] = np.where(np.isnan(inverse), 0.0, inverse)
        at = np.array(row["first_mean"])
        var0 = s2 * (1 / row["first_weight"] + at[:-1] @ v @ at[:-1]) if row["first_weight"] > 0 else math.nan
        terms = reg._term_rows(
            ["(Intercept)", *labels], [_steady(e) for e in (at[-1] - at[:-1] @ b, *slopes)], [var0, *(s2 * np.diag(v)[chosen])], [True, *kept], dof
        )
        ranges = [(None, None), *zip(row["lows"][:p], row["highs"][:p], strict=True), *[(None, None)] * (len(labels) - p)]
        carried = [(b.tolist(), v.ravel().tolist(), s2, float(dof), rss, float(n), float(count - 1 + rank))]
        carried += [(None,) * 7] * len(labels)
        return [(*t, *e, *c) for t, e, c in zip(terms, ranges, carried, strict=True)]

    solved = written(reg.each_group(joined, keys, fields, solve))
    heads = solved.where("term = '(Intercept)'")
    against = attach(levels, smallest.select(*keys, "first"), keys).where(F.col("__level") != F.col("first.__level"))
    labelled = against.select(
        *keys, F.concat(F.lit(title[large]), F.col("__level").cast("string")).alias("__term"), "mean", "weight",
        F.col("first.mean").alias("first_mean"), F.col("first.weight").alias("first_weight"),
    )

    def effect(row: dict) -> list[tuple]:
        apart = np.array(row["mean"]) - np.array(row["first_mean"])
        b, v = np.array(row["slopes"]), np.array(row["inverse"]).reshape(size - 1, size - 1)
        s2 = math.nan if row["s2"] is None else row["s2"]
        both = 1 / row["weight"] + 1 / row["first_weight"] if row["weight"] > 0 and row["first_weight"] > 0 else math.nan
        return [reg._term_rows([row["__term"]], [apart[-1] - apart[:-1] @ b], [s2 * (both + apart[:-1] @ v @ apart[:-1])], [True], row["dof"])[0] + (None, None)]

    effects = reg.each_group(attach(labelled, heads.select(*keys, "slopes", "inverse", "s2", "dof"), keys), keys, reg.OLS_FIELDS, effect)
    columns = [*keys, *[f.name for f in reg.OLS_FIELDS]]
    return LinearFit(solved.select(*columns).unionByName(effects), heads.select(*keys, "n", "rss", "rank"))


# ---------------------------------------------------------------- two factors of any size


def _each(size: int, make: Callable[[int], Column]) -> Column:
    return F.array(*[make(i) for i in range(size)])


@dataclass
class TwoWay:
    """Columns projected on two factors: their effects per level, and what is left inside cells."""

    first: DataFrame
    second: DataFrame
    left: DataFrame
    iterations: int


def two_way(cells: DataFrame, keys: list[str], size: int, tolerance: float = CG_TOLERANCE) -> TwoWay:
    """Project the ``means`` of cells (keys, __f0, __f1, weight) on two factors, all columns at once.

    The first factor is eliminated; the effects of the second solve a positive
    semi-definite system by conjugate gradients with its diagonal as
    preconditioner.  A product with the system is a weighted mean per level of
    the first factor and a sum per level of the second.  Effects are those of
    a connected table up to one constant; disconnected parts have one each.
    """
    w = F.col("weight")
    by0, by1 = [*keys, "__f0"], [*keys, "__f1"]
    cells = written(cells.where(w > 0).select(*keys, "__f0", "__f1", "weight", "means"))
    mean = lambda name: _each(size, lambda i: F.sum(w * F.col(name)[i]) / F.sum(w))
    base = written(cells.groupBy(*by0).agg(F.sum(w).alias("__total"), mean("means").alias("__mean")))
    start = (
        null_safe_join(cells, base, by0)
        .groupBy(*by1)
        .agg(
            _each(size, lambda i: F.sum(w * (F.col("means")[i] - F.col("__mean")[i]))).alias("r"),
            F.sum(w * (1 - w / F.col("__total"))).alias("d"),
            F.sum(w).alias("__sum"),
        )
    )
    # a level that shares no level of the first factor has nothing to solve
    d = F.when(F.col("d") > 1e-12 * F.col("__sum"), F.col("d"))
    scaled = lambda i: F.coalesce(F.col("r")[i] / F.col("d"), F.lit(0.0))
    state = written(start.withColumn("d", d).select(*by1, "d", "r", _each(size, lambda i: F.lit(0.0)).alias("x"), _each(size, scaled).alias("p")))
    product = lambda a, b: _each(size, lambda i: F.sum(a(i) * b(i)))
    item = lambda name: lambda i: F.col(name)[i]
    began = state.groupBy(*keys).agg(product(item("r"), scaled).alias("rz"))
    sizes = cells.groupBy(*keys).agg(_each(size, lambda i: F.sum(w * F.col("means")[i] * F.col("means")[i])).alias("__squares"))
    enough = F.zip_with("rz", "__squares", lambda a, b: F.greatest(a * tolerance**2, b * CG_ROUNDING**2))
    scalars = written(attach(began, sizes, keys).select(*keys, "rz", enough.alias("enough")))
    iterations = 0
    # one row: by how much the worst column of all keys exceeds what is enough
    worst = F.max(F.array_max(F.zip_with("rz", "enough", lambda a, b: F.when(a > b, 1).otherwise(0))))
    while scalars.agg(worst).first()[0]:
        iterations += 1
        if iterations > MOST_ITERATIONS:
            raise ValueError(f"conjugate gradients have not settled in {MOST_ITERATIONS} iterations")
        ahead = null_safe_join(cells.select(*keys, "__f0", "__f1", "weight"), state.select(*by1, "p"), by1)
        averaged = ahead.groupBy(*by0).agg(mean("p").alias("__t"))
        q = (
            null_safe_join(ahead, averaged, by0)
            .groupBy(*by1)
            .agg(_each(size, lambda i: F.sum(w * (F.col("p")[i] - F.col("__t")[i]))).alias("q"))
        )
        both = written(null_safe_join(state, q, by1))
        along = attach(scalars, both.groupBy(*keys).agg(product(item("p"), item("q")).alias("pq")), keys)
        alpha = _each(size, lambda i: F.when(F.col("pq")[i] > 0, F.col("rz")[i] / F.col("pq")[i]).otherwise(0.0))
        moved = attach(both, along.select(*keys, alpha.alias("a")), keys).select(
            *by1, "d", "p",
            _each(size, lambda i: F.col("x")[i] + F.col("a")[i] * F.col("p")[i]).alias("x"),
            _each(size, lambda i: F.col("r")[i] - F.col("a")[i] * F.col("q")[i]).alias("r"),
        )
        moved = written(moved)
        after = attach(scalars.withColumnRenamed("rz", "__old"), moved.groupBy(*keys).agg(product(item("r"), scaled).alias("rz")), keys)
        scalars = written(after.select(*keys, "__old", "rz", "enough"))
        beta = _each(size, lambda i: F.when(F.col("__old")[i] > 0, F.col("rz")[i] / F.col("__old")[i]).otherwise(0.0))
        state = attach(moved, scalars.select(*keys, beta.alias("b")), keys).select(
            *by1, "d", "x", "r", _each(size, lambda i: scaled(i) + F.col("b")[i] * F.col("p")[i]).alias("p")
        )
        scalars = scalars.drop("__old")
    second = written(state.select(*by1, F.col("x").alias("effect")))
    off = null_safe_join(cells, second, by1).withColumn("__off", F.zip_with("means", "effect", lambda m, e: m - e))
    first = written(off.groupBy(*by0).agg(mean("__off").alias("effect")))
    left = null_safe_join(off.drop("effect"), first, by0).select(
        *keys, "__f0", "__f1", "weight", F.zip_with("__off", "effect", lambda m, e: m - e).alias("left")
    )
    return TwoWay(first, second, left, iterations)


def connected_parts(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The smallest level of the second factor that each level of either factor is connected with."""
    by0, by1 = [*keys, "__f0"], [*keys, "__f1"]
    pairs = written(cells.select(*by0, "__f1").distinct())
    label = written(pairs.select(*by1).distinct().withColumn("part", F.col("__f1").cast("string")))
    while True:
        over = null_safe_join(pairs, label, by1).groupBy(*by0).agg(F.min("part").alias("part"))
        lower = null_safe_join(pairs, over, by0).groupBy(*by1).agg(F.min("part").alias("part"))
        lower = written(lower)
        changed = null_safe_join(label.withColumnRenamed("part", "__old"), lower, by1).where("part <> __old").limit(1).count()
        label = lower
        if not changed:
            return written(null_safe_join(pairs, label, by1).groupBy(*by0).agg(F.min("part").alias("part"))), label


def _gradients(
    rows: DataFrame, keys: list[str], xs: list[str], order: list[str], title: dict[str, str], weight: str | None, most: int
) -> LinearFit:
    first_name, second_name = title[order[0]], title[order[1]]
    dummies: dict[str, Column] = {}
    for f in sorted(order[2:]):
        values, texts = few_levels(rows, f, most)
        dummies |= {f"{title[f]}{t}": (F.col(f) == F.lit(v)).cast("double") for v, t in zip(values[1:], texts[1:], strict=True)}
    labels = [*xs, *dummies]
    p = len(labels)
    columns = [*[f"__x{i}" for i in range(p)], "__y"]
    whole = rows.select(
        *keys, F.col(order[0]).alias("__f0"), F.col(order[1]).alias("__f1"), *[f"__x{i}" for i in range(len(xs))],
        *[c.alias(f"__x{len(xs) + i}") for i, c in enumerate(dummies.values())], "__y", *([weight] if weight else []),
    )
    cells = written(reg._centred_sums(whole, [*keys, "__f0", "__f1"], columns, weight))
    solved = two_way(cells, keys, p + 1)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    e = F.col("left")
    outside = solved.left.groupBy(*keys).agg(F.array(*[F.sum(F.col("weight") * e[i] * e[j]) for i, j in pairs]).alias("outside"))
    inside = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("sums")[k]) for k in range(len(pairs))]).alias("inside"),
        F.array(*[F.min(F.col("lows")[i]) for i in range(p + 1)]).alias("lows"),
        F.array(*[F.max(F.col("highs")[i]) for i in range(p + 1)]).alias("highs"),
    )
    parts0, parts1 = connected_parts(cells, keys)
    counted = attach(
        parts0.groupBy(*keys).agg(F.count(F.lit(1)).alias("levels0")),
        parts1.groupBy(*keys).agg(F.count(F.lit(1)).alias("levels1"), F.count_distinct("part").alias("parts")), keys,
    )
    numbers = attach(attach(inside, outside, keys), counted, keys)
    fields = [*reg.OLS_FIELDS, T.StructField("slopes", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.DoubleType()) for c in ("rss", "n", "rank")]]

    def solve(row: dict) -> list[tuple]:
        cross = reg._upper(np.array(row["inside"]) + np.array(row["outside"]), p + 1)
        # columns that the factors explain altogether have nothing left but rounding
        before = np.array([max(abs(a), abs(b), 1.0) for a, b in zip(row["lows"], row["highs"], strict=True)])
        gone = np.diag(cross) <= 1e-16 * before**2 * row["n"]
        cross[gone, :] = cross[:, gone] = 0.0
        slopes, inverse, kept, rss, rank = reg.solve_centred(cross, row["n"])
        absorbed = row["levels0"] + row["levels1"] - row["parts"]
        dof = row["n"] - absorbed - rank
        s2 = rss / dof if dof > 0 else math.nan
        v = np.where(np.isnan(inverse), 0.0, inverse)
        terms = reg._term_rows(labels, slopes, s2 * np.diag(v), kept, dof)
        ends = [*zip(row["lows"][: len(xs)], row["highs"][: len(xs)], strict=True), *[(None, None)] * (p - len(xs))]
        head = ("__numbers", None, None, None, None, None, None, np.where(kept, slopes, 0.0).tolist(), rss, float(row["n"]), float(absorbed - 1 + rank))
        return [head, *[(*t, *x, None, None, None, None) for t, x in zip(terms, ends, strict=True)]]

    found = written(reg.each_group(numbers, keys, fields, solve))
    heads = found.where("term = '__numbers'").select(*keys, "slopes", "rss", "n", "rank")
    own = F.aggregate(F.zip_with(F.slice("effect", 1, p), "slopes", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    value = F.col("effect")[p] - own

    def levels(table: DataFrame, parts: DataFrame, level: str) -> DataFrame:
        placed = null_safe_join(attach(table, heads.select(*keys, "slopes"), keys), parts, [*keys, level])
        return placed.select(*keys, F.col(level).alias("__level"), value.alias("value"), "part")

    zero, one = levels(solved.first, parts0, "__f0"), levels(solved.second, parts1, "__f1")
    least = lambda t, name: t.groupBy(*keys).agg(F.min_by(F.struct("__level", "value", "part"), "__level").alias(name))
    ref0, ref1 = least(zero, "ref"), least(one, "ref")
    double = F.lit(None).cast("double")
    rest = {"std_error": double, "t": double, "p": double, "x_min": double, "x_max": double}

    def contrasts(table: DataFrame, ref: DataFrame, name: str) -> DataFrame:
        other = attach(table, ref, keys).where(F.col("__level") != F.col("ref.__level"))
        estimate = F.when(F.col("part") == F.col("ref.part"), F.col("value") - F.col("ref.value"))
        return other.select(*keys, F.concat(F.lit(name), F.col("__level").cast("string")).alias("term"), estimate.alias("estimate")).withColumns(rest)

    together = attach(ref0, ref1.withColumnRenamed("ref", "other"), keys)
    intercept = together.select(
        *keys, F.lit("(Intercept)").alias("term"),
        F.when(F.col("ref.part") == F.col("other.part"), F.col("ref.value") + F.col("other.value")).alias("estimate"),
    ).withColumns(rest)
    names = [*keys, *[f.name for f in reg.OLS_FIELDS]]
    terms = intercept.select(*names)
    for part in (found.where("term <> '__numbers'"), contrasts(zero, ref0, first_name), contrasts(one, ref1, second_name)):
        terms = terms.unionByName(part.select(*names))
    return LinearFit(terms, heads.select(*keys, "n", "rss", "rank"))
