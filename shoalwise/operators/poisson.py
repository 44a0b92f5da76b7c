"""Poisson models with log link: linear, factor, harmonic and smooth terms.

Rows with equal covariates are first merged into their count and sums, which
are sufficient for the fit.  Every step of the penalised least squares is one
pass over that table: tasks sum X'WX and X'Wz of all models at once, and only
those small sums reach the driver.  Comparing many models, or many smoothing
parameters, therefore costs as many passes as fitting one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import TYPE_CHECKING, Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwise.frames import durable
from shoalwise.functions.columns import harmonic_terms, log_factorial, missing_as_null
from shoalwise.functions.tails import chi_mixture_sf, chi_square_sf, normal_sf2
from shoalwise.operators.ordered import exact_quantiles
from shoalwise.operators.regression import factor_levels
from shoalwise.operators.thinplate import ThinPlateBasis

if TYPE_CHECKING:
    from shoalwise.operators.absorbed import AbsorbedFit

MODELS_PER_PASS = 64
DEVIANCE_TOLERANCE = 1e-9
# Ends of the search for log smoothing parameters; a model at an end says so (at_bound).
LOG_LAMBDA = (-25.0, 30.0)
# A step that does not lower the penalised deviance is halved so often before the fit is given up.
MOST_HALVINGS = 40
# The choice of smoothing ends where no slope of UBRE is steeper than this.
GRADIENT_TOLERANCE = 1e-7
MOST_NEWTON_STEPS = 100
LONGEST_STEP = 5.0
STEP_SHARES = (1.0, 0.4, 0.1, 0.01)
# UBRE of a fit is known to about this, as its deviance is.
UBRE_NOISE = 1e-10


@dataclass(frozen=True)
class Factor:
    """A column used as categories: numbers, or texts."""

    column: str


@dataclass(frozen=True)
class Harmonic:
    """Cosine and sine of a month column; the period defaults to 10."""

    column: str
    period: float = 10.0


@dataclass(frozen=True)
class Smooth:
    """A penalised spline of dimension ``k``: ``tp`` (thin plate, the default), ``cr`` (cubic, knots at quantiles)
    or ``cc`` (cyclic cubic, even knots).

    The centres of ``tp`` are the distinct values of the column if there are
    at most ``most_centres`` of them, else so many even quantiles of them; the
    rows of the fit are all rows in either case.
    """

    column: str
    basis: str = "tp"
    k: int = 10
    most_centres: int = 500

    @property
    def label(self) -> str:
        return f"s({self.column})"


Term = str | Factor | Harmonic | Smooth


def term_label(term: Term) -> str:
    if isinstance(term, str):
        return term
    if isinstance(term, Factor):
        return f"factor({term.column})"
    if isinstance(term, Harmonic):
        return f"harmonic({term.column})"
    return term.label


# ---------------------------------------------------------------- splines


def _band_matrices(knots: np.ndarray, cyclic: bool) -> tuple[np.ndarray, np.ndarray]:
    """B and D with B m = D f: second derivatives m from values f at the knots."""
    h = np.diff(knots)
    k = len(knots)
    if cyclic:
        size = k - 1
        B, D = np.zeros((size, size)), np.zeros((size, size))
        for i in range(size):
            prev, nxt = (i - 1) % size, (i + 1) % size
            hp, hn = h[(i - 1) % size], h[i]
            B[i, i] += (hp + hn) / 3
            B[i, prev] += hp / 6
            B[i, nxt] += hn / 6
            D[i, i] -= 1 / hp + 1 / hn
            D[i, prev] += 1 / hp
            D[i, nxt] += 1 / hn
        return B, D
    B, D = np.zeros((k - 2, k - 2)), np.zeros((k - 2, k))
    for i in range(k - 2):
        D[i, i], D[i, i + 1], D[i, i + 2] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        B[i, i] = (h[i] + h[i + 1]) / 3
        if i + 1 < k - 2:
            B[i, i + 1] = B[i + 1, i] = h[i + 1] / 6
    return B, D


@dataclass
class SplineBasis:
    """Evaluates a cubic spline given by its values at the knots."""

    knots: np.ndarray
    cyclic: bool
    curvature: np.ndarray = field(init=False)
    penalty: np.ndarray = field(init=False)
    null: np.ndarray | None = None

    def __post_init__(self) -> None:
        B, D = _band_matrices(self.knots, self.cyclic)
        inner = np.linalg.solve(B, D)
        self.penalty = D.T @ inner
        if self.cyclic:
            self.curvature = inner
        else:
            self.curvature = np.vstack([np.zeros(len(self.knots)), inner, np.zeros(len(self.knots))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        kn = self.knots
        if self.cyclic:
            x = kn[0] + np.mod(x - kn[0], kn[-1] - kn[0])
        inside = np.clip(x, kn[0], kn[-1])
        j = np.clip(np.searchsorted(kn, inside, side="right") - 1, 0, len(kn) - 2)
        h = kn[j + 1] - kn[j]
        left, right = (kn[j + 1] - inside) / h, (inside - kn[j]) / h
        size = len(kn) - 1 if self.cyclic else len(kn)
        rows = np.arange(len(x))
        out = np.zeros((len(x), size))
        nxt = (j + 1) % size
        np.add.at(out, (rows, j), left)
        np.add.at(out, (rows, nxt), right)
        out += (h**2 / 6 * (left**3 - left))[:, None] * self.curvature[j]
        out += (h**2 / 6 * (right**3 - right))[:, None] * self.curvature[nxt]
        beyond = x - inside
        if np.any(beyond):
            slope = np.zeros((len(x), size))
            np.add.at(slope, (rows, nxt), 1 / h)
            np.add.at(slope, (rows, j), -1 / h)
            slope += (h / 6 * (1 - 3 * left**2))[:, None] * self.curvature[j]
            slope += (h / 6 * (3 * right**2 - 1))[:, None] * self.curvature[nxt]
            out += beyond[:, None] * slope
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) @ self.null

    def absorb(self, column_sums: np.ndarray) -> None:
        """Keep only shapes whose sum over the data is zero."""
        q, _ = np.linalg.qr(column_sums.reshape(-1, 1), mode="complete")
        self.null = q[:, 1:]


# ---------------------------------------------------------------- design


@dataclass
class Block:
    """The design columns of one term."""

    term: Term
    label: str
    names: list[str]
    sources: list[str]
    kind: str
    centre: float = 0.0
    scale: float = 1.0
    levels: list = field(default_factory=list)
    texts: list[str] | None = None
    spline: SplineBasis | ThinPlateBasis | None = None
    penalty: np.ndarray | None = None

    def matrix(self, data: Mapping[str, np.ndarray]) -> np.ndarray:
        x = data[self.sources[0]]
        if self.kind == "linear":
            return ((x - self.centre) / self.scale)[:, None]
        if self.kind == "factor":
            return np.stack([x == level for level in self.levels], axis=1).astype(float)
        if self.kind == "harmonic":
            angle = 2 * math.pi * x / self.scale
            return np.stack([np.cos(angle), np.sin(angle)], axis=1)
        return self.spline(x)


def _sources(term: Term) -> list[str]:
    return [term] if isinstance(term, str) else [term.column]


def _text_factors(df: DataFrame, terms: Sequence[Term]) -> list[str]:
    return list(dict.fromkeys(t.column for t in terms if isinstance(t, Factor) and isinstance(df.schema[t.column].dataType, T.StringType)))


def _merge(df: DataFrame, y: str, terms: Sequence[Term]) -> tuple[DataFrame, list[str]]:
    """One row per distinct covariate combination, with the sums the fit needs."""
    sources = list(dict.fromkeys(s for t in terms for s in _sources(t)))
    texts = _text_factors(df, terms)
    count = missing_as_null(F.col(y).cast("double"))
    rows = df.select(
        *[F.col(s) if s in texts else missing_as_null(F.col(s).cast("double")).alias(s) for s in sources], count.alias("__y")
    ).where(F.col("__y").isNotNull())
    v = F.col("__y")
    merged = rows.groupBy(*sources).agg(
        F.count(F.lit(1)).cast("double").alias("__n"),
        F.sum(v).alias("__sum"),
        F.sum(F.when(v > 0, v * F.ln(v)).otherwise(0.0)).alias("__ylogy"),
        F.sum(log_factorial(v)).alias("__logfact"),
    )
    return merged, sources


def _numbered(table: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Text factors as the numbers of their sorted levels."""
    levels = factor_levels(table, names)
    for name, texts in levels.items():
        pairs = [F.lit(v) for i, text in enumerate(texts) for v in (text, float(i))]
        code = F.create_map(*pairs)[F.col(name)] if pairs else F.lit(None).cast("double")
        table = table.withColumn(name, code)
    return table, levels


def _blocks(table: DataFrame, terms: Sequence[Term], texts: Mapping[str, list[str]] = MappingProxyType({})) -> list[Block]:
    out = []
    numeric = [s for t in terms if isinstance(t, str) for s in _sources(t)]
    stats: dict[str, Any] = {}
    if numeric:
        w = F.col("__n")
        first = table.agg(
            *[F.try_divide(F.sum(F.when(F.col(s).isNotNull(), w * F.col(s))), F.sum(F.when(F.col(s).isNotNull(), w))).alias(s) for s in numeric]
        ).first()
        stats = {s: first[s] or 0.0 for s in numeric}
        second = table.agg(
            *[F.sqrt(F.avg((F.col(s) - F.lit(stats[s])) * (F.col(s) - F.lit(stats[s])))).alias(s) for s in numeric]
        ).first()
        spread = {s: second[s] or 1.0 for s in numeric}
    for term in terms:
        label = term_label(term)
        if isinstance(term, str):
            out.append(Block(term, label, [term], [term], "linear", stats[term], spread[term]))
        elif isinstance(term, Factor):
            known = texts.get(term.column)
            if known is None:
                levels = factor_levels(table, [term.column])[term.column][1:]
                names = [f"{term.column}{level:g}" for level in levels]
            else:
                levels, known = [float(i) for i in range(1, len(known))], known[1:]
                names = [f"{term.column}{text}" for text in known]
            out.append(Block(term, label, names, [term.column], "factor", levels=levels, texts=known))
        elif isinstance(term, Harmonic):
            names = list(harmonic_terms(term.column))
            out.append(Block(term, label, names, [term.column], "harmonic", scale=float(term.period)))
        else:
            out.append(_smooth_block(table, term))
    return out


def _smooth_block(table: DataFrame, term: Smooth) -> Block:
    column = term.column
    distinct = table.where(F.col(column).isNotNull()).select(column).distinct()
    if term.basis == "cc":
        ends = distinct.agg(F.min(column), F.max(column)).first()
        knots = np.linspace(ends[0], ends[1], term.k)
    elif term.basis == "cr":
        row = exact_quantiles(distinct, [], column, np.linspace(0, 1, term.k).tolist()).first()
        knots = np.unique(np.array([row[i] for i in range(term.k)], float))
    elif term.basis == "tp":
        few = distinct.limit(term.most_centres + 1).toPandas()[column].to_numpy(float)
        if len(few) <= term.most_centres:
            knots = np.sort(few)
        else:
            row = exact_quantiles(distinct, [], column, np.linspace(0, 1, term.most_centres).tolist()).first()
            knots = np.unique(np.array([row[i] for i in range(term.most_centres)], float))
    else:
        raise ValueError(f"unknown basis {term.basis!r}")
    if len(knots) < 4:
        raise ValueError(f"{term.label} needs at least 4 distinct knots")
    spline = ThinPlateBasis(knots, min(term.k, len(knots))) if term.basis == "tp" else SplineBasis(knots, term.basis == "cc")
    size = len(spline.penalty)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            total += batch.column(1).to_numpy(zero_copy_only=False) @ spline.raw(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["pos", "value"])

    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())])
    part = table.where(F.col(column).isNotNull()).select(column, "__n").mapInArrow(sums, schema)
    rows = part.groupBy("pos").agg(F.sum("value").alias("value")).collect()
    column_sums = np.zeros(size)
    for r in rows:
        column_sums[r["pos"]] = r["value"]
    spline.absorb(column_sums)
    penalty = spline.null.T @ spline.penalty @ spline.null
    names = [f"{term.label}.{i + 1}" for i in range(penalty.shape[0])]
    return Block(term, term.label, names, [column], "smooth", spline=spline, penalty=penalty)


# ---------------------------------------------------------------- fitting


@dataclass
class Model:
    """One model while it is fitted: its blocks, smoothing and estimates."""

    model_id: str
    blocks: list[int]
    columns: np.ndarray
    penalties: list[tuple[np.ndarray, np.ndarray]]
    log_lambda: np.ndarray
    tune: bool
    beta: np.ndarray | None = None
    kept: np.ndarray | None = None
    deviance: float = math.inf
    done: bool = False
    steps: int = 0
    #: Penalised deviance and estimates that the next step must not be worse than, and halvings since.
    before: tuple[float, np.ndarray] | None = None
    halvings: int = 0
    tried: set = field(default_factory=set)
    #: Slopes of UBRE in the log smoothing parameters at the end; 0 at an end of the range.
    gradient: np.ndarray | None = None
    result: dict = field(default_factory=dict)


def _deviance(n: np.ndarray, total: np.ndarray, ylogy: np.ndarray, eta: np.ndarray) -> float:
    """Deviance of merged rows, added up from terms that are as small as the misfit.

    The sums of y ln y and y eta agree in all but their last digits where
    counts are large; a fit would then never settle.  With d = eta - ln(mean),
    a row's part is what its own mean leaves, which no step changes and is 0
    for a single value, and n mean (e^d - 1 - d).
    """
    mean = total / n
    log_mean = np.log(np.where(mean > 0, mean, 1.0))
    d = eta - log_mean
    within = np.where((n == 1) & (mean > 0), 0.0, ylogy - total * log_mean)
    off_mean = total * (np.expm1(d) - d)
    off_zero = n * np.exp(eta) - total * eta - total
    return 2 * float((within + np.where(mean > 0, off_mean, off_zero)).sum())


def _pass(table: DataFrame, blocks: list[Block], models: list[Model]) -> dict[int, dict]:
    """One pass over the merged rows: the sums of every model."""
    shipped = [(m.blocks, m.columns, None if m.beta is None else np.where(m.kept, m.beta, 0.0)) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[np.ndarray | None] = [None] * len(shipped)
        for batch in batches:
            data = {
                name: batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False)
                for i, name in enumerate(batch.schema.names)
            }
            n, total = data["__n"], data["__sum"]
            ones = np.ones((len(n), 1))
            present, parts = {}, {}
            for chosen, _, _ in shipped:
                for b in chosen:
                    if b not in parts:
                        x = data[blocks[b].sources[0]]
                        present[b] = ~np.isnan(x)
                        parts[b] = blocks[b].matrix({blocks[b].sources[0]: np.where(present[b], x, 0.0)})
            for i, (chosen, columns, beta) in enumerate(shipped):
                ok = np.ones(len(n), bool)
                for b in chosen:
                    ok &= present[b]
                X = np.hstack([ones, *[parts[b] for b in chosen]])[ok][:, columns]
                nn, ss = n[ok], total[ok]
                mean = ss / nn
                if beta is None:
                    eta = np.log(mean + 0.1)
                else:
                    eta = X @ beta
                mu = np.exp(eta)
                w = nn * mu
                z = eta + (mean - mu) / mu
                wx = X * w[:, None]
                gram = X.T @ wx
                deviance = _deviance(nn, ss, data["__ylogy"][ok], eta)
                sums = np.concatenate(
                    [
                        gram[np.triu_indices(len(gram))],
                        wx.T @ z,
                        [
                            w @ (z * z),
                            nn.sum(),
                            ss.sum(),
                            deviance,
                            (data["__ylogy"][ok] - ss - data["__logfact"][ok]).sum() - deviance / 2,
                            data["__ylogy"][ok].sum(),
                        ],
                    ]
                )
                totals[i] = sums if totals[i] is None else totals[i] + sums
        ids, pos, value = [], [], []
        for i, sums in enumerate(totals):
            if sums is not None:
                ids.append(np.full(len(sums), i))
                pos.append(np.arange(len(sums)))
                value.append(sums)
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v)) for v in (ids, pos, value)], names=["model", "pos", "value"]
            )

    schema = T.StructType(
        [T.StructField("model", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())]
    )
    rows = (
        table.mapInArrow(run, schema)
        .groupBy("model", "pos")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    out = {}
    for i, part in rows.groupby("model"):
        flat = np.zeros(int(part["pos"].max()) + 1)
        flat[part["pos"].to_numpy(int)] = part["value"].to_numpy(float)
        p = len(models[i].columns)
        upper = p * (p + 1) // 2
        gram = np.zeros((p, p))
        gram[np.triu_indices(p)] = flat[:upper]
        names = ("zwz", "n", "sum", "deviance", "loglik", "ylogy")
        out[i] = {
            "gram": gram + np.triu(gram, 1).T,
            "xz": flat[upper : upper + p],
            **dict(zip(names, flat[upper + p :])),
        }
    return out


def _independent(gram: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Columns that are not combinations of earlier ones; penalised ones are kept."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    a = gram / np.outer(scale, scale)
    kept = np.ones(len(a), bool)
    for j in np.flatnonzero(fixed):
        if a[j, j] <= 1e-10:
            kept[j] = False
            continue
        a = a - np.outer(a[:, j], a[j]) / a[j, j]
    return kept


def _turned(model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    """An orthogonal map under which every penalty is diagonal, and those diagonals at smoothing 1.

    A large smoothing then swamps no entry of X'WX but the diagonal ones of its own directions.
    """
    p = len(model.columns)
    turn, diagonals = np.eye(p), []
    for at, s in model.penalties:
        value, vector = np.linalg.eigh(s)
        turn[np.ix_(at, at)] = vector
        diagonal = np.zeros(p)
        diagonal[at] = np.where(value > 1e-14 * len(at) * value[-1], value, 0.0)
        diagonals.append(diagonal)
    return turn, diagonals


def _penalty(model: Model, log_lambda: np.ndarray) -> np.ndarray:
    p = len(model.columns)
    out = np.zeros((p, p))
    for (at, s), value in zip(model.penalties, log_lambda):
        out[np.ix_(at, at)] += math.exp(value) * s
    return out


def _inverse(gram: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Inverse of gram + diag(diagonal), scaled to a unit diagonal on the way."""
    whole = gram + np.diag(diagonal)
    scale = 1 / np.sqrt(np.maximum(np.diag(whole), 1e-300))
    return np.linalg.pinv(whole * np.outer(scale, scale), hermitian=True) * np.outer(scale, scale)


def _solve(model: Model, sums: dict, log_lambda: np.ndarray) -> dict:
    k = model.kept
    gram, xz = sums["gram"][np.ix_(k, k)], sums["xz"][k]
    turn, diagonals = _turned(model)
    turn = turn[np.ix_(k, k)]
    rough = sum((math.exp(v) * d[k] for v, d in zip(log_lambda, diagonals)), np.zeros(int(k.sum())))
    inner = _inverse(turn.T @ gram @ turn, rough)
    inverse = turn @ inner @ turn.T
    b = turn @ (inner @ (turn.T @ xz))
    edf = np.einsum("ij,ji->i", inverse, gram)
    rss = sums["zwz"] - 2 * b @ xz + b @ gram @ b
    beta = np.zeros(len(k))
    beta[k] = b
    full_edf, full_cov = np.zeros(len(k)), np.full((len(k), len(k)), np.nan)
    full_edf[k] = edf
    full_cov[np.ix_(k, k)] = inverse
    return {"beta": beta, "edf": full_edf, "cov": full_cov, "ubre": rss / sums["n"] + 2 * edf.sum() / sums["n"] - 1}


def _tune(model: Model, sums: dict) -> np.ndarray:
    """Smoothing parameters of the working model: coordinate search on its UBRE."""
    best = model.log_lambda.copy()
    score = _solve(model, sums, best)["ubre"]
    for step in (4.0, 2.0, 1.0, 0.5, 0.25, 0.1):
        moved = True
        while moved:
            moved = False
            for j in range(len(best)):
                for sign in (-1, 1):
                    trial = best.copy()
                    trial[j] = np.clip(trial[j] + sign * step, *LOG_LAMBDA)
                    value = _solve(model, sums, trial)["ubre"]
                    if value < score - 1e-12:
                        best, score, moved = trial, value, True
    return best


def _fit_all(
    table: DataFrame, blocks: list[Block], models: list[Model], near: float = 0.05
) -> None:
    """Iterate all models together until each has converged.

    A step that raises the penalised deviance is halved; one that cannot lower
    it raises an error.  Smoothing parameters are tuned along the way until
    they move by less than ``near``, or come back to values they had (the
    refinement follows).
    """
    tolerance = DEVIANCE_TOLERANCE
    for start in range(0, len(models), MODELS_PER_PASS):
        group = models[start : start + MODELS_PER_PASS]
        while active := [m for m in group if not m.done]:
            sums = _pass(table, blocks, active)
            for i, model in enumerate(active):
                if i not in sums:
                    model.done = True
                    continue
                s = sums[i]
                model.steps += 1
                if model.beta is not None:
                    worth = s["deviance"] + float(model.beta @ _penalty(model, model.log_lambda) @ model.beta)
                    still = abs(model.deviance - s["deviance"]) <= tolerance * (abs(s["deviance"]) + 0.1)
                    higher = model.before is not None and not worth <= model.before[0] + tolerance * (abs(model.before[0]) + 0.1)
                    if higher and not still:
                        model.halvings += 1
                        if model.halvings > MOST_HALVINGS:
                            raise ValueError(f"model {model.model_id}: no step lowers the deviance of {model.before[0]:g}")
                        model.beta = (model.beta + model.before[1]) / 2
                        continue
                    model.before, model.halvings = (worth, model.beta), 0
                if model.kept is None:
                    penalised = {int(c) for at, _ in model.penalties for c in at}
                    fixed = np.array([c not in penalised for c in range(len(model.columns))])
                    model.kept = _independent(s["gram"], fixed)
                if model.beta is not None:
                    fit = _solve(model, s, model.log_lambda)
                    settled = abs(model.deviance - s["deviance"]) <= tolerance * (abs(s["deviance"]) + 0.1)
                    edf = float(fit["edf"].sum())
                    model.result = {
                        **{key: float(s[key]) for key in ("n", "sum", "deviance", "loglik", "ylogy")},
                        "cov": fit["cov"],
                        "gram": s["gram"],
                        "score": s["xz"] - s["gram"] @ np.where(model.kept, model.beta, 0.0),
                        "edf": fit["edf"],
                        "aic": -2 * s["loglik"] + 2 * edf,
                        "ubre": s["deviance"] / s["n"] + 2 * edf / s["n"] - 1,
                    }
                    model.deviance = s["deviance"]
                    if settled:
                        model.done = True
                        continue
                if model.tune and len(model.penalties):
                    tuned = _tune(model, s)
                    spot = tuple(np.round(tuned, 2))
                    if model.beta is not None and (np.max(np.abs(tuned - model.log_lambda)) < near or spot in model.tried):
                        model.tune = False
                    model.tried.add(spot)
                    model.log_lambda, model.before = tuned, None
                model.beta = _solve(model, s, model.log_lambda)["beta"]


def _slope_sums(table: DataFrame, blocks: list[Block], model: Model, lever: np.ndarray, slopes: np.ndarray) -> dict:
    """One pass for the derivatives of UBRE at a fit, over the kept columns.

    With weights w, h = x' lever x and s_j = x' slopes[j] of each merged row it sums
    X'(w h), X' diag(w s_j) X of each j, and w s_j s_k h of each pair.
    """
    chosen, beta, kept = model.blocks, np.where(model.kept, model.beta, 0.0), model.kept
    width, count = int(kept.sum()), len(slopes)
    triangle, pairs = np.triu_indices(width), np.triu_indices(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            data = {
                name: batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False)
                for i, name in enumerate(batch.schema.names)
            }
            whole = np.logical_and.reduce([~np.isnan(data[blocks[b].sources[0]]) for b in chosen])
            data = {name: values[whole] for name, values in data.items()}
            X = np.hstack([np.ones((int(whole.sum()), 1)), *[blocks[b].matrix(data) for b in chosen]])
            w = data["__n"] * np.exp(X @ beta)
            X = X[:, kept]
            h = np.einsum("ij,jk,ik->i", X, lever, X, optimize=True)
            s = X @ slopes.T
            parts = [X.T @ (w * h)]
            parts += [(X.T @ (X * (w * s[:, j])[:, None]))[triangle] for j in range(count)]
            parts.append((s.T @ (s * (w * h)[:, None]))[pairs])
            sums = np.concatenate(parts)
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pos", "value"])

    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())])
    flat = np.zeros(width + count * len(triangle[0]) + len(pairs[0]))
    for r in table.mapInArrow(run, schema).groupBy("pos").agg(F.sum("value").alias("value")).collect():
        flat[r["pos"]] = r["value"]

    def symmetric(values: np.ndarray, size: int, at: tuple) -> np.ndarray:
        out = np.zeros((size, size))
        out[at] = values
        return out + np.triu(out, 1).T

    grams = flat[width : width + count * len(triangle[0])].reshape(count, -1)
    return {
        "pull": flat[:width],
        "grams": [symmetric(g, width, triangle) for g in grams],
        "pairs": symmetric(flat[width + grams.size :], count, pairs),
    }


def ubre_slopes(table: DataFrame, blocks: list[Block], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and Hessian of UBRE in the log smoothing parameters, and the slopes of the coefficients.

    At the fit (G + S) b' = -l_j S_j b, G = X'WX, S = sum_j l_j S_j, since the
    link is canonical; the deviance moves by -2 b'S b'.  Derivatives of the
    degrees of freedom tr((G + S)^-1 G) need those of G, which one pass sums.
    """
    k, n, size = model.kept, model.result["n"], len(model.penalties)
    turn, diagonals = _turned(model)
    turn = turn[np.ix_(k, k)]
    rough = [math.exp(v) * d[k] for v, d in zip(model.log_lambda, diagonals)]
    G = turn.T @ model.result["gram"][np.ix_(k, k)] @ turn
    V = _inverse(G, sum(rough))
    VG = V @ G
    lever = V - VG @ V
    # at the fit the penalty's pull S b is the score, block by block
    score = model.result["score"][k]
    whole = turn.T @ score
    places = np.flatnonzero(k)
    pulls = [turn.T @ np.where(np.isin(places, at), score, 0.0) for at, _ in model.penalties]
    slopes = np.array([-V @ pull for pull in pulls])
    sums = _slope_sums(table, blocks, model, turn @ lever @ turn.T, slopes @ turn.T)
    pull, own = turn.T @ sums["pull"], [turn.T @ g @ turn for g in sums["grams"]]
    moved = [own[j] + np.diag(rough[j]) for j in range(size)]
    VP = [V @ m for m in moved]
    gradient = np.array([
        (-2 * whole @ slopes[j] + 2 * (np.trace(V @ own[j]) - np.trace(VP[j] @ VG))) / n for j in range(size)
    ])
    hessian = np.zeros((size, size))
    for j in range(size):
        for i in range(j, size):
            bend = -V @ (moved[i] @ slopes[j] + rough[j] * slopes[i] + (pulls[j] if i == j else 0.0))
            deviance = -2 * (pulls[i] @ slopes[j] + (sum(rough) * slopes[i]) @ slopes[j] + whole @ bend)
            freedom = sums["pairs"][j, i] + bend @ pull
            freedom -= np.trace(VP[i] @ V @ own[j]) + np.trace(VP[j] @ V @ own[i])
            freedom += np.trace(VP[i] @ VP[j] @ VG) + np.trace(VP[j] @ VP[i] @ VG)
            if i == j:
                freedom -= np.trace((V * rough[j]) @ VG)
            hessian[j, i] = hessian[i, j] = (deviance + 2 * freedom) / n
    return gradient, hessian, slopes @ turn.T


def _refine(table: DataFrame, blocks: list[Block], model: Model) -> Model:
    """Newton steps on the UBRE of the full fit until its gradient is nil.

    A direction of negative curvature is followed downhill; no step is longer
    than ``LONGEST_STEP``.  Fractions of a step are fitted in the same passes,
    each from the coefficients that its slopes predict.  A parameter at an end
    of its range stays there while the gradient points outward.
    """
    for _ in range(MOST_NEWTON_STEPS):
        gradient, hessian, slopes = ubre_slopes(table, blocks, model)
        at = model.log_lambda
        free = ~(((at >= LOG_LAMBDA[1]) & (gradient < 0)) | ((at <= LOG_LAMBDA[0]) & (gradient > 0)))
        model.gradient = np.where(free, gradient, 0.0)
        if np.abs(model.gradient).max() < GRADIENT_TOLERANCE:
            return model
        value, vector = np.linalg.eigh(hessian[np.ix_(free, free)])
        curve = np.maximum(np.abs(value), 1e-7 * max(np.abs(value).max(), 1e-300))
        step = np.zeros(len(at))
        step[free] = -vector @ ((vector.T @ gradient[free]) / curve)
        step *= min(1.0, LONGEST_STEP / np.abs(step).max())
        trials = []
        for share in STEP_SHARES:
            moved = np.clip(at + share * step, *LOG_LAMBDA)
            start = model.beta.copy()
            start[model.kept] += (moved - at) @ slopes
            trials.append(replace(model, log_lambda=moved, beta=start, tune=False, deviance=math.inf, done=False,
                                  before=None, halvings=0, gradient=None, result={}))
        _fit_all(table, blocks, trials)
        scores = [t.result.get("ubre", math.inf) for t in trials]
        if not min(scores) <= model.result["ubre"] + UBRE_NOISE:
            break
        model = next(t for t, score in zip(trials, scores) if score <= min(scores) + UBRE_NOISE)
    return model


# ---------------------------------------------------------------- results


@dataclass
class PoissonFits:
    """Fitted models: tidy tables, and what is needed to apply them to rows."""

    terms: DataFrame
    models: DataFrame
    y: str
    blocks: list[Block]
    fitted: dict[str, Model]
    #: A row per smooth: model_id, term, edf, ref_df, statistic and p of the test that the smooth is zero.
    smooths: DataFrame | None = None
    #: A row per smooth: model_id, term, smoothing (the multiplier of its penalty), gradient of UBRE in its
    #: logarithm (NULL where it was not tuned to its minimum) and at_bound.
    smoothing: DataFrame | None = None

    def linear_predictor(self, model_id: str) -> Column:
        """The linear predictor as a column; only smooths leave the JVM."""
        model = self.fitted[model_id]
        beta = np.where(model.kept, model.beta, 0.0)
        at = 1
        out = F.lit(float(beta[0]))
        for b in model.blocks:
            block = self.blocks[b]
            coefs = [float(v) for v in beta[at : at + len(block.names)]]
            at += len(block.names)
            x = missing_as_null(F.col(block.sources[0]).try_cast("double"))
            if block.kind == "linear":
                out = out + coefs[0] / block.scale * (x - block.centre)
            elif block.kind == "factor":
                named = F.col(block.sources[0]) if block.texts is not None else x
                for level, c in zip(block.levels if block.texts is None else block.texts, coefs):
                    out = out + F.lit(c) * (named == F.lit(level)).cast("double")
            elif block.kind == "harmonic":
                cos, sin = harmonic_terms(x, block.scale).values()
                out = out + coefs[0] * cos + coefs[1] * sin
            else:
                out = out + _smooth_value(block.spline, np.array(coefs))(x)
        return out

    def residuals(self, df: DataFrame, model_id: str | None = None) -> DataFrame:
        """Every row with its fitted mean and deviance residual."""
        name = model_id or next(iter(self.fitted))
        mu, y = F.col("fit"), F.col(self.y).cast("double")
        unit = F.when(y > 0, y * F.ln(F.try_divide(y, mu))).otherwise(0.0) - (y - mu)
        residual = F.signum(y - mu) * F.sqrt(F.greatest(2 * unit, F.lit(0.0)))
        return df.withColumn("fit", F.exp(self.linear_predictor(name))).withColumn("residual", residual)


def _smooth_value(spline: SplineBasis | ThinPlateBasis, coefs: np.ndarray):
    @F.pandas_udf(T.DoubleType())
    def value(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        return pd.Series(np.where(np.isnan(v), np.nan, spline(np.nan_to_num(v)) @ coefs))

    return value


def _raw_scale(model: Model, blocks: list[Block]) -> np.ndarray:
    """Linear map from fitted (centred, scaled) coefficients to raw ones."""
    p = len(model.columns)
    out = np.eye(p)
    at = 1
    for b in model.blocks:
        block = blocks[b]
        if block.kind == "linear" and model.kept[at]:
            out[at, at] = 1 / block.scale
            out[0, at] = -block.centre / block.scale
        at += len(block.names)
    return out


def _names(model: Model, blocks: list[Block]) -> list[str]:
    return ["(Intercept)", *[n for b in model.blocks for n in blocks[b].names]]


def smooth_test(beta: np.ndarray, cov: np.ndarray, gram: np.ndarray, at: np.ndarray) -> tuple[float, float, float]:
    """Wald test that a smooth is zero: reference degrees of freedom, statistic and p.

    The smooth's values have the covariance R V R' with R'R = X'WX.  Its
    pseudo-inverse is truncated to the rank r = tr(2F - FF) of the smooth,
    F = V X'WX, at least 1; between whole ranks k and k + 1 the last two
    directions share a block that makes the statistic's mean r.  Under the
    null it is a sum of k - 1 squared normals and two weighted ones.  The
    block's sign depends on those of the eigenvectors, which are arbitrary:
    statistic and p are the means over both.
    """
    hat = cov @ gram
    reference = float(np.trace((2 * hat - hat @ hat)[np.ix_(at, at)]))
    value, vector = np.linalg.eigh(gram[np.ix_(at, at)])
    root = (vector * np.sqrt(np.maximum(value, 0))) @ vector.T
    spread, direction = np.linalg.eigh(root @ cov[np.ix_(at, at)] @ root)
    spread, direction = spread[::-1], direction[:, ::-1]
    usable = int((spread > spread[0] * 1e-12).sum()) if len(spread) and spread[0] > 0 else 0
    if usable == 0:
        return reference, math.nan, math.nan
    rank = min(max(reference, 1.0), float(usable))
    k = int(math.floor(rank + 1e-9))
    part = max(rank - k, 0.0) if k < usable else 0.0
    score = (direction.T @ (root @ beta[at]))[:usable] / np.sqrt(spread[:usable])
    if part < 1e-8:
        statistic = float((score[:k] ** 2).sum())
        return reference, statistic, chi_square_sf(statistic, k)
    side = math.sqrt(part * (1 - part) / 2)
    middle = float((score[: k - 1] ** 2).sum() + score[k - 1] ** 2 + part * score[k] ** 2)
    turn = 2 * side * float(score[k - 1] * score[k])
    wide = (part + 1 + math.sqrt(1 - part * part)) / 2
    tails = [chi_mixture_sf(middle + sign * turn, k - 1, wide, part + 1 - wide) for sign in (-1, 1)]
    return reference, middle, sum(tails) / 2


SMOOTHING_SCHEMA = "model_id string, term string, smoothing double, gradient double, at_bound boolean"
SMOOTH_SCHEMA = "model_id string, term string, edf double, ref_df double, statistic double, p double"
TERM_SCHEMA = "model_id string, term string, estimate double, std_error double, z double, p double, edf double"
MODEL_SCHEMA = (
    "model_id string, n double, edf double, deviance double, null_deviance double, "
    "deviance_explained double, loglik double, aic double, ubre double, converged boolean, iterations int, at_bound boolean"
)


def _clean(row: Sequence) -> tuple:
    plain = (float(v) if isinstance(v, (float, np.floating)) else v for v in row)
    return tuple(None if isinstance(v, float) and not math.isfinite(v) else v for v in plain)


def _collect(df: DataFrame, y: str, blocks: list[Block], models: list[Model]) -> PoissonFits:
    term_rows, model_rows, tests, chosen = [], [], [], []
    for model in models:
        r = model.result
        if not r:
            raise ValueError(f"model {model.model_id} has no complete rows")
        to_raw = _raw_scale(model, blocks)
        beta = to_raw @ np.where(model.kept, model.beta, 0.0)
        cov = to_raw @ np.nan_to_num(r["cov"]) @ to_raw.T
        at = 1
        smooth_rows = []
        smooth_columns: set[int] = set()
        penalised = [b for b in model.blocks if blocks[b].penalty is not None]
        for j, b in enumerate(penalised):
            value = model.log_lambda[j]
            slope = math.nan if model.gradient is None else model.gradient[j]
            multiplier = math.exp(value) / np.abs(blocks[b].penalty).max()
            chosen.append(_clean((model.model_id, blocks[b].label, multiplier, slope, bool(value in LOG_LAMBDA))))
        for b in model.blocks:
            width = len(blocks[b].names)
            if blocks[b].kind == "smooth":
                smooth_columns |= set(range(at, at + width))
                total = float(r["edf"][at : at + width].sum())
                smooth_rows.append(_clean((model.model_id, blocks[b].label, None, None, None, None, total)))
                own = np.arange(at, at + width)[model.kept[at : at + width]]
                tested = smooth_test(np.where(model.kept, model.beta, 0.0), np.nan_to_num(r["cov"]), r["gram"], own)
                tests.append(_clean((model.model_id, blocks[b].label, total, *tested)))
            at += width
        for j, name in enumerate(_names(model, blocks)):
            if not model.kept[j]:
                term_rows.append((model.model_id, name, None, None, None, None, 0.0))
                continue
            se = math.sqrt(max(cov[j, j], 0.0))
            z = beta[j] / se if se > 0 else math.nan
            p = float(normal_sf2(np.array([z]))[0]) if math.isfinite(z) else math.nan
            smooth = j in smooth_columns
            term_rows.append(
                _clean((model.model_id, name, float(beta[j]), se, math.nan if smooth else z,
                        math.nan if smooth else p, float(r["edf"][j])))
            )
        term_rows.extend(smooth_rows)
        mean = r["sum"] / r["n"]
        null = 2 * (r["ylogy"] - (r["sum"] * math.log(mean) if mean > 0 else 0.0))
        explained = 1 - r["deviance"] / null if null > 0 else math.nan
        model_rows.append(
            _clean((model.model_id, r["n"], float(r["edf"].sum()), r["deviance"], null, explained,
                    r["loglik"], float(r["aic"]), float(r["ubre"]), model.done, model.steps,
                    bool(len(model.log_lambda) and np.isin(model.log_lambda, LOG_LAMBDA).any())))
        )
    spark = df.sparkSession
    return PoissonFits(
        spark.createDataFrame(term_rows, TERM_SCHEMA),
        spark.createDataFrame(model_rows, MODEL_SCHEMA),
        y,
        blocks,
        {m.model_id: m for m in models},
        spark.createDataFrame(tests, SMOOTH_SCHEMA),
        spark.createDataFrame(chosen, SMOOTHING_SCHEMA),
    )


def blocks_free(model: Model, blocks: list[Block], fixed: Mapping[Smooth, float]) -> bool:
    """Whether the model has a smooth whose smoothing is not given."""
    return any(blocks[b].kind == "smooth" and blocks[b].term not in fixed for b in model.blocks)


class Bench:
    """The merged rows of some terms, on which any models of them are fitted."""

    def __init__(self, df: DataFrame, y: str, terms: Sequence[Term], smoothing: Mapping[Smooth, float] | None = None) -> None:
        self.df, self.y, self.fixed = df, y, smoothing or {}
        terms = list(dict.fromkeys(terms))
        merged, _ = _merge(df, y, terms)
        self.table, texts = _numbered(durable(merged), _text_factors(df, terms))
        self.blocks = _blocks(self.table, terms, texts)
        self.index = {t: i for i, t in enumerate(terms)}

    def model(self, model_id: str, wanted: Sequence[Term]) -> Model:
        chosen = [self.index[t] for t in wanted]
        penalties, start, at = [], [], 1
        for b in chosen:
            block = self.blocks[b]
            width = len(block.names)
            if block.penalty is not None:
                s = block.penalty
                penalties.append((np.arange(at, at + width), s / np.abs(s).max()))
                given = self.fixed.get(block.term)
                start.append(None if given is None else math.log(given * np.abs(s).max()))
            at += width
        tune = any(v is None for v in start)
        if tune and any(v is not None for v in start):
            raise ValueError(f"model {model_id}: fix the smoothing of all its smooths or of none")
        return Model(model_id, chosen, np.arange(at), penalties, np.array([v or 0.0 for v in start]), tune)

    def fit(self, models: Mapping[str, Sequence[Term]], refine: bool = True) -> list[Model]:
        fits = [self.model(name, wanted) for name, wanted in models.items()]
        _fit_all(self.table, self.blocks, fits, 1.0 if refine else 0.05)
        if refine:
            free = {m.model_id for m in fits if m.penalties and m.result and blocks_free(m, self.blocks, self.fixed)}
            fits = [_refine(self.table, self.blocks, m) if m.model_id in free else m for m in fits]
        return fits

    def collect(self, models: list[Model]) -> PoissonFits:
        return _collect(self.df, self.y, self.blocks, models)


def fit_poisson(
    df: DataFrame, y: str, models: Mapping[str, Sequence[Term]], refine: bool = True,
    smoothing: Mapping[Smooth, float] | None = None,
) -> PoissonFits:
    """Fit several Poisson models to the same rows.

    Each model uses the rows where its own covariates are present.  With
    ``refine`` the smoothing parameters of every model with smooths end at a
    minimum of UBRE = D/n + 2 edf/n - 1 over the full fits.  ``smoothing``
    fixes the multiplier of a smooth's penalty, the integral of the squared
    second derivative; a model whose smooths are all fixed is not tuned.
    """
    bench = Bench(df, y, [t for m in models.values() for t in m], smoothing)
    return bench.collect(bench.fit(models, refine))


def poisson_glm(
    df: DataFrame, y: str, xs: Sequence[str], factors: Sequence[str] = (), harmonics: Sequence[Harmonic] = (),
    model_id: str = "model", dense_levels: int = 256,
) -> PoissonFits | AbsorbedFit:
    """Log-link Poisson model with numeric, factor and harmonic terms.

    Factors with more than ``dense_levels`` levels together are not made
    columns: the two largest are absorbed, their effects stay tables, and
    their levels have estimates without errors; the other terms are the same.
    """
    if factors:
        from shoalwise.operators.absorbed import fit_absorbed
        from shoalwise.operators.factors import level_counts

        if sum(level_counts(df, factors).values()) > dense_levels:
            return fit_absorbed(df, y, xs, factors, harmonics, model_id, dense_levels)
    return fit_poisson(df, y, {model_id: [*xs, *[Factor(f) for f in factors], *harmonics]})


def poisson_gam(
    df: DataFrame, y: str, linear: Sequence[Term] = (), smooths: Sequence[Smooth] = (), model_id: str = "model",
    refine: bool = True, smoothing: Mapping[Smooth, float] | None = None,
) -> PoissonFits:
    """Poisson additive model with penalised splines next to other terms."""
    return fit_poisson(df, y, {model_id: [*linear, *smooths]}, refine, smoothing)


def one_by_one(df: DataFrame, y: str, candidates: Sequence[Term], fixed: Sequence[Term] = ()) -> PoissonFits:
    """One model per candidate next to the fixed terms, fitted in the same passes."""
    return fit_poisson(df, y, {term_label(c): [c, *fixed] for c in candidates})


def _subset_name(fixed: Sequence[Term], chosen: Sequence[Term]) -> str:
    return " + ".join(term_label(t) for t in [*fixed, *chosen]) or "1"


def _all_subsets(terms: Sequence[Term], fixed: Sequence[Term]) -> dict[str, list[Term]]:
    return {
        _subset_name(fixed, chosen): [*fixed, *chosen]
        for size in range(len(terms) + 1)
        for chosen in itertools.combinations(terms, size)
    }


def _leading_subsets(bench: Bench, terms: Sequence[Term], fixed: Sequence[Term], ignore: float) -> list[Model]:
    """The subsets that hold all Akaike weight but at most ``ignore`` of it, by branch and bound.

    A branch is the subsets with some terms in and others still open.  None of
    them has a lower deviance than the model of all these terms, D, nor fewer
    coefficients than its settled terms, q; with open terms of c_1, c_2 ...
    coefficients their weights sum to exp(-D/2 - q) (1 + exp(-c_1)) (1 +
    exp(-c_2)) ... at most.  Only coefficients that are no combination of
    earlier ones in the model of all terms count in q and c: they are
    independent in every subset.  Branches of the greatest bounds are split
    first, many in the same passes.
    """
    if any(isinstance(t, Smooth) for t in [*terms, *fixed]):
        raise ValueError("a smooth has no bound of its deviance; fit all subsets of such terms (ignore=0)")
    everything = tuple(range(len(terms)))
    fitted: dict[tuple[int, ...], Model] = {}

    def fit(wanted: Sequence[tuple[int, ...]]) -> None:
        missing = [w for w in dict.fromkeys(wanted) if w not in fitted]
        models = bench.fit({_subset_name(fixed, [terms[i] for i in w]): [*fixed, *[terms[i] for i in w]] for w in missing})
        fitted.update(zip(missing, models, strict=True))

    fit([everything, ()])
    if not fitted[everything].result or not fitted[()].result:
        return list(fitted.values())
    full = fitted[everything]
    ends = np.cumsum([1, *[len(bench.blocks[b].names) for b in full.blocks]])[len(fixed):]
    adds = [int(full.kept[ends[i] : ends[i + 1]].sum()) for i in everything]
    least = int(fitted[()].kept.sum())
    level = full.result["deviance"] / 2

    def bound(inside: tuple[int, ...], open_: tuple[int, ...]) -> float:
        top = fitted[tuple(sorted(inside + open_))]
        size = least + sum(adds[i] for i in inside)
        # a settled deviance is above the least one by less than its last change
        slack = DEVIANCE_TOLERANCE * (top.result["deviance"] + 0.1)
        return math.exp(level - top.result["deviance"] / 2 + slack - size) * math.prod(1 + math.exp(-adds[i]) for i in open_)

    def weight(model: Model) -> float:
        return math.exp(level - model.result["deviance"] / 2 - float(model.result["edf"].sum()))

    # a branch's own top model is fitted; what is still unknown are its other subsets
    branches = [((), everything, bound((), everything))]
    while branches:
        known = sum(weight(m) for m in fitted.values())
        branches.sort(key=lambda b: b[2])
        spare, kept = ignore * known, 0
        while kept < len(branches) and branches[kept][2] <= spare:
            spare -= branches[kept][2]
            kept += 1
        if kept == len(branches):
            break
        split = branches[kept:][-MODELS_PER_PASS:]
        branches = branches[: len(branches) - len(split)]
        children = []
        for inside, open_, _ in split:
            term, rest = open_[0], open_[1:]
            children += [((*inside, term), rest), (inside, rest)]
        fit([tuple(sorted(inside + rest)) for inside, rest in children])
        branches += [(inside, rest, bound(inside, rest)) for inside, rest in children if rest]
    return list(fitted.values())


def _decided(models: list[Model], confidence: float, ignore: float) -> bool:
    """Whether subsets left out, with at most ``ignore`` of the weight, cannot change the confidence set."""
    aic = np.sort([m.result["aic"] for m in models if m.result])
    if ignore == 0 or len(aic) == 0:
        return True
    share = np.exp(-(aic - aic[0]) / 2)
    share /= share.sum()
    running = np.cumsum(share)
    inside = running - share < confidence
    return bool(np.abs(running - confidence).min() > 2 * ignore and share[inside].min() > 2 * ignore)


def model_selection(
    df: DataFrame, y: str, terms: Sequence[Term], fixed: Sequence[Term] = (), confidence: float = 0.95,
    refine: bool = True, ignore: float = 0.0,
) -> tuple[DataFrame, DataFrame, PoissonFits]:
    """All subsets of terms ranked by AIC, and coefficients averaged over the best.

    Returns the ranking (delta, Akaike weight, running weight, membership of the
    confidence set), the averaged coefficients and the fits.  A model is in the
    set while the weights before it sum to less than ``confidence``; the best
    one always is, and the set is what is averaged.  Rows with any missing
    covariate are dropped, so all models see the same rows.  In the full
    average a term absent from a model counts as 0 there; its variance is the
    weighted mean of each model's variance plus squared distance from the
    average.

    With many terms, set ``ignore`` to a share of the Akaike weight that may be
    left out: subsets that are proven to hold at most that much together are
    then not fitted, and are absent from the ranking.  Weights are too large by
    that share at most.  The set is still that of all subsets: where a running
    weight comes near ``confidence``, or a model of the set weighs no more than
    the share, the share is divided by a thousand and the search goes on.
    """
    sources = list(dict.fromkeys(s for t in [*terms, *fixed] for s in _sources(t)))
    whole = df.na.drop("any", subset=[*sources, y])
    bench = Bench(whole, y, [*fixed, *terms])
    if ignore > 0:
        while not _decided(models := _leading_subsets(bench, terms, fixed, ignore), confidence, ignore):
            ignore = ignore / 1000 if ignore > 1e-12 else 0.0
    else:
        models = bench.fit(_all_subsets(terms, fixed), refine)
    fits = bench.collect(models)
    order = sorted(fits.fitted.values(), key=lambda m: (m.result["aic"], m.model_id))
    best = order[0].result["aic"]
    raw = [math.exp(-(m.result["aic"] - best) / 2) for m in order]
    weights = [w / sum(raw) for w in raw]
    rows, running, kept = [], 0.0, []
    for i, (m, w) in enumerate(zip(order, weights)):
        inside = running < confidence
        running += w
        rows.append(
            _clean((i + 1, m.model_id, m.result["edf"].sum(), m.result["deviance"], m.result["aic"],
                    m.result["aic"] - best, w, running, inside))
        )
        if inside:
            kept.append((m, w))
    spark = df.sparkSession
    ranking = spark.createDataFrame(
        rows,
        "rank int, model_id string, edf double, deviance double, aic double, delta double, weight double, "
        "cumulative double, in_set boolean",
    )
    total = sum(w for _, w in kept)
    found: dict[str, list[tuple[float, float, float]]] = {}
    for m, w in kept:
        to_raw = _raw_scale(m, fits.blocks)
        beta = to_raw @ np.where(m.kept, m.beta, 0.0)
        variance = np.diag(to_raw @ np.nan_to_num(m.result["cov"]) @ to_raw.T)
        for name, b, v in zip(_names(m, fits.blocks), beta, variance):
            found.setdefault(name, []).append((w / total, float(b), max(float(v), 0.0)))
    rows = []
    for name, parts in found.items():
        share = sum(w for w, _, _ in parts)
        mean = sum(w * b for w, b, _ in parts)
        error = math.sqrt(sum(w * (v + (b - mean) ** 2) for w, b, v in parts) + (1 - share) * mean**2)
        z = mean / error if error > 0 else math.nan
        p = float(normal_sf2(np.array([z]))[0]) if math.isfinite(z) else math.nan
        rows.append(_clean((name, mean, error, z, p, mean / share, share)))
    averaged = spark.createDataFrame(
        rows,
        "term string, full_average double, std_error double, z double, p double, conditional_average double, importance double",
    )
    return ranking, averaged, fits
