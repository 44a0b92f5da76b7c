"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed word and word-start features learns from
documents that are confirmed toxic and from unlabelled documents.  With the
class prior p, the risk on negatives is estimated as the risk of the unlabelled
taken as negatives, less p times that of the positives taken as negatives; where
this estimate is negative, the step goes the other way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shoalwise.llm.common import crc_remainder, plain_words, text_bytes

#: Hash space of the features.
WIDTH = 1 << 18
#: Bound of the sample that is fitted: confirmed toxic and unlabelled documents.
MOST_POSITIVE, MOST_UNLABELLED = 2500, 7500
THRESHOLD = 0.3


def features(text: bytes) -> np.ndarray:
    """Hashed features of a whole text: its distinct words, and their first 3, 4 and 5 bytes."""
    found: set[bytes] = set()
    for word in set(plain_words(text)):
        found.update((b"w" + word, b"3" + word[:3], b"4" + word[:4], b"5" + word[:5]))
    crc = zlib.crc32
    return np.unique(np.fromiter((crc(f) % WIDTH for f in found), dtype=np.int32, count=len(found)))


@dataclass
class Model:
    """Weights, bias, weight of the text's length (log of its number of features), and the class prior."""

    weights: np.ndarray
    bias: float
    prior: float
    length: float = 0.0

    def score(self, text: bytes) -> float:
        at = features(text)
        z = self.bias + self.length * np.log1p(len(at)) + self.weights[at].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _runs(rows: list[np.ndarray], size: int = 500) -> Iterator[np.ndarray]:
    """Rows put together some hundred at a time, so that no copy of all is made."""
    for at in range(0, len(rows), size):
        yield np.concatenate(rows[at : at + size])


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], lift: float = 2.0, errors: float = 6.0) -> np.ndarray:
    """Features that are ``lift`` times as frequent among the positives, by at least ``errors`` standard errors.

    Unlabelled documents contain toxic ones, so a feature of toxic texts alone
    has a lift of one over the prior.
    """
    count = lambda rows: sum((np.bincount(r, minlength=WIDTH) for r in _runs(rows)), np.zeros(WIDTH))
    with_p = count(positive) / len(positive)
    with_u = (count(unlabelled) + 1) / (len(unlabelled) + 1)
    error = np.sqrt(with_u * np.maximum(1 - with_u, 1e-3) / len(positive))
    return np.flatnonzero((with_p > lift * with_u) & (with_p - with_u > errors * error))


def fit(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    steps: int = 200,
    rate: float = 0.05,
    decay: float = 1e-3,
) -> Model:
    """Adam on the non-negative risk with the logistic loss over all examples; equal inputs give equal models."""
    model = Model(np.zeros(WIDTH), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), prior)
    if not positive or not unlabelled:
        return model
    kept = telling(positive, unlabelled)
    number = np.full(WIDTH, -1, dtype=np.int32)
    number[kept] = np.arange(len(kept))
    examples = positive + unlabelled
    size = np.log1p([len(r) for r in examples])
    rows = [x[x >= 0] for x in (number[r] for r in examples)]
    at = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, m = len(positive), len(unlabelled)
    weights, bias, length = np.zeros(len(kept)), model.bias, 0.0
    first, second = np.zeros(len(kept) + 2), np.zeros(len(kept) + 2)
    for t in range(1, steps + 1):
        z = bias + length * size + np.bincount(row, weights[at], n + m)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        negative = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
        # slopes in z of log(1 + e^-z), the loss as a positive, and of log(1 + e^z), the loss as a negative
        slope = np.empty(n + m)
        if negative >= 0:
            slope[:n] = prior * (q[:n] - 1) / n - prior * q[:n] / n
            slope[n:] = q[n:] / m
        else:
            slope[:n] = prior * q[:n] / n
            slope[n:] = -q[n:] / m
        grad = np.append(np.bincount(at, slope[row], len(kept)) + decay * weights, [slope.sum(), slope @ size])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights, bias, length = weights - move[:-2], bias - move[-2], length - move[-1]
    model.weights[kept] = weights
    model.bias, model.length = float(bias), float(length)
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
    held_out: int = 2,
) -> Model:
    """Fit on at most ``most_positive`` toxic and ``most_unlabelled`` other documents, chosen by a hash of the id.

    Labels count only where crc32 of the id modulo 4 is not ``held_out``; the
    unlabelled come from there too.  The prior is the share of toxic ones among
    those labels.  A label that is NULL is none; ids with several labels are
    toxic if one says so; ids with several texts give the smallest text.
    Without toxic or without unlabelled documents the model knows the prior alone.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_remainder(key, 4) != held_out))
        .groupBy(F.col(key).alias("id"))
        .agg(F.max(label).alias("y"))
    )
    counts = known.agg(F.count(F.lit(1)), F.sum(F.col("y").cast("long"))).first()
    prior = float(counts[1] or 0) / counts[0] if counts[0] else 0.0
    shuffled = F.xxhash64(F.lit("toxicity"), "id")
    chosen = known.where("y = 1").select("id").orderBy(shuffled, "id").limit(most_positive)
    others = (
        docs.where(F.col(key).isNotNull() & (crc_remainder(key, 4) != held_out))
        .select(F.col(key).alias("id"))
        .distinct()
        .orderBy(shuffled, "id")
        .limit(most_unlabelled)
    )

    @pandas_udf("binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(bytes(t)).astype("<i4").tobytes() for t in batch], dtype=object)

    # both lists of ids are bounded by their limits, so they may be broadcast
    wanted = F.broadcast(
        chosen.select("id", F.lit(1).alias("p")).unionByName(others.select("id", F.lit(0).alias("p")))
        .groupBy("id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    )
    texts = docs.select(F.col(key).alias("id"), text_bytes(text).alias("t")).join(wanted, "id")
    rows = texts.groupBy("id", "p", "u").agg(F.min("t").alias("t")).select("id", "p", "u", hashed("t").alias("f")).collect()
    rows = sorted((r["id"], r["p"], r["u"], np.frombuffer(r["f"], "<i4")) for r in rows)
    positive = [f for _, p, _, f in rows if p == 1]
    unlabelled = [f for _, _, u, f in rows if u == 0]
    return fit(positive, unlabelled, prior)


def score(text: str | Column, model: Model) -> Column:
    """Score of a whole text from 0 to 1; NULL and empty texts have the score of no features."""
    weights, bias, prior, length = model.weights.astype(np.float32), model.bias, model.prior, model.length

    @pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        here = Model(weights, bias, prior, length)
        for batch in batches:
            yield pd.Series([here.score(bytes(t)) for t in batch], dtype="float64")

    return scores.asNondeterministic()(text_bytes(text))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under ``threshold``, with all their columns; repeated rows stay as they are."""
    return docs.where(score(text, model) < threshold)
