from __future__ import annotations

import hashlib
import importlib
import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shoalwise import operators as op

ordered = importlib.import_module("shoalwise.operators.ordered")

SCHEMA = "year int, tow string, taxon string, cpue double"


def by_hand(samples: dict[str, set], permutations: int, seed: int) -> list[float]:
    """The mean curve from explicit orders."""
    total = [0] * len(samples)
    for p in range(1, permutations + 1):
        order = sorted(samples, key=lambda s: hashlib.md5(f"{s}-{p}-{seed}".encode()).hexdigest())
        seen: set = set()
        for k, s in enumerate(order):
            seen |= samples[s]
            total[k] += len(seen)
    return [t / permutations for t in total]


@pytest.fixture(scope="module")
def tiny(spark):
    """Three tows, three taxa, one tow that caught nothing."""
    data = [
        (2000, "a", "x", 1.0), (2000, "a", "y", 2.0), (2000, "b", "y", 1.0), (2000, "b", "z", 1.0),
        (2000, "c", "x", 0.0), (2000, None, "q", 4.0), (2000, "a", None, 4.0),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_rarefaction_by_enumeration(tiny):
    samples = {"a": {"x", "y"}, "b": {"y", "z"}, "c": set()}
    got = {r["k"]: r["richness"] for r in op.rarefaction(tiny, "year", "tow").collect()}
    for k in (1, 2, 3):
        sets = [len(set().union(*(samples[s] for s in c))) for c in combinations(samples, k)]
        assert got[k] == pytest.approx(sum(sets) / len(sets))


def test_accumulation_matches_explicit_orders(tiny):
    got = [r["richness"] for r in op.accumulation(tiny, "year", "tow", permutations=20, seed=5).orderBy("k").collect()]
    assert got == pytest.approx(by_hand({"a": {"x", "y"}, "b": {"y", "z"}, "c": set()}, 20, 5))


@pytest.fixture(scope="module")
def large(spark):
    """One dominant year and one small one."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, 2001).otherwise(2000).alias("year"),
        (F.hash("id") % 97).cast("string").alias("tow"),
        (F.pow(F.rand(3), 3) * 200).cast("int").cast("string").alias("taxon"),
        F.lit(1.0).alias("cpue"),
    )
    return rows.cache()


def sets_of(df, year):
    out: dict[str, set] = {}
    for r in df.where(F.col("year") == year).collect():
        out.setdefault(r["tow"], set()).add(r["taxon"])
    return out


@pytest.mark.parametrize("block", [4096, 50, 5])
def test_hash_blocks_do_not_change_the_curve(large, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    curve = op.accumulation(large, "year", "tow", permutations=10, seed=2)
    for year in (2000, 2001):
        got = [r["richness"] for r in curve.where(F.col("year") == year).orderBy("k").collect()]
        assert got == pytest.approx(by_hand(sets_of(large, year), 10, 2))


def test_rarefaction_blocks_and_formula(large, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 16)
    samples = sets_of(large, 2000)
    n = len(samples)
    counts: dict[str, int] = {}
    for s in samples.values():
        for t in s:
            counts[t] = counts.get(t, 0) + 1
    got = {r["k"]: r["richness"] for r in op.rarefaction(large, "year", "tow").where("year = 2000").collect()}
    assert len(got) == n
    for k in (1, 2, 7, n // 2, n - 1, n):
        want = sum(1 - math.comb(n - m, k) / math.comb(n, k) for m in counts.values())
        assert got[k] == pytest.approx(want, rel=1e-10)


def test_curve_properties(large):
    curve = [r["richness"] for r in op.accumulation(large, [], "tow", permutations=30).orderBy("k").collect()]
    exact = [r["richness"] for r in op.rarefaction(large, [], "tow").orderBy("k").collect()]
    assert all(b >= a for a, b in zip(curve, curve[1:]))
    assert curve[-1] == pytest.approx(exact[-1]) == large.select("taxon").distinct().count()
    assert max(abs(a - b) for a, b in zip(curve, exact)) < 0.05 * exact[-1]


def test_slope_and_quadratic(spark):
    curve = op.accumulation(
        spark.createDataFrame(
            [(y, f"s{i}", f"t{(i * j) % (5 + y % 7)}", 1.0) for y in range(2000, 2008) for i in range(12) for j in range(1, 4)],
            SCHEMA,
        ),
        "year", "tow", permutations=5,
    ).withColumn("log_k", F.ln("k"))
    slopes = op.trend(curve, "year", "richness", "log_k")
    assert slopes.where("se > 0").count() == 8


@pytest.mark.parametrize("chunk, part, read", [(4, 7, 64), (8, 1000, 1), (4096, 1 << 22, 1 << 25)])
def test_taxa_and_ranks_in_pieces(large, monkeypatch, chunk, part, read):
    """Small rows of ranks, tasks that count a few taxa at a time, and one permutation in memory."""
    pieces = importlib.import_module("shoalwise.operators.accumulation")
    for name, size in (("CHUNK", chunk), ("SLICE", part), ("READ", read)):
        monkeypatch.setattr(pieces, name, size)
    df = large.withColumn("year", F.when(F.col("year") == 2001, F.lit(None)).otherwise(F.col("year")))
    curve = op.accumulation(df, "year", "tow", permutations=9, seed=4)
    for year, old in ((None, 2001), (2000, 2000)):
        got = [r["richness"] for r in curve.where(F.col("year").eqNullSafe(F.lit(year))).orderBy("k").collect()]
        assert got == pytest.approx(by_hand(sets_of(large, old), 9, 4))


def test_no_ranks_move_with_the_observations(large, monkeypatch):
    """A row of the step that finds first ranks has a key, a place and a mark, whatever the permutations."""
    pieces = importlib.import_module("shoalwise.operators.accumulation")
    seen = {}
    inner = pieces._first_ranks
    monkeypatch.setattr(pieces, "_first_ranks", lambda cells, *a: seen.setdefault("cells", cells) and inner(cells, *a))
    op.accumulation(large, "year", "tow", permutations=50)
    assert dict(seen["cells"].dtypes) == {"__key": "bigint", "__place": "int", "__first": "boolean"}


def test_samples_of_one_name_and_no_catch(spark):
    empty = op.accumulation(spark.createDataFrame([], SCHEMA), "year", "tow", permutations=3)
    assert empty.collect() == []
    none = op.accumulation(spark.createDataFrame([(1, "a", "x", 0.0), (1, "b", "x", 0.0)], SCHEMA), "year", "tow", permutations=3)
    assert [(r["k"], r["richness"]) for r in none.orderBy("k").collect()] == [(1, 0.0), (2, 0.0)]
