"""Hard negatives, token counts and repair against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shoalwise.llm import negatives, repair, tokencount

# ---------------------------------------------------------------- hard negatives


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(0, 40), st.integers(1, 70), st.integers(1, 9), st.integers(0, 9))
def test_strassen_is_the_product(m, k, n, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_strassen_is_exact_where_sums_overflow():
    big = np.full((40, 40), 2**60, dtype=np.int64)
    assert (negatives.strassen(big, np.eye(40, dtype=np.int64), 4) == big).all()


@given(st.integers(0, 1000), st.integers(1, 6))
def test_heap_orders_ties_by_column(seed, k):
    rng = np.random.default_rng(seed)
    scores, allowed = rng.integers(-3, 3, (4, 15)), rng.random((4, 15)) < 0.6
    row, column = negatives.heap(scores, allowed, k)
    for i in range(4):
        wanted = sorted(np.flatnonzero(allowed[i]), key=lambda j: (-scores[i, j], j))[:k]
        assert column[row == i].tolist() == wanted


def mined(rows, is_anchor, positives=5, kept=10):
    """Hard negatives of plain (id, label, vector) rows."""
    different = sorted({(i, y, tuple(v)) for i, y, v in rows}, key=str)
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for a in different:
        if not is_anchor(a[0]):
            continue
        same = sorted(((product(a[2], c[2]), c[0]) for c in different if c[1] == a[1] and c != a), key=key)[:positives]
        other = sorted(((product(a[2], c[2]), c[0]) for c in different if c[1] != a[1]), key=key)
        for p, pid in same:
            inside = [(s, i) for s, i in other if 30 * p <= 100 * s <= 90 * p][:kept]
            out += [(a[0], pid, r, i, p, s) for r, (s, i) in enumerate(inside, 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        length = 0 if i == 7 else 3 if i % 11 == 0 else 5
        vector = [round(rng.uniform(-1, 2), 2) for _ in range(length)]
        rows.append((i, i % 3, vector))
    rows += [(900 + i, 1, [1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(60)]  # ties
    rows += [rows[0], rows[0], (0, 2, [0.5] * 5), (None, 1, [1.5] * 5), (None, 2, [0.7] * 5)]
    odd = [(1000, None, [1.0]), (1001, 1, None), (1002, 1, [1.0, None]), (1003, 1, [math.nan]), (1004, 1, [math.inf]), (None, None, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").repartition(3)
    return rows, df.withColumn("group", F.lit("clash")).withColumn("id", F.lit(5))


def test_hard_negatives_against_brute_force(spark, vectors):
    rows, df = vectors
    ints = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows]
    wanted = mined(ints, lambda i: i is not None and i % 20 == 0)
    assert len(wanted) > 200 and any(r[1] is None or r[3] is None for r in wanted)
    anchors = F.col("id") % 20 == 0
    for group_rows in (40, 5000):
        found = negatives.hard_negatives(negatives.prepared(df, "vec_id", F.col("label"), "embedding"), anchors, group_rows=group_rows)
        got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect()]
        assert sorted(got, key=str) == wanted
    nothing = negatives.hard_negatives(negatives.prepared(df.limit(0), "vec_id", F.col("label"), "embedding"), anchors)
    assert nothing.count() == 0


# ---------------------------------------------------------------- tokens

SAID = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "I'm  the\n\n end'll ", "  \t\n ", "don'T", "naïve Ünï ３４ ① ²", "\x1c\x1d x", "՘\U00010940 a1՘", " x y"]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_are_the_librarys(spark, awkward, empty, whole):
    extra = spark.createDataFrame([(100 + i, t, "en", "s", 0) for i, t in enumerate(SAID)], awkward.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = awkward.unionByName(extra, allowMissingColumns=True)
    got = docs.select("text", tokencount.token_count(docs).alias("found")).collect()
    assert len(got) == docs.count()
    for row in got:
        assert row.found == len(whole.encode(row.text or "", add_special_tokens=False).ids)
    assert empty.select(tokencount.token_count(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["ab", "1", " ", "\n", "\t", "!", "<|endoftext|>", "é", "'s", "՘"]), max_size=60).map("".join), st.integers(1, 9))
def test_slices_keep_pre_tokens(text, chars):
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    parts = list(tokencount.slices(text, chars))
    assert "".join(parts) == text
    lengths = _lengths(definition)
    assert sum(map(lengths.count, parts)) == len(lengths.encode(text, add_special_tokens=False).ids)


_kept: dict = {}


def _lengths(definition):
    if not _kept:
        _kept["it"] = tokencount.Lengths({}, definition, public_tokenizers.PATTERN, tokencount.newer_letters())
    return _kept["it"]


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        tokencount.tokenizer(file.read())


# ---------------------------------------------------------------- repair

FULL = {"u": "user", "a": "assistant"}


def table(rows, start, ends):
    """Cheapest (cost, edits) by an exact table over all states."""

    def closed(best):
        for _ in range(3):
            for s, (c, e) in list(best.items()):
                after = repair.NEXT[s][1]
                best[after] = min(best.get(after, (math.inf, "")), (c + 3, e + "I"))
        return best

    best = closed({start: (0, "")})
    for initial, fault in rows:
        after: dict = {}
        for s, (c, e) in best.items():
            moves = [(s, c + 4, e + "D")]
            if fault in (repair.SOUND, repair.CUT):
                extra = 3 if fault == repair.CUT else 0
                kept = repair.kept_state(s, initial)
                moves += [(kept, c + extra, e + "K")] if kept is not None else []
                moves.append((repair.NEXT[s][1], c + 3 + extra, e + "R"))
            for t, cost, edits in moves:
                after[t] = min(after.get(t, (math.inf, "")), (cost, edits))
        best = closed(after)
    return min((best[s] for s in ends if s in best), default=None)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "u", "a", "a", "x", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=12), st.integers(0, 3))
def test_cheapest_is_the_exact_tables(rows, start):
    for ends in (repair.ENDS, (0,), (1,), (2,), (3,)):
        wanted = table(rows, start, ends)
        assert repair.cheapest(rows, start, ends) == wanted
        if wanted is not None:
            assert repair.cheapest(rows, start, ends, wanted[0]) == wanted
            assert repair.cheapest(rows, start, ends, wanted[0] - 1) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suuaax"), st.sampled_from([0, 0, 0, 1, 2, 3])), min_size=2, max_size=14), st.data())
def test_pieces_join_to_the_whole(rows, data):
    cut = data.draw(st.integers(1, len(rows) - 1))
    left, right = repair.ways_through(rows[:cut], True, False), repair.ways_through(rows[cut:], False, False)
    joined = [(a["cost"] + b["cost"], a["edits"] + b["edits"]) for a in left for b in right if a["end"] == b["start"] and b["end"] in repair.ENDS]
    assert min(joined) == table(rows, 0, repair.ENDS)


def plain(rows):
    """Summary and repaired digest of (conv, turn, role, text) rows."""
    convs: dict = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, said in convs.items():
        said.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in said:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = {t for t, _, _ in said if t is not None}
        initials = [role[:1] for _, role, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = table(list(zip(initials, faults, strict=True)), 0, repair.ENDS)
        lines, state, at = [], 0, 0
        for edit in audit:
            wanted, after = repair.NEXT[state]
            if edit == "I":
                lines.append(f"{FULL[wanted]}:")
                state = after
                continue
            _, role, text = said[at]
            at += 1
            if edit != "D":
                lines.append(f"{role if edit == 'K' else FULL[wanted]}:{text}")
                state = repair.kept_state(state, role[:1]) if edit == "K" else after
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def turns_of(seed, conv, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "because", "", " \t", "So. ", "é.", None]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None]
    return [(conv, rng.choice([i, i, i, i + 1, None]), roles[i % 2] if rng.random() < 0.8 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"Turn {i}.") for i in range(n)]


def test_repair_against_brute_force(spark, empty):
    rows = [r for conv in range(40) for r in turns_of(conv, conv, conv % 9)]
    rows += turns_of(100, 100, 900)  # several pieces, in several tasks
    rows += turns_of(101, None, 12) + [(102, 1, "user", "b" * 100_000 + " " * 50_000)] + [(103, 2, "user", "Same.")] * 400
    rows += [(104, i, "user", "Same.") for i in range(300)] + [(105, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")).withColumn("copies", F.lit(3))
    fixed = repair.repair_conversations(df.repartition(4))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_digests(df.select("conv_id").distinct(), fixed).collect()}
    assert got == plain(rows)
    none = repair.repair_conversations(df.limit(0))
    assert none.summary.count() == 0 and none.turns.count() == 0


def test_damage(spark):
    rows = turns_of(7, 1, 200) + turns_of(8, None, 50)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wanted = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        wanted += [(c, t, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=str) == sorted(wanted, key=str)


def test_conversations_without_turns_count_nothing(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    both = spark.createDataFrame([(1,), (2,), (None,)], "conv_id long")
    got = {r.conv_id: r for r in repair.repair_digests(both, repair.repair_conversations(df)).collect()}
    assert got[1].audit == "KI" and got[1].cost == 3
    for key in (2, None):
        assert got[key].audit == "" and got[key].cost == 0 and got[key].repaired_sha256 == hashlib.sha256().hexdigest()
