from __future__ import annotations

import random
import re
import time
import tracemalloc

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoalwise.llm import decontam, simhash
from tests.llm.conftest import prose


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_is_sorted(codes):
    codes = np.array(codes, dtype=np.int64)
    got = decontam.suffix_array(codes, max(len(codes), 1)).tolist()
    assert sorted(got) == np.flatnonzero(codes).tolist()

    def run(at):  # up to the next 0
        out = []
        while at < len(codes) and codes[at]:
            out.append(int(codes[at]))
            at += 1
        return out

    assert [run(p) for p in got] == sorted(run(p) for p in got)


def expected(texts, items):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[j : j + k]), set()).add("" if i is None else str(i))
    out = []
    for d, t in texts:
        w = plain_words(t)
        hit, named = [False] * len(w), set()
        for x, who in windows.items():
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    named |= who
                    hit[j : j + len(x)] = [True] * len(x)
        spans = [i for i in range(len(w) + 1) if (hit[i - 1] if i else False) != (hit[i] if i < len(w) else False)]
        out.append((str(d), len(w), sum(hit), sorted(named), spans))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 25, 200])
def test_contamination_matches_brute_force(spark, awkward, block_bytes):
    items = [(1, prose(900, 30)), (2, prose(901, 13)), (3, "ba da re"), (4, ""), (5, None), (6, prose(900, 30)), (None, prose(902, 14)), (7, "Single!"), (8, "bada bada bada bada")]
    planted = [
        (300, f"{prose(3, 40)} {prose(900, 30).upper()} {prose(4, 20)}"), (301, prose(901, 13)), (302, prose(901, 12)),
        (303, f"x {prose(902, 14)}, {prose(902, 14)} y single"), (304, " ".join(["bada"] * 9)), (305, prose(901, 13)),
    ]
    docs = awkward.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    bench = decontam.Benchmark(
        spark.createDataFrame(items, "item_id long, text string").withColumn("block", F.lit(9)), block_bytes=block_bytes
    )
    assert (bench.blocks > 1) == (block_bytes == 200)
    found = docs.select("doc_id", decontam.contamination("text", bench, shard_words=500).alias("f"))
    got = sorted((str(r.doc_id), r.f.n_words, r.f.n_hit, r.f.item_ids, r.f.hit_spans) for r in found.collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    dirty = {g[0] for g in got if g[2] and 20 * g[2] >= g[1]}
    assert {str(r.doc_id) for r in kept.select("doc_id").collect()} == {g[0] for g in got} - dirty | ({"3"} if "3" in dirty else set())


def test_longest_matches_match_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "d"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(12)]
    items = [(1, " ".join(rng.choice(words) for _ in range(16))), (2, "e e e e e")]
    bench = decontam.Benchmark(spark.createDataFrame(items, "item_id long, text string"))
    got = decontam.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), bench, shard_words=150)
    found = {(r.item_id, r.item_word): r for r in got.collect()}
    w = items[0][1].split()
    for j in range(len(w) - decontam.LEAD + 1):
        best = 0
        for _, t in docs:
            x = t.split()
            for p in range(len(x)):
                n = 0
                while j + n < len(w) and p + n < len(x) and w[j + n] == x[p + n]:
                    n += 1
                best = max(best, n)
        r = found.get(("1", j))
        assert (r.words if r else 0) == (best if best >= decontam.LEAD else 0)
        if r:
            assert docs[r.doc_id][1].split()[r.doc_word : r.doc_word + r.words] == w[j : j + r.words]


def test_no_benchmark_and_no_documents(spark, awkward, empty):
    none = decontam.Benchmark(spark.createDataFrame([], "item_id long, text string"))
    assert decontam.decontaminate(awkward, none).count() == awkward.count()
    assert decontam.decontaminate(empty, none).count() == 0


def test_a_long_item_is_kept_once():
    """An item of 50,000 words: its suffixes are places, not copies, and all of them are found."""
    words = [b"w%d" % (i * 7919 % 60_013) for i in range(50_000)]
    tracemalloc.start()
    searcher = decontam.Suffixes([("long", words)], 13, 4)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    shard = [words[1000:41_000], [b"other"] * 50, words[:300]]
    ids = decontam._joined(searcher, shard, sum(map(len, shard)) + 3)
    start = time.monotonic()
    places, longest = searcher.search(ids)
    assert time.monotonic() - start < 30
    best = {word: n for _, word, n, _ in longest}
    assert best[1000] == 40_000 and best[40_000] == 1000 and best[0] == 300
    hit = {int(p) for _, at in places for p in at}
    assert hit >= set(range(40_000 - 12))


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    n = min(4, len(w))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("n_segments", [2, 3, 4, 5])
def test_links_lose_no_pair(spark, n_segments):
    rng = random.Random(n_segments)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 6)):
                q ^= 1 << b
            prints.add(q)
    values = [signed(p) for p in prints]
    got = simhash.links(spark.createDataFrame([(v,) for v in values], "print long"), 4, n_segments).collect()
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def classes(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(7)
    chain = list(range(40))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(50, i) for i in range(51, 90)] + [(95, 95)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for node, root in enumerate(classes(160, edges)):
        assert got.get(node, node) == root


def test_near_duplicates_match_brute_force(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    prints = [plain_print(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = classes(len(rows), edges)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    got = simhash.near_duplicates(awkward)
    found = sorted(str((r.doc_id, r.print, r.component_id)) for r in got.collect())
    assert found == sorted(str((d, signed(p), least[r])) for (d, _), p, r in zip(rows, prints, roots, strict=True))
    kept = simhash.dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(least[r]) for r in set(roots))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.dedup(empty).count() == 0


def test_hexadecimal(spark):
    row = spark.createDataFrame([(-1, 10)], "a long, b long").select(simhash.hexadecimal("a"), simhash.hexadecimal("b")).first()
    assert tuple(row) == ("f" * 16, "000000000000000a")
