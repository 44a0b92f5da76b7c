from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shoalwise.llm import katz, mixing, topk
from tests.llm.conftest import prose


def tokens(text):
    return [*(text or "").encode().lower().split(), katz.END]


def plain_katz(rows, held):
    ones, pairs, contexts = Counter(), Counter(), Counter()
    for (_, text), out in zip(rows, held, strict=True):
        if not out:
            w = tokens(text)
            ones.update(w)
            pairs.update(zip([katz.BEGIN, *w], w, strict=False))
            contexts.update([katz.BEGIN, *w[:-1]])
    n, v = sum(ones.values()), len(ones)
    times = lambda c: [Counter(c.values())[r] for r in range(1, katz.LARGEST + 2)]
    single, double = katz.discounts(times(ones)), katz.discounts(times(pairs))
    off = lambda c, d: c * d[c] if c <= katz.LARGEST else c - katz.LEFT
    alone = {w: off(c, single) / n for w, c in ones.items()}
    unknown = 1 - sum(alone.values()) if n else 1.0
    seen, lower = defaultdict(float), defaultdict(float)
    for (a, b), c in pairs.items():
        seen[a] += off(c, double) / contexts[a]
        lower[a] += alone[b]
    weight = {a: (1 - seen[a]) / (1 - lower[a]) for a in seen}

    def p(a, b):
        if pairs[a, b]:
            return off(pairs[a, b], double) / contexts[a]
        return weight.get(a, 1.0) * alone.get(b, unknown)

    out = []
    for (i, text), h in zip(rows, held, strict=True):
        w = tokens(text)
        base = sum(math.log10((ones[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w)
        score = sum(math.log10(p(a, b)) for a, b in zip([katz.BEGIN, *w], w, strict=False))
        out.append((str(i), h, len(w), sum(ones[t] > 0 for t in w), n, round(base, 6), round(score, 6)))
    return out, p, alone, weight


def crc(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


@pytest.mark.parametrize(("pack_tokens", "bucket_keys"), [(1 << 20, 1 << 21), (300, 700)])
def test_katz_matches_brute_force(spark, awkward, pack_tokens, bucket_keys):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    want, p, alone, weight = plain_katz(rows, [crc(i, 5) == 1 for i, _ in rows])
    got = katz.score_documents(awkward, pack_tokens=pack_tokens, bucket_keys=bucket_keys).collect()
    found = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert len(found) == len(want)
    for a, b in zip(sorted(found), sorted(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-6 and abs(a[6] - b[6]) < 2e-5
    unknown = 1 - sum(alone.values())
    for a in weight:  # every context's probabilities and the unknown word's sum to 1
        assert abs(sum(p(a, b) for b in alone) + weight[a] * unknown - 1) < 1e-9


def plain_katz_of_order(rows, held, order):
    """(id, score) by runs in dictionaries and one recursion a token."""
    runs = [Counter() for _ in range(order + 1)]
    follow = [defaultdict(set) for _ in range(order + 1)]
    visits = [Counter() for _ in range(order + 1)]
    past = lambda w, t, k: tuple([katz.BEGIN, *w][max(t + 2 - k, 0) : t + 1])
    for (_, text), out in zip(rows, held, strict=True):
        w = [] if out else tokens(text)
        for t, word in enumerate(w):
            runs[1][(word,)] += 1
            for k in range(2, order + 1):
                runs[k][*past(w, t, k), word] += 1
                follow[k][past(w, t, k)].add(word)
                visits[k][past(w, t, k)] += 1
    factors = [None, *[katz.discounts([Counter(c.values())[r] for r in range(1, katz.LARGEST + 2)]) for c in runs[1:]]]
    off = lambda k, c: c * factors[k][c] if c <= katz.LARGEST else c - katz.LEFT
    n = sum(runs[1].values())
    unknown = 1 - sum(off(1, c) for c in runs[1].values()) / n

    def level(k, context, word):
        """Probability by runs of ``k`` words; the beginning is one word, whatever the level."""
        if k == 1:
            return off(1, runs[1][word,]) / n if runs[1][word,] else unknown
        shorter = context[1:] if len(context) == k - 1 else context
        if runs[k][*context, word]:
            return off(k, runs[k][*context, word]) / visits[k][context]
        if not visits[k][context]:
            return level(k - 1, shorter, word)
        left = 1 - sum(off(k, runs[k][*context, o]) / visits[k][context] for o in follow[k][context])
        free = 1 - sum(level(k - 1, shorter, o) for o in follow[k][context])
        return left / free * level(k - 1, shorter, word)

    out = []
    for i, text in rows:
        w = tokens(text)
        out.append((str(i), sum(math.log10(level(order, past(w, t, order), word)) for t, word in enumerate(w))))
    return out, level, runs, unknown


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_of_any_order_against_recursion(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a b c d " * 50), (103, "a b c d " * 50), (104, "zz a b zz c")]
    held = [crc(i, 5) == 1 for i, _ in rows]
    want, level, runs, unknown = plain_katz_of_order(rows, held, order)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = katz.score_documents(docs, pack_tokens=200, bucket_keys=100, order=order).collect()
    found = {str(r.doc_id): r.score for r in got}
    assert len(found) == len(want)
    for i, score in want:
        assert found[i] == pytest.approx(score, abs=1e-6)
    if order > 1:  # the probabilities of a context sum to 1
        context = ("a", "b", "c")[-order + 1 :]
        context = tuple(c.encode() for c in context)
        whole = sum(level(order, context, w) for (w,) in runs[1]) + level(order, context, b"never seen")
        assert whole == pytest.approx(1, abs=1e-9)


def test_katz_without_training_or_documents(spark, empty):
    assert katz.score_documents(empty).count() == 0
    only = next(i for i in range(100) if crc(i, 5) == 1)
    r = katz.score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def plain_search(docs, queries, k):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    bags = [Counter(words(t)) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    mean, n = sum(sizes) / max(len(docs), 1), len(docs)
    df = Counter(w for b in bags for w in b)
    out = []
    for q, text in set(queries):
        scored = []
        for (d, _), bag, size in zip(docs, bags, sizes, strict=True):
            s = sum(
                math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * (topk.K1 + 1) / (bag[w] + topk.K1 * (1 - topk.B + topk.B * size / mean))
                for w in dict.fromkeys(words(text))
                if w in bag
            )
            if s > 0:
                scored.append((-round(s, topk.DECIMALS), d is None, d or 0))
        out += [(str(q), r, None if none else d, round(-s, 6)) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_words", [1 << 22, 200])
@pytest.mark.parametrize("k", [1, 10])
def test_search_matches_brute_force(spark, awkward, shard_words, k):
    more = spark.createDataFrame([(1000 + i, prose(i % 90, 30 + i % 7)) for i in range(150)], "doc_id long, text string")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    queries = docs.where("doc_id % 3 = 0 OR doc_id IS NULL").union(docs.where("doc_id = 3"))
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = topk.search(docs, queries, k=k, shard_words=shard_words, query_block=7).collect()
    found = sorted(((str(r.query_id), r["rank"], r.doc_id, round(r.score, 6)) for r in got), key=str)
    want = plain_search(pairs(docs), [(i, t or "") for i, t in pairs(queries)], k)
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(found, want, strict=True))


def test_search_prunes_without_losing(spark):
    """A few terms against many blocks: blocks under the threshold are never scored."""
    docs = [(i, prose(i, 12) + (" needle" * (i % 200 == 0) + " thread" * (i % 500 == 0))) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    row = topk.build_index(frame).where("shard IS NOT NULL").toPandas().iloc[0]
    shard = topk.Shard(row, 12.0)
    words = [b"needle", b"thread", b"bada"]
    at = shard.weigh(words, topk.np.array([6.0, 7.0, 0.2]))
    scored = []
    plain = shard._scores  # what it is asked to score
    shard._scores = lambda chosen, *rest: (scored.append(int(chosen.sum())), plain(chosen, *rest))[1]
    hits, _ = shard.search(at, 3)
    assert set(shard.ids[hits]) == {0, 1000, 2000} and sum(scored) < shard.n_blocks / 2


def test_search_of_empty_tables(spark, awkward, empty):
    assert topk.search(empty, awkward.where("doc_id = 3")).count() == 0
    assert topk.search(awkward, empty).count() == 0


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: 2 * sizes[s] for s in names}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(cap[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > cap[s]}
        if not over:
            return {s: cap[s] if s in capped else level * w[s] for s in names}
        capped |= over


@pytest.mark.parametrize("block_words", [7, 512])
def test_mix_meets_its_targets(spark, awkward, block_words):
    got = mixing.mix_documents(awkward, block_words=block_words).collect()
    rows = awkward.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(str((r.doc_id, r.size)) for r in got) == sorted(str((r.doc_id, size(r.text))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    targets = plain_targets(sizes)
    by_target = defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target[r.target, r.source_size][0] += r.taken
    assert {k for k in by_target} == {(targets[s], n) for s, n in sizes.items()}
    for (target, n), (taken, *_) in by_target.items():
        same = sum(1 for s in sizes if (targets[s], sizes[s]) == (target, n))
        assert abs(taken - same * target) <= same
    again = mixing.mix_documents(awkward.repartition(7), block_words=block_words).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_has_low_discrepancy(spark):
    quotas = spark.createDataFrame([(0, 300), (1, 100), (2, 0), (3, 200), (4, 1)], "number long, blocks long")
    rows = mixing.schedule(quotas).orderBy("slot").collect()
    assert len({r.slot for r in rows}) == len(rows) == 601
    for number, blocks in ((0, 300), (1, 100), (3, 200), (4, 1)):
        assert [r.block for r in rows if r.number == number] == list(range(blocks))
        for at in range(0, 601, 50):
            part = sum(r.number == number for r in rows[:at])
            assert abs(part - at * blocks / 601) <= 5


def test_pieces_make_up_the_stream(spark, awkward):
    mix = mixing.Mix(awkward, block_words=20)
    pieces = mix.pieces.collect()
    words = {r.number: r.words for r in mix.sources.select("number", "words").collect()}
    by_slot = defaultdict(int)
    for p in pieces:
        by_slot[p.number, p.block] += p.words
    for number, n in words.items():
        blocks = sorted(b for s, b in by_slot if s == number)
        assert blocks == list(range(len(blocks)))
        assert sum(by_slot[number, b] for b in blocks) == n
        assert all(by_slot[number, b] == 20 for b in blocks[:-1])


def test_mix_of_nothing(spark, empty):
    assert mixing.mix_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, " ", None), (2, None, "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_documents(blank).collect()] == [(0, 0.0, 0)] * 2


def test_source_targets_with_many_sources(spark):
    sizes = {f"s{i:03d}": (i * 37) % 101 for i in range(120)} | {None: 50}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r.source: r.target for r in mixing.source_targets(frame.withColumn("x", F.lit(1)).drop("x")).collect()}
    want = plain_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_a_shard_holds_its_postings_in_little_memory():
    """A posting takes 4 bytes for its document, 8 each for its part and impact, and its share of a block's 20."""
    import tracemalloc
    from types import SimpleNamespace

    np, docs, words = topk.np, 4000, 100
    postings = np.tile(np.arange(docs, dtype="<i4"), words)
    row = SimpleNamespace(
        ids=list(range(docs)), lengths=np.full(docs, words), vocabulary=b" ".join(b"w%d" % i for i in range(words)),
        postings=topk._pack(postings), counts=topk._pack(np.ones(len(postings), "<i4")),
        starts=topk._pack(np.arange(words + 1, dtype="<i8") * docs),
    )
    tracemalloc.start()
    shard = topk.Shard(row, float(words))
    for _ in range(2):
        shard.weigh([b"w1", b"w2"], np.array([1.0, 2.0]))
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 24 * len(postings) and most < 36 * len(postings)


@pytest.mark.parametrize("k", [3, 1000])
def test_a_shard_adds_frequent_words_by_table_and_stays_exact(monkeypatch, k):
    """Most postings of long queries are in the tables of frequent words; hits are those of a dense product."""
    from types import SimpleNamespace

    np, docs, words = topk.np, 700, 60
    rng = np.random.default_rng(5)
    tf = (rng.random((docs, words)) < np.linspace(0.01, 0.9, words)) * rng.integers(1, 4, (docs, words))
    tf[100:150], tf[200] = tf[100], 0  # copies, and a document without words
    lengths, (word, doc) = tf.sum(axis=1), np.nonzero(tf.T)
    ids = [None if i == 120 else int(i) for i in rng.permutation(docs)]
    row = SimpleNamespace(
        ids=ids, lengths=lengths, vocabulary=b" ".join(b"w%d" % i for i in range(words)), postings=topk._pack(doc.astype("<i4")),
        counts=topk._pack(tf.T[word, doc].astype("<i4")), starts=topk._pack(np.searchsorted(word, np.arange(words + 1)).astype("<i8")),
    )
    monkeypatch.setattr(topk, "AGAIN", 100)
    shard, idf = topk.Shard(row, lengths.mean()), np.linspace(5, 0.1, words)
    at = shard.weigh([b"w%d" % i for i in range(words)], idf)
    assert at.tolist() == list(range(words))
    queries = [np.flatnonzero(rng.random(words) < share) for share in np.linspace(0, 1, 30)]
    part = tf * (topk.K1 + 1) / (topk.K1 * (1 - topk.B + topk.B * lengths / lengths.mean())[:, None] + tf)
    want, floors = [], np.zeros(len(queries))
    for q, terms in enumerate(queries):
        scores = np.round(part[:, terms] @ idf[terms], topk.DECIMALS)
        best = sorted(np.flatnonzero(scores > 0), key=lambda d: (-scores[d], ids[d] is None, ids[d] or 0))[:k]
        want += [(q, int(d), round(float(scores[d]), 6)) for d in best]
        floors[q] = scores[best[-1]] if q % 2 and len(best) == k else 0
    got = [(int(q), int(d), round(float(s), 6)) for q, d, s in zip(*shard.search_all(queries, k, floors), strict=True)]
    assert got == want
    asked = np.concatenate(queries)
    assert 10 * shard.sizes[asked].sum() < (tf > 0).sum(axis=0)[asked].sum()


@pytest.mark.parametrize("size", [1, 9, 1 << 20])
def test_words_of_texts_are_those_of_each_text(size):
    """Texts that are cut into words together keep their own words, however many bytes are taken at once."""
    from shoalwise.llm.common import plain_words, words_of_texts

    texts = [b"", b" ", "Ää b-C 9é".encode(), b"one", b"x\x00y\tz", b"  two  THREE ", b"", "日本 語".encode(), b"-"] * 3
    got = []
    for low, words, lengths in words_of_texts(texts, size):
        assert low == len(got)
        ends = topk.np.cumsum(lengths).tolist()
        got += [words.slice(end - n, n).to_pylist() for end, n in zip(ends, lengths.tolist(), strict=True)]
        assert ends[-1] == len(words)
    assert got == [plain_words(t) for t in texts]
    assert list(words_of_texts([], size)) == []


def test_a_block_of_queries_costs_a_shard_little(monkeypatch):
    """Words are looked up in the block's and not in all of the shard's; a query's products with a group are made once."""
    from types import SimpleNamespace

    np, docs, words = topk.np, 1500, 80
    tf = np.random.default_rng(3).random((docs, words)) < np.linspace(0.01, 0.9, words)
    word, doc = np.nonzero(tf.T)
    row = SimpleNamespace(
        ids=list(range(docs)), lengths=tf.sum(axis=1), vocabulary=b" ".join(b"w%d" % i for i in range(words)),
        postings=topk._pack(doc.astype("<i4")), counts=topk._pack(np.ones(len(doc), "<i4")),
        starts=topk._pack(np.searchsorted(word, np.arange(words + 1)).astype("<i8")),
    )
    shard = topk.Shard(row, 30.0)
    tables, products = [], []
    plain = topk.pc.index_in

    def index_in(values, value_set):
        tables.append(len(value_set))
        return plain(values, value_set=value_set)

    class Counted(np.ndarray):
        def __rmatmul__(self, other):
            products.append(len(other))
            return other @ self.view(np.ndarray)

    monkeypatch.setattr(topk, "pc", SimpleNamespace(index_in=index_in))
    at = shard.weigh([b"w5", b"unknown", b"w70", b"w1"], np.array([5.0, 9.0, 0.5, 6.0]))
    assert at.tolist() == [5, -1, 70, 1] and tables == [4]
    shard.weigh([b"w%d" % i for i in range(words)], np.linspace(5, 0.1, words))
    shard.groups = [(low, high, columns, table.view(Counted), largest) for low, high, columns, table, largest in shard.groups]
    shard.search_all([np.arange(i, words, 3) for i in range(30)], 5, np.zeros(30))
    assert 0 < sum(products) <= 30 * len(shard.groups)
