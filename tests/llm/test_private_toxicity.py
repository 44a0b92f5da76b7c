from __future__ import annotations

import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoalwise.llm import private, toxicity
from tests.llm.conftest import prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text, kinds=tuple(PLAIN)):
    out = []
    for kind in kinds:
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and private.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("1234567890 .-+()@ab%é\n"), max_size=70))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert private.base_spans(text) == plain_spans(text)


def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if private.luhn(body + d))


def private_texts(n):
    rng = random.Random(3)
    out = []
    for i in range(n):
        a = [
            f"{prose(i, 1).split()[0]}.{rng.randint(1, 99)}@mail{i % 5}.example.com",
            ".".join(str(rng.randint(1, 255)) for _ in range(4)),
            card(rng),
            f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
        ]
        rng.shuffle(a)
        out.append(f"{prose(i, 4)} {a[0]} {prose(i + 1, 3)} {a[1]} or id {rng.randint(10**20, 10**21)} {prose(i, 2)}")
    return out


def test_field_learns_spans_and_leaves_numbers_alone():
    field = private.fit(private_texts(120))
    find = lambda t: [(k, t[a:b]) for k, a, b, _ in private.spans_of(t.encode(), field)]
    assert find("call (578) 555-6437 now") == [("phone", "(578) 555-6437")]
    assert find("+1 (578) 555-6437 4918187128635271") == [("phone", "+1 (578) 555-6437"), ("card", "4918187128635271")][::-1]
    for clean in ("version 1.2.3", "on 2024-01-01 at 12.30", "id 123456789012345678901234", "a b c", "x@y", "0641917ea4e9feb9cda83477b57ac2654884f485"):
        assert find(clean) == [], clean


def test_copies_of_a_text_do_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(private_texts(60))], "doc_id long, text string")
    lowest = docs.orderBy(F.xxhash64("text")).limit(1)
    copies = lowest.crossJoin(spark.range(100).select(F.col("id").alias("copy"))).select("doc_id", "text")
    field = private.train(docs, most_docs=40, epochs=5)
    hot = private.train(docs.union(copies).repartition(3), most_docs=40, epochs=5)
    assert field.weights.any() and np.array_equal(field.weights, hot.weights)


def test_a_long_text_does_not_fill_the_zones():
    long = " ".join(f"name{i}@mail{i}.example.org" for i in range(900))
    texts = [long, *private_texts(200)]
    got = private.examples(texts, 300)
    own = [x for x in got[:300] if "example.org" in x[0]]
    assert len(own) <= 20
    for part in (got[:300], got[300:]):
        assert {k for *_, true in part for k, _, _ in true} >= {"card", "phone"}
    assert {k for *_, true in got for k, _, _ in true} == set(private.KINDS)
    # a kind that is rare still has all it can give, and a single document may fill what others leave
    rare = private.examples([f"{long} 10.20.30.40", "no zone"], 300)
    assert len(rare) >= 300 and any(true and true[0][0] == "ip" for *_, true in rare[:300])


def test_best_segmentation_is_the_best_of_all():
    rng = np.random.default_rng(1)
    field = private.Field(rng.normal(0, 1.5, (4, private.N_FEATURES)), 5)
    for text in ("ab12.cd@ef.gh", "+1 (23) 555-6", "1.2.3.4.5.6"):
        n, segments = private.candidates(text, 0, len(text), 5)
        scored = []
        for i, j, a, b in segments:
            on = private.segment_features(text, a, b, a == 0 and b == len(text))
            scored += [(i, j, field.weights[k, on].sum() - private.MARGIN) for k in range(4)]

        def best(at):
            return 0.0 if at >= n else max([best(at + 1), *(s + best(j) for i, j, s in scored if i == at)])  # noqa: B023

        total = 0.0
        for kind, a, b in field.spans(text, 0, len(text)):
            on = private.segment_features(text, a, b, a == 0 and b == len(text))
            total += field.weights[private.KINDS.index(kind), on].sum() - private.MARGIN
        assert abs(total - best(0)) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.text(st.sampled_from("1234567890.-+()@abZ/%_ "), min_size=30, max_size=200))
def test_dropping_segments_without_hope_changes_no_segmentation(seed, text):
    field = private.Field(np.random.default_rng(seed).normal(-0.4, 1.0, (4, private.N_FEATURES)), 24)
    for a, b in private.zones(text):
        plain = {s for s in private.candidates(text, a, b, 24)[1]}
        n, kept = field.hopeful(text, a, b, private.MARGIN)
        assert n == private.candidates(text, a, b, 24)[0] and plain >= set(kept)
        for i, j, s, e in plain - set(kept):
            on = private.segment_features(text, s, e, s == a and e == b)
            assert (field.weights[:, on].sum(axis=1) - private.MARGIN <= 0).all(), (i, j)


def test_extracts_for_the_fit_are_bounded():
    run = "x" * 120_000
    assert private.around(f"one two {run} a@b.cc three four five") == f"{'x' * 98} a@b.cc three"
    assert private.around("no place") == "" == private.around("")
    assert private.around("1 two me@here.org or +1 (578) 555-6437 and so on") == "two me@here.org or +1 (578) 555-6437 and"
    many = " ".join(f"n{i}@m.example.org and more words here" for i in range(5000))
    cut = private.around(many)
    assert private.SAMPLE_CHARS - 500 < len(cut) <= private.SAMPLE_CHARS + len(cut.split("\n"))
    assert all(line in many for line in cut.split("\n"))


def test_long_runs_cost_no_more_than_their_length(spark):
    """A run of 120,000 characters, one of base64 and a dump of addresses, each beside an address."""
    rng = random.Random(8)
    base64 = "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(300_000))
    dump = " ".join(f"n{i}@m{i % 7}.example.org" for i in range(30_000))
    texts = [f"{'x' * 120_000} a.b@c.example.org", f"{base64} a.b@c.example.org", dump, *private_texts(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.monotonic()
    field = private.train(docs, epochs=5)
    assert field.weights.any()
    got = {r.doc_id: r.got for r in docs.select("doc_id", private.find_private("text", field).alias("got")).collect()}
    assert time.monotonic() - start < 60
    for i, text in enumerate(texts):
        # the plain address pattern takes the square of a run, so its find is stated
        mails = [("email", len(text) - 17, len(text))] if i < 2 else plain_spans(text)
        others = plain_spans(text[:-18], [k for k in PLAIN if k != "email"]) if i == 1 else []
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == mails + others


def test_redaction_of_awkward_documents(spark, awkward, empty):
    field = private.train(awkward.limit(0))
    assert not field.weights.any()
    mail = "write to a.b@c.example.org, 1.2.3.4 or +1 (578) 555-6437 4918187128635271"
    docs = awkward.unionByName(spark.createDataFrame([(500, mail)], "doc_id long, text string"), allowMissingColumns=True)
    rows = docs.select("doc_id", "text", private.redacted("text", field).alias("new"), private.find_private("text", field).alias("got")).collect()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.got] == plain_spans(r.text or "")
        if r.doc_id != 500:
            assert r.new == r.text
    assert next(r.new for r in rows if r.doc_id == 500) == "write to [email], [ip] or +1 (578) 555-6437 4918187128635271"
    assert empty.select(private.redacted("text", field)).count() == 0


def toxic_docs(spark, n):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = prose(i, rng.randint(20, 60)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("grolmox", "grolvid", "zug")))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_toxicity_held_out_accuracy(spark):
    docs, labels, rows = toxic_docs(spark, 1200)
    model = toxicity.train(docs, labels)
    assert 0.1 < model.prior < 0.3
    scores = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score("text", model).alias("s")).collect()}
    right = sum((scores[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i, _ in rows)
    assert right / len(rows) > 0.97
    again = toxicity.train(docs.repartition(5), labels)
    assert np.allclose(again.weights, model.weights) and again.bias == model.bias


def test_toxicity_of_awkward_documents(spark, awkward, empty):
    labels = spark.createDataFrame([(3, 1, "x"), (3, 0, "x"), (None, 1, "x"), (4, None, "x"), (900, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(awkward, labels)
    assert toxicity.keep_clean(awkward, model).columns == awkward.columns
    scores = [r[0] for r in awkward.select(toxicity.score("text", model)).collect()]
    assert len(scores) == awkward.count() and all(0 <= s <= 1 for s in scores)
    nothing = toxicity.train(empty, labels.limit(0))
    assert nothing.prior == 0 and toxicity.keep_clean(awkward, nothing).count() == awkward.count()
    assert toxicity.keep_clean(empty, model).count() == 0


def plain_risk(w, rows, n, prior, decay):
    """The risk that a step lowers and its slopes, from their definition over one example at a time.

    Also whether the risk of the unlabelled as negatives, less the positives' part of it, is below 0.
    """
    *weights, bias, length = w
    seen = []
    for on, size in rows:
        z = bias + length * np.log1p(size) + sum(weights[k] for k in on)
        step = np.array([float(on.count(k)) for k in range(len(weights))] + [1.0, np.log1p(size)])
        up = 1 / (1 + np.exp(-z))
        seen.append((np.log1p(np.exp(-z)), (up - 1) * step, np.log1p(np.exp(z)), up * step))
    mean = lambda part, i: sum(x[i] for x in part) / len(part)
    rest, slope = (mean(seen[n:], i) - prior * mean(seen[:n], i) for i in (2, 3))
    if rest >= 0:
        risk, grad = prior * mean(seen[:n], 0) + rest, prior * mean(seen[:n], 1) + slope
    else:
        risk, grad = -rest, -slope
    held = np.append(weights, [0, 0])
    return risk + decay * (held @ held) / 2, grad + decay * held, rest < 0


def test_fit_lowers_the_risk_as_defined():
    """Adam on the plain risk's slopes, which small differences confirm, in both of its branches."""
    rng = random.Random(6)
    below = set()
    for prior in (0.2, 0.95):
        positive = [np.array(sorted({rng.randrange(3), rng.randrange(3), 10 + rng.randrange(40)})) for _ in range(30)]
        unlabelled = [np.array(sorted(10 + rng.randrange(40) for _ in range(rng.randint(1, 4)))) for _ in range(90)]
        unlabelled = [np.unique(np.append(u, 1)) if i % 9 == 0 else np.unique(u) for i, u in enumerate(unlabelled)]
        kept = toxicity.telling(positive, unlabelled).tolist()
        assert {0, 2} <= set(kept) <= {0, 1, 2}
        rows = [([kept.index(k) for k in r.tolist() if k in kept], len(r)) for r in positive + unlabelled]
        w = np.append(np.zeros(len(kept)), [np.log(prior / (1 - prior)), 0.0])
        first, second = np.zeros_like(w), np.zeros_like(w)
        steps = 40
        for t in range(1, steps + 1):
            _, grad, branch = plain_risk(w, rows, 30, prior, 1e-3)
            below.add(branch)
            if t % 10 == 1:
                sides = [[plain_risk(w + h * e, rows, 30, prior, 1e-3)[0] for h in (1e-5, -1e-5)] for e in np.eye(len(w))]
                assert np.allclose(grad, [(a - b) / 2e-5 for a, b in sides], atol=1e-7)
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        model = toxicity.fit(positive, unlabelled, prior, steps=steps)
        assert np.allclose([*model.weights[kept], model.bias, model.length], w, atol=1e-6)
        assert np.count_nonzero(model.weights) == len(kept)
    assert below == {True, False}
