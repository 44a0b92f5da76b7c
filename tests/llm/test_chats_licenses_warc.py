from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoalwise.llm import chats, licenses, warc
from shoalwise.llm.common import plain_words
from tests.llm.conftest import texts

said = st.text(st.sampled_from("<|\\>im_stardep a\né\U0001f600"), max_size=40)


@given(said)
def test_escapes_are_undone_and_hide_marks(text):
    assert chats.unescape(chats.escape(text)) == text
    assert "<|" not in chats.escape(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", ""]), said), max_size=6))
def test_rendering_and_mask_round_trip(turns):
    formatted, spans = chats.render(turns, frozenset({"assistant"}))
    ids = chats.tokens_of(formatted, chats.VOCABULARY)
    _, table, sizes = chats.encoder(chats.VOCABULARY)
    assert b"".join(table[i] for i in ids).decode() == formatted
    assert chats.read_turns(formatted) == turns
    marks = chats.mask(np.cumsum(sizes[ids]), spans)
    wanted = [t for r, t in turns if r == "assistant" and t]
    assert chats.masked_texts(ids, marks, chats.VOCABULARY) == wanted


def test_chats_with_nulls_ties_and_long_turns(spark):
    long = "b" * 60_000 + " " * 60_000
    rows = [
        (1, 1, "assistant", "B"), (1, 0, "user", None), (1, 1, "assistant", "A"), (1, None, None, "first"),
        (None, 0, "assistant", "lost"), (2, 0, "assistant", long), (2, 1, "assistant", long), (3, 0, "user", ""),
        (1, 1, "assistant", "B"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    formatted = chats.format_chats(turns, part_chars=50_000)
    for got in (chats.read_back(formatted, in_order=True), chats.read_back(formatted.repartition(4))):
        found = {r.conv_id: r for r in got.collect()}
        order = [("", "first"), ("user", ""), ("assistant", "A"), ("assistant", "B"), ("assistant", "B")]
        assert found[1].n_turns == 5 and found[1].loss_chars == 3
        assert found[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
        assert found[1].loss_sha256 == hashlib.sha256(b"ABB").hexdigest()
        assert found[None].loss_chars == 4
        assert found[2].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()
        assert found[3].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chats.read_back(chats.format_chats(turns.limit(0))).count() == 0


def plain_license(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (i, label)
        for phrase, label in licenses.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted({x for _, x in places})


def test_license_scan_matches_brute_force_and_finds_edits(spark, awkward, empty):
    extra = [
        "Released under the MIT License.", "cc by CC-BY cc by by", "relaesed under the MIT licence", "Licenced under the Apache Licence, Version 2.0",
        "the GNU General Publik License applies: licensed under the gnu general publik license", "mit", "É cc by É",
    ]
    docs = awkward.unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True
    )
    got = licenses.license_scan(docs).collect()
    want = sorted((str(r.doc_id), plain_license(r.text)) for r in docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[102].n_base == 0 and by_id[102].labels == ["mit"] and 0.8 < by_id[102].score < 1
    assert by_id[103].labels == ["apache"] and "gpl" in by_id[104].labels
    assert by_id[105].labels == [] and by_id[105].score == 0
    m = next(x for x in by_id[102].matches)
    assert extra[2][m.start : m.end] == "relaesed under the MIT licence" and m.edits > 0
    assert licenses.license_scan(empty).count() == 0


def test_many_notices_in_one_text_cost_no_more_than_their_number():
    text = "some words then the mit license and " * 30_000
    start = time.monotonic()
    got = licenses._scan(text.encode(), [(b" mit license ", "mit")], [])
    assert time.monotonic() - start < 20
    assert (got["n_base"], got["first_word"], got["last_word"]) == (30_000, 4, 7 * 29_999 + 4)
    assert got["matches"][-1][1:3] == (7 * 29_999 + 4, 7 * 29_999 + 6)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10_000))
def test_seeds_lose_no_fuzzy_match(seed):
    import regex

    rng = random.Random(seed)
    notice = "released under the mit license"
    text = list("see it " + notice + " and more")
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(text))
        text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
    plain = b" ".join(plain_words("".join(text).encode()))
    compiled = licenses.patterns(((notice, "mit"),), licenses.EDIT_RATE)
    edits = compiled[0][2]
    whole = regex.search(rb"(?b)(?<![^ ])(?:" + notice.encode() + rb"){e<=%d}(?![^ ])" % edits, plain)
    assert bool(licenses.fuzzy_matches(plain, compiled)) == bool(whole)


def test_repeated_notices_with_different_edits_are_all_found():
    notice = "released under the mit license"
    compiled = licenses.patterns(((notice, "mit"),), licenses.EDIT_RATE)
    got = licenses.fuzzy_matches(b"released under the mit licanse released under the mit license", compiled)
    assert [m[:4] for m in got] == [(0, 30, "mit", 1), (31, 61, "mit", 0)]
    rng = random.Random(4)
    for _ in range(60):
        want, text = [], ""
        for _ in range(rng.randint(1, 12)):
            text += rng.choice(("", "", "so ", "the code is "))
            line, wrong = list(notice), rng.sample([i for i, c in enumerate(notice) if c != " "], rng.randint(0, 2))
            for i in wrong:
                line[i] = "q"
            want.append((len(text), len(text) + len(notice), "mit", len(wrong)))
            text += "".join(line) + " "
        assert [m[:4] for m in licenses.fuzzy_matches(text.strip().encode(), compiled)] == want


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.org:80/a?b=1#c", "org,example)/a?b=1"),
        ("https://x.y.z:8443", "z,y,x:8443)/"),
        ("no url", "no url"),
        ("http://[bad", "http://[bad"),
        (None, ""),
    ],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


def test_archive_round_trip_and_look_up(spark):
    html = [None, "", "short", "é" * 60, "é" * 60, "é" * 60, *texts()[3:9]]
    rows = [(i, f"http://h{i % 4}.example.org/p\t{i}", h) for i, h in enumerate(html)]
    rows += [(None, None, "é" * 60), (5, "http://h1.example.org/p\t5", "é" * 60), (3, "http://h1.example.org/p\t3", "é" * 60), (50, "x\r\nWARC: y", "tail")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("x"))
    archive = warc.write_archive(pages, file_bytes=2_000, block_lines=3)
    got = warc.read_archive(archive).collect()
    want = []
    for page, url, h in rows:
        payload = (h or "").encode()
        same = [p for p, _, o in rows if (o or "").encode() == payload and p is not None]
        first = min(same, default=None)
        later = len(payload) >= 100 and first is not None and page != first
        want.append((str(page), url or "", "revisit" if later else "response", first if later else None, hashlib.sha256(payload).hexdigest()))
    found = [(str(r.page_id), r.url, r.record_type, r.refers_to, r.payload_digest) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h in rows}
    # asking for every page's own URL gives every record once
    own = warc.look_up(archive, pages, exact=True).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in own))) == sorted(map(str, map(tuple, got)))
    assert all(r.asked == r.url for r in own)
    asked = spark.createDataFrame([(rows[7][1],), (rows[3][1],), ("http://none.example.org/",), (None,), (rows[7][1],)], "url string")
    found = warc.look_up(archive, asked).collect()
    assert sorted(str((r.asked, r.page_id)) for r in found) == sorted(str((u, p)) for p, u, _ in rows if u in (rows[7][1], rows[3][1], None))
    assert bytes(next(r.payload for r in found if r.page_id == 3)) == html[3].encode()


def test_look_up_of_one_key_over_many_blocks(spark):
    """A URL with a third of all captures, and spellings of it that share its key."""
    rows = [(i, f"http://www.a.org/x#{i % 5}" if i % 3 else "http://a.org/x", f"page {i}") for i in range(120)]
    rows += [(i, f"http://b{i}.org/", "other") for i in range(120, 180)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    archive = warc.write_archive(pages, block_lines=7)
    exact = warc.look_up(archive, pages, exact=True).collect()
    assert sorted((r.page_id, r.asked) for r in exact) == [(p, u) for p, u, _ in rows]
    wide = warc.look_up(archive, spark.createDataFrame([("https://a.org/x",), ("http://b130.org/#y",)], "url string")).collect()
    assert sorted(r.page_id for r in wide) == [*range(120), 130]


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    assert warc.read_archive(archive).count() == 0
    assert warc.look_up(archive, spark.createDataFrame([("http://a/",)], "url string")).count() == 0
