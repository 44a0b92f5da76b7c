"""License notices in texts: exact phrases, and short notices with a bounded number of edits."""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shoalwise.llm.common import plain_words, text_bytes

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices in lower case without punctuation, and their labels.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution license": "cc-by",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "released into the public domain": "public-domain",
}

#: Edits allowed per character of a notice.
EDIT_RATE = 0.1


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """Cut a notice into edits + 1 pieces: one of them stands unchanged in any text within ``edits``."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def patterns(notices: tuple[tuple[str, str], ...], rate: float) -> list[tuple[str, bytes, int, list, object]]:
    import regex

    out = []
    for notice, label in notices:
        plain = notice.encode()
        edits = int(len(plain) * rate)
        fuzzy = regex.compile(rb"(?b)(?<![^ ])(?:" + regex.escape(plain) + rb"){e<=%d}(?![^ ])" % edits)
        out.append((label, plain, edits, pieces(plain, edits), fuzzy))
    return out


def fuzzy_matches(text: bytes, compiled: list) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, edits, likeness) of notices in a text of words joined by single spaces.

    A notice within e edits holds one of its e + 1 pieces unchanged, at most e
    bytes from that piece's place, so the windows around all pieces hold all
    matches.  Of matches of one notice that meet, the one with fewer edits
    counts, then the first; what is left of a window is searched again, so
    that a better match hides none beside it.
    """
    found = []
    for label, plain, edits, seeds, fuzzy in compiled:
        windows = set()
        for offset, seed in seeds:
            at = text.find(seed)
            while at >= 0:
                a, b = max(0, at - offset - edits - 1), at - offset + len(plain) + edits + 1
                windows.add((a, len(text) if b >= len(text) else text.rfind(b" ", a, b)))
                at = text.find(seed, at + 1)
        best: list[tuple[int, int, int, int, int]] = []
        taken: list[tuple[int, int]] = []

        def look(a: int, b: int) -> None:
            """The best match of a stretch that ends with a word waits for its turn."""
            if b - a >= len(plain) - edits and (m := fuzzy.search(text, a, b)):  # noqa: B023
                heapq.heappush(best, (sum(m.fuzzy_counts), *m.span(), a, b))  # noqa: B023

        for a, b in windows:
            look(a, b)
        while best:
            wrong, start, end, a, b = heapq.heappop(best)
            i = bisect.bisect_right(taken, (start, end))
            met = [t for t in taken[max(0, i - 1) : i + 1] if t[0] < end and t[1] > start]
            if not met:
                taken.insert(i, (start, end))
                found.append((start, end, label, wrong, 1 - wrong / len(plain)))
                met = [(start, end)]
            for s, e in met:
                look(a, s - 1)
                a = max(a, e + 1)
            look(a, b)
    return sorted(found)


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "score double, matches array<struct<label:string,first_word:long,end_word:long,start:long,end:long,edits:int>>"
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _scan(text: bytes, phrases: list[tuple[bytes, str]], compiled: list) -> dict:
    words = plain_words(text)
    spaced = b" " + b" ".join(words) + b" "
    # the word at a place is told by the spaces before it, found once
    spaces = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)
    places, base, matches = [], set(), []
    for phrase, label in phrases:
        at = spaced.find(phrase)
        while at >= 0:
            base.add(label)
            places.append(int(np.searchsorted(spaces, at)))
            matches.append((places[-1], places[-1] + phrase.count(b" ") - 1, label, 0))
            at = spaced.find(phrase, at + 1)
    fuzzy = fuzzy_matches(spaced[1:-1], compiled)
    for a, b, label, wrong, _ in fuzzy:
        first = int(np.searchsorted(spaces, a + 1)) - 1
        matches.append((first, first + spaced[a + 1 : b + 1].strip().count(b" ") + 1, label, wrong))
    spans = []
    if matches:
        where = [m.span() for m in _WORD.finditer(text.lower().decode(errors="replace"))]
        for first, end, label, wrong in sorted(set(matches)):
            spans.append((label, first, end, where[first][0], where[end - 1][1], wrong))
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": sorted(base),
        "labels": sorted(base | {f[2] for f in fuzzy}),
        "score": 1.0 if places else max((f[4] for f in fuzzy), default=0.0),
        "matches": spans,
    }


def notices(
    text: str | Column,
    phrases: dict[str, str] = PHRASES,
    short_notices: dict[str, str] = NOTICES,
    edit_rate: float = EDIT_RATE,
) -> Column:
    """A struct of what a text says about its license.

    n_words, the number, first and last place of exact phrases, their labels,
    all labels, a score (1 for an exact phrase, else one less the edits per
    character of the closest notice, 0 without any), and each match with its
    words and its code points in the text as given.

    Works row by row: NULL and empty texts have no words and score 0, repeated
    rows give equal results, whole texts are read whatever their length.
    """
    phrase_list = [(b" " + k.encode() + b" ", v) for k, v in phrases.items()]
    listed = tuple(short_notices.items())

    @pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = patterns(listed, edit_rate)
        for batch in batches:
            rows = [_scan(bytes(t), phrase_list, compiled) for t in batch]
            frame = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan.asNondeterministic()(text_bytes(text))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document with the fields of :func:`notices`; other columns are ignored."""
    return docs.select(F.col(key).alias("doc_id"), notices(text, **options).alias("found")).select("doc_id", "found.*")
