"""Token counts of whole texts, by a published byte-level tokenizer, without moving pre-tokens.

A text's pre-tokens are encoded one by one, so a text has as many tokens as
its pre-tokens together.  Lengths of frequent pre-tokens are broadcast; a
worker encodes the others once and keeps them in a cache of its own.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: The broadcast table's entries and the pre-token length up to which anything is kept: 64 x 32,768 characters at most.
FREQUENT = 32_768
LONGEST_KEPT = 64
#: Texts, and characters of each, that are read to find the frequent pre-tokens.  They decide only what is looked up first.
SAMPLE_TEXTS = 512
SAMPLE_CHARS = 8_192
#: Pre-tokens a worker's cache holds before it starts anew.
CACHED = 1 << 18
#: Characters of a text that are split at a time; see :func:`slices`.
SLICE_CHARS = 1 << 16


def tokenizer(definition: str):
    """The tokenizer of a definition's text; only byte-level ones, whose pre-tokens are encoded alone, are taken."""
    from tokenizers import Tokenizer

    parts = json.loads(definition)
    splitter = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space"):
        raise ValueError("only byte-level tokenizers without normaliser and prefix space can be counted by pre-tokens")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
        raise ValueError("added tokens that take their surroundings can't be counted by pre-tokens")
    return Tokenizer.from_str(definition)


def slices(text: str, chars: int = SLICE_CHARS) -> Iterator[str]:
    """The text in pieces of about ``chars``, cut before a space or line feed that follows an ASCII letter or digit.

    No pre-token and no added token reaches over such a place, since white
    space only begins one that other characters follow.
    """
    start = 0
    while len(text) - start > chars:
        at = start + chars
        while at < len(text) and not (text[at] in " \n" and text[at - 1].isascii() and text[at - 1].isalnum()):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]


@lru_cache(maxsize=1)
def newer_letters() -> str:
    """A character class of letters and digits that the pattern library knows and older Unicode tables do not.

    Tokenizers split texts with tables of their own age, so texts with such
    characters are left to the tokenizer's own splitter.
    """
    import regex

    named = regex.compile(r"[\p{L}\p{N}]").match
    found = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and named(chr(c))]
    edges = [i for i, c in enumerate(found) if i == 0 or c != found[i - 1] + 1]
    runs = [(found[a], found[b - 1]) for a, b in zip(edges, [*edges[1:], len(found)], strict=True)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Lengths(dict):
    """Tokens of a pre-token: the broadcast table, then this worker's cache, then the tokenizer itself."""

    def __init__(self, frequent: dict[str, int], definition: str, pattern: str, newer: str) -> None:
        import regex

        super().__init__(frequent)
        whole = tokenizer(definition)
        self.encode, self.own_split = whole.encode, whole.pre_tokenizer.pre_tokenize_str
        self.cache: dict[str, int] = {}
        self.by_pattern = regex.compile(pattern).findall
        self.newer = regex.compile(f"[{newer}]").search if newer else None
        added = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def __missing__(self, piece: str) -> int:
        known = self.cache.get(piece)
        if known is None:
            known = len(self.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= LONGEST_KEPT:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = known
        return known

    def split(self, text: str) -> list[str]:
        if self.newer is None or text.isascii() or not self.newer(text):
            return self.by_pattern(text)
        return [text[a:b] for _, (a, b) in self.own_split(text)]

    def count(self, text: str) -> int:
        total = 0
        for part in slices(text):
            stretches = [part]
            if self.added is not None and self.added.search(part):
                stretches = self.added.split(part)
                total += len(stretches) - 1
            for stretch in stretches:
                total += sum(map(self.__getitem__, self.split(stretch)))
        return total


def frequent_lengths(texts: DataFrame, text: str, definition: str, pattern: str) -> dict[str, int]:
    """Lengths of the pre-tokens that are most frequent in at most ``SAMPLE_TEXTS`` texts of the first partitions.

    The sample is bounded by its texts and their characters, whatever the
    table's size.
    """
    rows = texts.select(F.substring(F.coalesce(F.col(text).cast("string"), F.lit("")), 1, SAMPLE_CHARS).alias("t")).limit(SAMPLE_TEXTS).collect()
    lengths = Lengths({}, definition, pattern, newer_letters())
    seen: Counter[str] = Counter()
    for row in rows:
        seen.update(p for p in lengths.split(row["t"]) if len(p) <= LONGEST_KEPT)
    return {piece: lengths[piece] for piece, _ in seen.most_common(FREQUENT)}


def token_count(texts: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Number of tokens of each whole text as a long column of ``texts``; NULL and empty texts have none.

    ``vocabulary`` is a tokenizer's file on the driver (by default the public
    byte-level one); its text is broadcast, so executors need no file.
    ``pattern`` is its pre-tokens' pattern.  Counts are those of the library's
    own encoding without begin and end tokens; added tokens inside texts count
    as one, as is its default.  Texts of any length are read in slices, and
    repeated rows are counted like any other.
    """
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    pattern = pattern or public_tokenizers.PATTERN
    tokenizer(definition)
    context = texts.sparkSession.sparkContext
    # bounded: FREQUENT entries of LONGEST_KEPT characters, and the vocabulary's own file
    shared = context.broadcast((frequent_lengths(texts, text, definition, pattern), definition, pattern, newer_letters()))

    @pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = Lengths(*shared.value)
        for batch in batches:
            yield pd.Series([lengths.count(t) for t in batch], dtype="int64")

    return counted(F.coalesce(F.col(text).cast("string"), F.lit("")))
