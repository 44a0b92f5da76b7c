"""Chat formatting with loss masks that are aligned by offsets."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: How the vocabulary's publisher splits texts before merging (a fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A part ends with the first turn that brings it to so many characters.
PART_CHARS = 1 << 22

FORMATTED = (
    "conv_id long, part int, formatted string, token_ids array<int>, loss_mask array<byte>, loss_spans array<long>"
)


def escape(text: str) -> str:
    """Put one backslash more into each ``<\\...\\|``, so that no text holds ``<|``."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer with the three marks as special tokens, and each token's bytes by its id."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    first = max(ranks.values()) + 1
    special = {mark: first + i for i, mark in enumerate((START, SEP, END))}
    table: list[bytes] = [b""] * (first + len(special))
    for token, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
        table[i] = token
    encoding = tiktoken.Encoding("chats", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return encoding, table, np.array([len(t) for t in table], dtype=np.int64)


#: Longest run of one kind of character given to the encoder's splitter in one piece.
_LONG_RUN = re.compile(r"\s{4096,}|[^\s]{4096,}")


def tokens_of(formatted: str, vocabulary: str) -> np.ndarray:
    """Token ids of one rendered part.

    Runs of over 4,096 characters without a change between white space and
    the rest are cut there into pieces of 4,096 first, because the splitter's
    cost grows with the square of such a run.  The bytes stay the same.
    """
    encoding, _, _ = encoder(vocabulary)
    if not _LONG_RUN.search(formatted):
        return np.array(encoding.encode(formatted, allowed_special="all"), dtype=np.int32)
    ids: list[int] = []
    for piece in re.split(f"({'|'.join(map(re.escape, (START, SEP, END)))})", formatted):
        at = 0
        for run in _LONG_RUN.finditer(piece):
            ids += encoding.encode(piece[at : run.start()], allowed_special="all")
            for cut in range(run.start(), run.end(), 4096):
                ids += encoding.encode(piece[cut : min(cut + 4096, run.end())], allowed_special="all")
            at = run.end()
        ids += encoding.encode(piece[at:], allowed_special="all")
    return np.array(ids, dtype=np.int32)


def mask(token_ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for each token that meets a span.

    ``token_ends`` and ``spans`` (n x 2: start, end) are sorted byte offsets.
    Two binary searches find each span's first and last token.
    """
    marks = np.zeros(len(token_ends) + 1, dtype=np.int64)
    filled = spans[spans[:, 1] > spans[:, 0]]
    first = np.searchsorted(token_ends, filled[:, 0], side="right")
    last = np.searchsorted(token_ends, filled[:, 1], side="left")
    np.add.at(marks, first, 1)
    np.add.at(marks, last + 1, -1)
    return (np.cumsum(marks[:-1]) > 0).astype(np.int8)


def render(turns: list[tuple[str, str]], trained: frozenset[str]) -> tuple[str, np.ndarray]:
    """The rendered turns and the byte spans of the texts to train on."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = f"{START}{escape(role)}{SEP}"
        start = at + len(head.encode())
        end = start + len(body.encode())
        if role in trained:
            spans.append((start, end))
        pieces.append(f"{head}{body}{END}\n")
        at = end + len(END) + 1
    return "".join(pieces), np.array(spans, dtype=np.int64).reshape(-1, 2)


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: tuple[str, ...] = ("assistant",),
    vocabulary: str = VOCABULARY,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Render whole conversations, encode them once, and mark the tokens to train on.

    Each turn becomes ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line
    feed; the marks are tokens of their own, so no token reaches over the edge
    of a text.  Returns conv_id, part, formatted, token_ids, loss_mask and
    loss_spans (start and end in bytes, one after the other).

    Turns come by ``turn``; equal turns by role, then text; a NULL turn first.
    NULL roles and texts are empty, and NULL is a conversation of its own.
    Repeated rows are repeated turns.  Empty input gives no rows; other
    columns are ignored.  A conversation is one part unless it exceeds
    ``part_chars``; parts end between turns, where the encoding is cut anyway,
    so a conversation of any length passes through in bounded memory.
    """
    wanted = frozenset(trained)
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, sizes = encoder(vocabulary)
        current: object = ()
        held: list[tuple[str, str]] = []
        part = chars = 0

        def row() -> dict:
            formatted, spans = render(held, wanted)
            ids = tokens_of(formatted, vocabulary)
            return {
                "conv_id": current,
                "part": part,
                "formatted": formatted,
                "token_ids": ids,
                "loss_mask": mask(np.cumsum(sizes[ids]), spans),
                "loss_spans": spans.ravel(),
            }

        for batch in batches:
            out = []
            for c, r, t in zip(batch["conv_id"].astype("Int64"), batch["role"], batch["text"], strict=True):
                key = None if c is pd.NA else int(c)
                if key != current or chars >= part_chars:
                    if held:
                        out.append(row())
                    part = part + 1 if key == current else 0
                    current, held, chars = key, [], 0
                held.append((r, t))
                chars += len(r) + len(t)
            if out:
                yield _frame(out)
        if held:
            yield _frame([row()])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(
        parts, FORMATTED
    )


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"conv_id": "Int64"})


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered part; undoes :func:`render`."""
    out = []
    for turn in formatted.split(f"{END}\n")[:-1]:
        role, _, text = turn.removeprefix(START).partition(SEP)
        out.append((unescape(role), unescape(text)))
    return out


def masked_texts(token_ids: np.ndarray, loss_mask: np.ndarray, vocabulary: str) -> list[str]:
    """What stands under each run of the mask, read from the tokens alone."""
    _, table, _ = encoder(vocabulary)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loss_mask, [0]])))
    return [
        unescape(b"".join(table[i] for i in token_ids[a:b]).decode())
        for a, b in zip(edges[::2], edges[1::2], strict=True)
    ]


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "n_tokens long, loss_tokens long"
)


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY, in_order: bool = False) -> DataFrame:
    """One row per conversation of :func:`format_chats`' output: what its text and its mask give back.

    ``in_order`` says that the parts already come conversation by conversation,
    as they leave :func:`format_chats`; else they are brought together.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = ()
        row: dict = {}

        def done() -> dict:
            return row | {"turns_sha256": row["turns_sha256"].hexdigest(), "loss_sha256": row["loss_sha256"].hexdigest()}

        for batch in batches:
            out = []
            for c, text, ids, marks in zip(
                batch["conv_id"].astype("Int64"), batch["formatted"], batch["token_ids"], batch["loss_mask"], strict=True
            ):
                key = None if c is pd.NA else int(c)
                if key != current:
                    if row:
                        out.append(done())
                    current = key
                    row = {"conv_id": key, "turns_sha256": hashlib.sha256(), "loss_sha256": hashlib.sha256()} | dict.fromkeys(
                        ("n_turns", "loss_chars", "formatted_chars", "n_tokens", "loss_tokens"), 0
                    )
                for role, said in read_turns(text):
                    row["n_turns"] += 1
                    row["turns_sha256"].update(f"{role}\n{said}\n".encode())
                for said in masked_texts(np.asarray(ids), np.asarray(marks), vocabulary):
                    row["loss_chars"] += len(said)
                    row["loss_sha256"].update(said.encode())
                row["formatted_chars"] += len(text)
                row["n_tokens"] += len(ids)
                row["loss_tokens"] += int(np.sum(marks))
            if out:
                yield _frame(out)
        if row:
            yield _frame([done()])

    ordered = formatted if in_order else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select("conv_id", "formatted", "token_ids", "loss_mask").mapInPandas(digests, DIGESTS)
