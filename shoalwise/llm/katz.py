"""A Katz back-off language model over all documents, and its scores.

A token is scored after its ``order`` - 1 predecessors, backing off level by
level to fewer of them, to the token alone, and from there to the unknown word.
Counts are Good-Turing discounted; what a context's seen successors leave is
spread over the others in proportion to their probability a level below, with
exactly normalised weights.

Tokens stay packed: one row holds the tokens of some thousand documents as
numpy arrays.  A pack asks for the counts of its distinct words and word runs;
Spark deals these requests by hash into buckets, each bucket adds up what all
packs have of its keys, and the totals go back to the packs that asked.  Rows
per key only appear for the contexts' sums, which are a table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwise.llm.common import crc_remainder, spaced_words, staged, text_bytes

#: Tokens in one pack, and keys of one level in one bucket on average.
PACK_TOKENS, BUCKET_KEYS = 1 << 20, 1 << 21
#: Counts up to this are Good-Turing discounted; larger ones lose LEFT of one occurrence.
LARGEST, LEFT = 5, 0.05
SEED = 9
#: What begins and ends a text; no word can be equal to them.
BEGIN, END = b"\n<s>", b"\n</s>"

PACK = "pack long, n_tokens long, n_docs long, words binary, tokens binary, lengths binary, ids binary, held binary"


def _zip(values: np.ndarray) -> bytes:
    """Bytes of an array, byte planes apart, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unzip(blob: bytes, dtype: str) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _zip_sorted(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=np.uint64(0)))


def _unzip_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unzip(blob, "<u8"), dtype=np.uint64)


def pair_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit keys of runs of words from the keys of the run before the last word and that word's hash."""
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) + after) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def tokenise(docs: DataFrame, key: str, text: str, modulus: int, held_out: int, pack_tokens: int) -> DataFrame:
    """Documents as packs: hashes of distinct words, token numbers, lengths, ids and held-out flags."""
    rows = docs.select(
        F.col(key).cast("long").alias("id"),
        (crc_remainder(key, modulus) == held_out).alias("held"),
        text_bytes(text).alias("text"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        part, number = TaskContext.get().partitionId(), 0
        vocabulary: dict[bytes, int] = {}
        chunks: list[np.ndarray] = []
        lengths: list[int] = []
        ids: list[int | None] = []
        held: list[bool] = []
        size = 0

        def packed() -> pd.DataFrame:
            hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in vocabulary], dtype="<u8")
            known = np.array([i is not None for i in ids])
            row = {
                "pack": (part << 32) + number,
                "n_tokens": size,
                "n_docs": len(lengths),
                "words": _zip(hashes),
                "tokens": _zip(np.concatenate(chunks)),
                "lengths": _zip(np.array(lengths, dtype="<i8")),
                "ids": _zip(np.array([i or 0 for i in ids], dtype="<i8")) + known.astype(np.uint8).tobytes(),
                "held": np.array(held, dtype=np.uint8).tobytes(),
            }
            return pd.DataFrame([row])

        for batch in batches:
            for i, h, t in zip(batch["id"].astype("Int64"), batch["held"], batch["text"], strict=True):
                words = spaced_words(bytes(t))
                words.append(END)
                number_of = vocabulary.setdefault
                chunk = np.fromiter((number_of(w, len(vocabulary)) for w in words), dtype="<i4", count=len(words))
                chunks.append(chunk)
                lengths.append(len(words))
                ids.append(None if i is pd.NA else int(i))
                held.append(bool(h))
                size += len(words)
                if size >= pack_tokens:
                    yield packed()
                    number += 1
                    vocabulary, chunks, lengths, ids, held, size = {}, [], [], [], [], 0
        if lengths:
            yield packed()

    return rows.mapInPandas(pack, PACK)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has some of the sorted keys, with their places in order."""
    bucket = keys % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    for b, mine in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
        yield b, mine


class Level:
    """The distinct runs of one length in a pack: keys in order, a place of each, the run that ends at each token."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, of: np.ndarray, context: np.ndarray | None):
        self.keys, self.at, self.of, self.context = keys, at, of, context


class Pack:
    """The arrays of one pack, with the distinct runs of 1 to ``order`` words."""

    def __init__(self, row, order: int):
        import xxhash

        self.number = int(row.pack)
        self.lengths = _unzip(row.lengths, "<i8")
        n = len(self.lengths)
        self.known = np.frombuffer(row.ids[-n:], np.uint8).astype(bool)
        self.ids = _unzip(row.ids[:-n], "<i8")
        self.held = np.frombuffer(row.held, np.uint8).astype(bool)
        begin = xxhash.xxh64_intdigest(BEGIN, SEED)
        hashes = _unzip(row.words, "<u8")
        ranks = np.argsort(hashes)
        place = np.empty(len(hashes), dtype=np.int64)
        place[ranks] = np.arange(len(hashes))
        words = hashes[ranks]
        tokens = place[_unzip(row.tokens, "<i4")]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(n), self.lengths)
        self.trains = ~self.held[self.doc]
        after = words[tokens]
        self.levels = [Level(words, np.unique(tokens, return_index=True)[1], tokens, None)]
        run = after
        for _ in range(1, order):
            # a run's context is the run, one word shorter, that ends before its last word
            before = np.empty_like(run)
            before[1:] = run[:-1]
            before[self.starts] = begin
            run = pair_key(before, after)
            self.levels.append(Level(*np.unique(run, return_index=True, return_inverse=True), before))

    def requests(self, buckets: int) -> Iterator[dict]:
        """Keys with their counts in training documents, by level and bucket."""
        for number, level in enumerate(self.levels, 1):
            counts = np.bincount(level.of[self.trains], minlength=len(level.keys)).astype("<i8")
            for b, mine in _dealt(level.keys, buckets):
                yield {"level": number, "bucket": b, "pack": self.number, "keys": _zip_sorted(level.keys[mine]), "counts": _zip(counts[mine])}

    def filled(self, number: int, answers: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Total counts of the keys of a level, and whether this pack owns a key."""
        keys = self.levels[number - 1].keys
        totals, owned = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        places = dict(_dealt(keys, buckets))
        for row in answers[answers["level"] == number].itertuples():
            mine = places[row.bucket]
            signed = _unzip(row.totals, "<i8")
            totals[mine], owned[mine] = np.abs(signed), signed < 0
        return totals, owned


REQUEST = "level int, bucket int, pack long, keys binary, counts binary"
ANSWER = "level int, bucket int, pack long, totals binary, stats array<long>"


def add_up(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: totals of each key, sent to each pack that asked; negative in the first pack that has it in training.

    The first row's stats are N, V and how many keys occur 1, 2, ... times.
    """
    group = group.sort_values("pack")
    keys = [_unzip_sorted(k) for k in group["keys"]]
    counts = np.concatenate([_unzip(c, "<i8") for c in group["counts"]])
    distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(of, counts, len(distinct)).astype(np.int64)
    has = np.flatnonzero(counts)
    _, first = np.unique(of[has], return_index=True)
    owner = np.zeros(len(of), dtype=bool)
    owner[has[first]] = True
    signed = np.where(owner, -totals[of], totals[of]).astype("<i8")
    edges = np.cumsum([0, *(len(k) for k in keys)])
    seen = totals[totals > 0]
    stats = [int(seen.sum()), len(seen), *np.bincount(seen[seen <= LARGEST + 1], minlength=LARGEST + 2)[1:].tolist()]
    return pd.DataFrame(
        {
            "level": group["level"].to_numpy(),
            "bucket": group["bucket"].to_numpy(),
            "pack": group["pack"].to_numpy(),
            "totals": [_zip(signed[a:b]) for a, b in zip(edges, edges[1:], strict=False)],
            "stats": [stats] + [[0] * len(stats)] * (len(group) - 1),
        }
    )


def discounts(times: list[int]) -> np.ndarray:
    """Katz's factors for counts 0 to ``LARGEST`` from the numbers of keys seen 1, 2, ... times.

    Where Good-Turing gives no factor between 0 and 1 (too few keys), half an
    occurrence is taken off.
    """
    out = np.ones(LARGEST + 1)
    rest = (LARGEST + 1) * times[LARGEST] / times[0] if times[0] else 1.0
    for r in range(1, LARGEST + 1):
        ratio = (r + 1) * times[r] / times[r - 1] / r if times[r - 1] else -1.0
        d = (ratio - rest) / (1 - rest) if rest < 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    small = counts <= LARGEST
    return np.where(small, counts * factors[np.where(small, counts, 0)], counts - LEFT)


PART = (
    "kind int, level int, context long, doc_row int, pack long, seen double, lower double, times long, doc_id long, held_out boolean, "
    "n_tokens long, n_known long, base_score double"
)


def score_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    modulus: int = 5,
    held_out: int = 1,
    pack_tokens: int = PACK_TOKENS,
    bucket_keys: int = BUCKET_KEYS,
    order: int = 2,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from rows whose crc32 of the id modulo ``modulus`` is not
    ``held_out``.  ``score`` is the log10 probability of the text's tokens and
    its end under the Katz model of runs of up to ``order`` words (1: words
    alone); ``base_score`` that of single tokens with half a count added.  Words are known by 64-bit hashes (two of n words meet by
    chance n^2 / 4e19 of the time).

    NULL and empty texts are their end alone; NULL ids count as the text '';
    repeated rows train and score as often as they stand; without training
    rows every token is unknown and has probability 1.  Counts are made over
    all rows; other columns are ignored.
    """
    if order < 1:
        raise ValueError("the order is at least 1")
    packs = staged(tokenise(docs, key, text, modulus, held_out, pack_tokens), "packs")
    tokens = packs.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = int(tokens // bucket_keys) + 1

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame(list(Pack(row, order).requests(buckets)), columns=["level", "bucket", "pack", "keys", "counts"])

    # one pack at a time: a pack is some megabytes
    asked = packs.mapInPandas(ask, REQUEST)
    answers = staged(asked.groupBy("level", "bucket").applyInPandas(add_up, ANSWER), "answers")
    width = LARGEST + 3
    sums = answers.groupBy("level").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(width)]).collect()
    stats = {r["level"]: [int(r[f"s{i}"]) for i in range(width)] for r in sums}
    n, v, *times = stats.get(1, [0] * width)
    factors = [discounts(stats.get(level, [0] * width)[2:]) for level in range(1, order + 1)]
    single = factors[0]

    # what discounting takes off all words is the unknown word's
    off = sum(times[r - 1] * (r - r * single[r]) for r in range(1, LARGEST + 1)) + LEFT * (v - sum(times[:LARGEST]))
    unknown = off / n if n else 1.0

    def evaluate(mine: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=[c.split()[0] for c in PART.split(", ")])
        pack = Pack(next(mine.itertuples()), order)
        filled = [pack.filled(level, got, buckets) for level in range(1, order + 1)]
        return _evaluated(pack, filled, n, v, unknown, factors)

    parts = staged(packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(evaluate, PART), "parts")
    mass = parts.where("kind = 1").groupBy("level", "context").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower"))
    # what a context leaves, over what the words it has not seen have by themselves
    weight = F.log10(F.greatest(1 - F.col("seen"), F.lit(1e-15)) / F.greatest(1 - F.col("lower"), F.lit(1e-15)))
    weights = mass.select(F.col("level").alias("l"), F.col("context").alias("c"), weight.alias("weight"))
    backed = (
        parts.where("kind = 2")
        .join(weights, (F.col("level") == F.col("l")) & (F.col("context") == F.col("c")), "left")
        .groupBy(F.col("pack").alias("p"), F.col("doc_row").alias("d"))
        .agg(F.sum(F.col("times") * F.coalesce("weight", F.lit(0.0))).alias("backed"))
    )
    rows = parts.where("kind = 0")
    return rows.join(backed, (F.col("pack") == F.col("p")) & (F.col("doc_row") == F.col("d")), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("seen") + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )


def _evaluated(pack: Pack, filled: list[tuple[np.ndarray, np.ndarray]], n: int, v: int, unknown: float, factors: list[np.ndarray]) -> pd.DataFrame:
    """Scores of a pack's documents but for back-off weights; its contexts' sums; which weights its documents need."""
    import xxhash

    n_docs = len(pack.lengths)
    by_doc = lambda x: np.bincount(pack.doc, x, n_docs)
    words = filled[0][0]
    known = words[pack.levels[0].of]
    # the beginning occurs as often as the end
    begins = words[np.searchsorted(pack.levels[0].keys, np.uint64(xxhash.xxh64_intdigest(END, SEED)))]
    value = np.where(known > 0, discounted(known, factors[0]) / max(n, 1), unknown)
    frames, counts = [], known
    for number, (level, (totals, owns)) in enumerate(zip(pack.levels[1:], filled[1:], strict=True), 2):
        # a context's count is that of the run it is
        context = np.empty_like(counts)
        context[1:] = counts[:-1]
        context[pack.starts] = begins
        counts = totals[level.of]
        seen, lower = counts > 0, value
        value = np.where(seen, discounted(counts, factors[number - 1]) / np.maximum(context, 1), lower)
        mine = level.at[owns]
        contexts, of = np.unique(level.context[mine], return_inverse=True)
        frames.append(pd.DataFrame(
            {
                "kind": 1,
                "level": number,
                "context": contexts.view(np.int64),
                "seen": np.bincount(of, value[mine], len(contexts)),
                "lower": np.bincount(of, lower[mine], len(contexts)),
            }
        ))
        needs = np.flatnonzero(~seen & (context > 0))
        order = needs[np.lexsort((level.context[needs], pack.doc[needs]))]
        doc, at = pack.doc[order], level.context[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])) if len(order) else order
        frames.append(pd.DataFrame(
            {
                "kind": 2,
                "level": number,
                "context": at[first].view(np.int64),
                "doc_row": doc[first],
                "pack": pack.number,
                "times": np.diff(np.append(first, len(order))),
            }
        ))
    docs = pd.DataFrame(
        {
            "kind": 0,
            "level": 0,
            "context": 0,
            "doc_row": np.arange(n_docs),
            "pack": pack.number,
            "seen": by_doc(np.log10(value)),
            "lower": 0.0,
            "times": 0,
            "doc_id": pd.array(np.where(pack.known, pack.ids, 0), dtype="Int64"),
            "held_out": pack.held,
            "n_tokens": pack.lengths,
            "n_known": by_doc(known > 0).astype(np.int64),
            "base_score": by_doc(np.log10((known + 0.5) / (n + 0.5 * (v + 1)))),
        }
    )
    docs.loc[~pack.known, "doc_id"] = pd.NA
    out = pd.concat([docs, *frames], ignore_index=True)
    return out.astype({c: "Int64" for c in ("doc_row", "pack", "times", "doc_id", "n_tokens", "n_known")} | {"held_out": "boolean"})
