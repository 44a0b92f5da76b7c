"""Benchmark decontamination with suffix arrays over the training documents.

Each task cuts its documents into shards and sorts the suffixes of a shard's
words into a suffix array; every suffix of every benchmark item is then found
by binary search.  Its neighbours give its longest verbatim match, and the
range of its first window gives all places of that window.

A suffix can only matter where its first words stand somewhere in the
benchmark, so each position is first coded by the benchmark's run of ``LEAD``
words that begins there, and the array is sparse: positions without a code
end a match and are not sorted.  Matches of fewer than ``LEAD`` words (or of
fewer than the item has) are therefore not reported; windows never are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shoalwise.llm.common import plain_words, shared_folder, text_bytes, unused

WINDOW = 13
LEAD = 4
#: Words in one suffix array.
SHARD_WORDS = 1 << 20
#: Bytes of benchmark texts that a task holds at a time.
BLOCK_BYTES = 1 << 25


def suffix_array(codes: np.ndarray, longest: int) -> np.ndarray:
    """Positions of the codes over 0 in the order of what stands from there on, by prefix doubling.

    Orders by the first ``longest`` codes at least; 0 ends no comparison but
    sorts before all others.
    """
    at = np.flatnonzero(codes)
    if not len(at):
        return at
    rank = np.zeros(len(codes) + 1, dtype=np.int64)
    rank[:-1] = codes
    step, order = 1, np.argsort(rank[at], kind="stable")
    while step < longest:
        key = rank[at] * (rank.max() + 1) + rank[np.minimum(at + step, len(codes))]
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[1], np.diff(key[order]) != 0]).cumsum()
        rank[at[order]] = fresh
        if fresh[-1] == len(at):
            break
        step *= 2
    return at[order]


class Suffixes:
    """Coded suffixes of a set of items, to be looked up in coded documents."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, lead: int):
        self.lead, self.window = lead, window
        words = sorted(set(chain.from_iterable(w for _, w in items)))
        self.ids = {w: i for i, w in enumerate(words, 1)}
        self.base = len(words) + 1
        numbered = [(item, self.numbers(w)) for item, w in items]
        self.tables: list[np.ndarray] = []
        flat = np.concatenate([np.append(n, 0) for _, n in numbered])
        for _ in range(1, lead):
            keys, _ = self._keys(flat)
            self.tables.append(np.unique(keys))
        self.longest = 0
        #: Each item with its codes, kept once: suffixes are places in them; number of suffixes, words of a window
        self.coded: list[tuple[str, bytes, int, int]] = []
        self.windows: dict[bytes, tuple[int, set[str]]] = {}
        for item, n in numbered:
            codes = self.codes(n).astype(">u4")
            width = min(window, len(n))
            starts = len(n) - lead + 1
            self.longest = max(self.longest, starts)
            coded = codes[:starts].tobytes()
            self.coded.append((item, coded, starts, width))
            for j in range(len(n) - width + 1):
                self.windows.setdefault(self._window(coded, j, width), (width, set()))[1].add(item)

    def _window(self, coded: bytes, word: int, width: int) -> bytes:
        return coded[4 * word : 4 * (word + width - self.lead + 1)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def _keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of one word more than the tables know, as keys, and where they begin."""
        codes = ids
        for width, table in enumerate(self.tables, 1):
            codes = self._step(codes, ids, width, table)
        width = len(self.tables) + 1
        at = np.flatnonzero(codes[: max(0, len(ids) - width)])
        at = at[ids[at + width] > 0]
        return codes[at] * self.base + ids[at + width], at

    def _step(self, codes: np.ndarray, ids: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(codes[: max(0, len(ids) - width)])
        at = at[ids[at + width] > 0]
        key = codes[at] * self.base + ids[at + width]
        place = np.searchsorted(table, key)
        place[place == len(table)] = 0
        hit = table[place] == key if len(table) else np.zeros(len(at), dtype=bool)
        longer = np.zeros(len(ids), dtype=np.int64)
        longer[at[hit]] = place[hit] + 1
        return longer

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """For each position the number of the benchmark's run of ``lead`` words there, or 0."""
        codes = ids
        for width, table in enumerate(self.tables, 1):
            codes = self._step(codes, ids, width, table)
        return codes

    def search(self, ids: np.ndarray) -> tuple[list[tuple[bytes, np.ndarray]], list[tuple[str, int, int, int]]]:
        """All places of each window; the longest match of each suffix as (item, word, words, place)."""
        codes = self.codes(ids)
        order = suffix_array(codes, self.longest)
        if not len(order):
            return [], []
        text = codes.astype(">u4").tobytes()
        array = order.tolist()
        present = set(codes[order].astype(">u4").tobytes()[i : i + 4] for i in range(0, 4 * len(order), 4))
        seen: set[bytes] = set()
        places, longest = [], []
        for item, coded, starts, width in self.coded:
            for word in range(starts):
                if coded[4 * word : 4 * word + 4] not in present:
                    continue
                low = _place(array, text, coded, 4 * word)
                best, where = 0, -1
                for near in (low - 1, low):
                    if 0 <= near < len(array):
                        common = _common(coded, 4 * word, text, 4 * array[near])
                        if common > best:
                            best, where = common, array[near]
                if best:
                    longest.append((item, word, best + self.lead - 1, where))
                if best + self.lead - 1 < width or word + width > starts + self.lead - 1:
                    continue
                first = self._window(coded, word, width)
                if first not in seen:
                    seen.add(first)
                    m = len(first)
                    start = bisect_left(array, first, key=lambda p: text[4 * p : 4 * p + m])  # noqa: B023
                    end = bisect_right(array, first, lo=start, key=lambda p: text[4 * p : 4 * p + m])  # noqa: B023
                    if end > start:
                        places.append((first, order[start:end]))
        return places, longest


def _alike(a: bytes, i: int, b: bytes, j: int) -> int:
    """Bytes up to the stretch in which a from i on and b from j on first differ, or to the end of one.

    Stretches double, so that nothing much longer than what is equal is ever copied.
    """
    start, step, most = i, 64, min(len(a) - i, len(b) - j)
    while i - start < most:
        step = min(step, most - (i - start))
        if a[i : i + step] != b[j : j + step]:
            break
        i, j, step = i + step, j + step, step * 2
    return i - start


def _place(array: list[int], text: bytes, coded: bytes, at: int) -> int:
    """How many of the sorted places of the text stand before the suffix of an item that begins at byte ``at``."""
    low, high, rest = 0, len(array), len(coded) - at
    while low < high:
        middle = (low + high) // 2
        p = 4 * array[middle]
        same = _alike(coded, at, text, p)
        # the differing stretch is at most as long as what is equal before it, or 64 bytes
        step = min(max(64, same + 64), rest - same)
        if text[p + same : p + same + step] < coded[at + same : at + same + step]:
            low = middle + 1
        else:
            high = middle
    return low


def _common(coded: bytes, at: int, text: bytes, p: int) -> int:
    """Number of equal codes from a place of an item and a place of the text on."""
    same = _alike(coded, at, text, p)
    step = max(64, same + 64)
    x, y = np.frombuffer(coded[at + same : at + same + step], ">u4"), np.frombuffer(text[p + same : p + same + step], ">u4")
    n = min(len(x), len(y))
    different = np.flatnonzero(x[:n] != y[:n])
    return same // 4 + (int(different[0]) if len(different) else n)


@lru_cache(maxsize=1)
def _block(folder: str, block: int, window: int) -> list[Suffixes]:
    """One block of the benchmark; items under ``LEAD`` words are a set of their own."""
    from pyarrow import dataset, fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    path = f"{path}/block={block}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return []
    table = dataset.dataset(path, filesystem=system, format="parquet").to_table().to_pydict()
    items = [(i, plain_words(t)) for i, t in zip(table["item"], table["text"], strict=True)]
    long = [x for x in items if len(x[1]) >= LEAD]
    short = [x for x in items if 0 < len(x[1]) < LEAD]
    sets = [Suffixes(long, window, LEAD)] if long else []
    return sets + ([Suffixes(short, window, min(len(w) for _, w in short))] if short else [])


class Benchmark:
    """A benchmark written to the shared folder in blocks that a task reads one at a time."""

    def __init__(self, items: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES):
        rows = items.select(
            F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), text_bytes(text).alias("text")
        )
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks = int(size // block_bytes) + 1
        self.folder = shared_folder(items.sparkSession, "benchmark")
        numbered = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(self.blocks)))
        numbered.repartition("block").write.partitionBy("block").parquet(self.folder)


def _shards(texts: Iterator[list[bytes]], shard_words: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Whole documents by number of words; a document over the size is a shard of its own."""
    held: list[list[bytes]] = []
    size = first = n = 0
    for n, words in enumerate(texts, 1):
        held.append(words)
        size += len(words)
        if size >= shard_words:
            yield first, held
            held, size, first = [], 0, n
    if held:
        yield first, held


def _joined(searcher: Suffixes, shard: list[list[bytes]], n: int) -> np.ndarray:
    """Word numbers of a shard with a 0 after each document."""
    get = searcher.ids.get
    return np.fromiter(chain.from_iterable(chain(map(get, w, repeat(0)), (0,)) for w in shard), dtype=np.int64, count=n)


def _scan(shard: list[list[bytes]], folder: str, blocks: int, window: int) -> list[dict]:
    lengths = np.array([len(w) for w in shard], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    edges = np.zeros(starts[-1] + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in shard]
    longest = [0] * len(shard)
    for b in range(blocks):
        for searcher in _block(folder, b, window):
            places, best = searcher.search(_joined(searcher, shard, int(starts[-1])))
            for first, at in places:
                width, named = searcher.windows[first]
                np.add.at(edges, at, 1)
                np.add.at(edges, at + width, -1)
                for doc in np.unique(np.searchsorted(starts, at, side="right") - 1):
                    items[doc] |= named
            for _, _, words, at in best:
                doc = int(np.searchsorted(starts, at, side="right")) - 1
                longest[doc] = max(longest[doc], words)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    counts = hit[starts[1:]] - hit[starts[:-1]]
    out = []
    for d, named in enumerate(items):
        spans: list[int] = []
        if named:
            marks = np.diff(hit[starts[d] : starts[d + 1] + 1], prepend=hit[starts[d]], append=hit[starts[d + 1]])
            spans = (np.flatnonzero(np.diff(marks[1:], prepend=0))).tolist()
        out.append({"n_words": int(lengths[d]), "n_hit": int(counts[d]), "item_ids": sorted(named), "longest_words": longest[d], "hit_spans": spans})
    return out


RESULT = "n_words long, n_hit long, item_ids array<string>, longest_words int, hit_spans array<long>"


def contamination(
    text: str | Column, benchmark: Benchmark, window: int = WINDOW, shard_words: int = SHARD_WORDS
) -> Column:
    """A struct of what a text has of the benchmark.

    Its words, the words inside an occurrence of a window, the items (as text,
    sorted) with occurring windows, the words of the longest match that some
    item's suffix has in the shard and that lies here, and the hit words as
    starts and ends, one after the other.

    A window is ``window`` consecutive words of an item, or all of a shorter
    one; items without words have none.  NULL and empty texts have no words,
    repeated documents and repeated items give equal results, NULL item ids
    count as ''.  Nothing is shuffled: each document is searched where it is.
    """
    folder, blocks = benchmark.folder, benchmark.blocks

    @pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, shard in _shards((plain_words(bytes(t)) for t in batch), shard_words):
                rows += _scan(shard, folder, blocks, window)
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "longest_words", "hit_spans"])

    return scan.asNondeterministic()(text_bytes(text))


def is_contaminated(found: Column, hit_share: int = 20) -> Column:
    """At least one in ``hit_share`` words is hit."""
    return (found["n_hit"] > 0) & (found["n_hit"] * hit_share >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: Benchmark, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    (found,) = unused(docs, "found")
    return docs.withColumn(found, contamination(text, benchmark)).where(~is_contaminated(F.col(found))).drop(found)


def longest_matches(
    docs: DataFrame, benchmark: Benchmark, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """For each benchmark suffix its longest verbatim match in all documents: item_id, item_word, words, doc_id, doc_word.

    Shards give their own longest matches; the longest over all shards stays,
    of equal ones the smallest document and place.  Suffixes without a match
    of ``LEAD`` words have no row.
    """
    folder, blocks = benchmark.folder, benchmark.blocks
    schema = "item_id string, item_word long, words long, doc_id long, doc_word long"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["doc_id"].astype("Int64").tolist()
            for base, shard in _shards((plain_words(bytes(t)) for t in batch["text"]), shard_words):
                starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in shard])])
                rows = []
                for b in range(blocks):
                    for searcher in _block(folder, b, WINDOW):
                        for item, word, words, at in searcher.search(_joined(searcher, shard, int(starts[-1])))[1]:
                            doc = int(np.searchsorted(starts, at, side="right")) - 1
                            rows.append((item, word, words, keys[base + doc], at - int(starts[doc])))
                frame = pd.DataFrame(rows, columns=["item_id", "item_word", "words", "doc_id", "doc_word"])
                yield frame.astype({"doc_id": "Int64"})

    found = docs.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInPandas(scan, schema)
    best = F.min(F.struct(-F.col("words"), "doc_id", "doc_word")).alias("best")
    return found.groupBy("item_id", "item_word").agg(best).select(
        "item_id",
        "item_word",
        (-F.col("best")["col1"]).alias("words"),
        F.col("best")["doc_id"].alias("doc_id"),
        F.col("best")["doc_word"].alias("doc_word"),
    )
