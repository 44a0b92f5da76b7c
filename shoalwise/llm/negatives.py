"""Hard-negative mining: anchors against all rows, in tiles multiplied by Strassen's recursion.

The rows are dealt into groups of a few thousand.  Each group holds its rows
and lets all anchors stream past them in tiles; a tile's scores leave only the
best few of each anchor, and what the groups found is merged by Spark.  The
positives must be known before their windows are, so the tiles are multiplied
twice: first with the rows of the anchor's label, then with all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwise.llm.common import staged

#: A product whose smallest side is at most this is taken directly.
LEAF = 32
#: Rows of a group on average, and anchors of a tile.
GROUP_ROWS = 4096
TILE_ANCHORS = 256
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of two int64 matrices by seven half-size products.

    Odd sides get a row or column of zeros.  Sums and products are those of
    whole numbers modulo 2**64, so entries that fit int64 are exact even if a
    sum on the way does not fit.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :l], a[:i, l:], a[i:, :l], a[i:, l:]
    b11, b12, b21, b22 = b[:l, :j], b[:l, j:], b[l:, :j], b[l:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), dtype=np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def heap(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest allowed scores of each row, best first; equal scores by column."""
    n = scores.shape[1]
    picked = allowed
    if n > k:
        held = np.where(allowed, scores, _LEAST)
        picked = allowed & (held >= np.partition(held, n - k, axis=1)[:, n - k, None])
    row, column = np.nonzero(picked)
    order = np.lexsort((column, ~scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


class _Rows:
    """Ids, labels and vectors of some rows as arrays."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        self.table = table
        ids = table["id"].combine_chunks() if isinstance(table["id"], pa.ChunkedArray) else table["id"]
        self.no_id = np.asarray(ids.is_null())
        self.id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.label = table["label"].to_numpy()
        vectors = table["vector"].combine_chunks()
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.chunk(0)
        self.size = np.asarray(vectors.value_lengths().fill_null(0), dtype=np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.vector = np.zeros((len(ids), int(self.size.max(initial=0))), dtype=np.int64)
        self.vector[np.arange(self.vector.shape[1]) < self.size[:, None]] = flat

    def sort(self, by_label: bool) -> None:
        keys = [self.id, self.no_id] + ([self.label] if by_label else [])
        order = np.lexsort(keys)
        for name in ("no_id", "id", "label", "size", "vector"):
            setattr(self, name, getattr(self, name)[order])

    def widened(self, width: int) -> np.ndarray:
        return np.pad(self.vector, ((0, 0), (0, width - self.vector.shape[1])))


def _same_row(anchors: _Rows, rows: _Rows) -> np.ndarray:
    """Where a row is the anchor itself."""
    same = (anchors.id[:, None] == rows.id) & ~rows.no_id & (anchors.label[:, None] == rows.label)
    for i, j in zip(*np.nonzero(same), strict=True):
        same[i, j] = np.array_equal(anchors.vector[i, : anchors.size[i]], rows.vector[j, : rows.size[j]])
    return same


def _against(rows: _Rows | None, anchors: _Rows, find: Callable) -> Iterator[pa.RecordBatch]:
    if rows is None or not len(rows.id) or not len(anchors.id):
        return
    width = max(rows.vector.shape[1], anchors.vector.shape[1])
    left, right = anchors.widened(width), rows.widened(width).T
    yield from find(anchors, rows, left, right)


def _streamed(find: Callable, by_label: bool) -> Callable:
    """Over a partition sorted by group, rows before anchors: each tile of anchors against its group's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, rows = None, [], None
        for batch in batches:
            groups, kinds = batch["group"].to_numpy(), batch["anchor"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(groups)], strict=True):
                if a == b:
                    continue
                if groups[a] != group:
                    group, held, rows = groups[a], [], None
                if not kinds[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if rows is None and held:
                    rows, held = _Rows(held), []
                    rows.sort(by_label)
                for at in range(a, b, TILE_ANCHORS):
                    yield from _against(rows, _Rows([batch.slice(at, min(TILE_ANCHORS, b - at))]), find)

    return run


def _ids(rows: _Rows, at: np.ndarray) -> pa.Array:
    return pa.array(rows.id[at], pa.int64(), mask=rows.no_id[at])


def prepared(df: DataFrame, row_id: str, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """id, label and floor(scale * x) of the rows that take part; exact repetitions are one row."""
    x = F.col(vector).cast("array<double>")
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        df.select(F.col(row_id).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
        .where(F.col("label").isNotNull() & F.col("x").isNotNull() & ~odd)
        .select("id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("vector"))
        .distinct()
    )


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels inside the positive's window.

    ``rows`` come from :func:`prepared`; ``anchors`` is a condition on them.  A
    row's score is its inner product with the anchor; higher scores come first,
    then smaller ids, a NULL id last.  An anchor's positives are its first other
    rows of the same label; the window is ``low * p <= 100 * score <= high * p``
    for a positive's score p.

    Returns anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score.  Anchors without positives and windows without rows give no
    rows, as do empty tables.  Rows with a NULL or non-finite part take no part;
    a row with a NULL id does, but is an anchor only if the condition says so.
    Vectors of unequal length are filled up with zeros, so an empty one scores
    0.  Rows with one id but other labels or vectors are different rows (and
    different anchors).  Scores must fit a long.
    """
    rows = staged(rows, "negative-rows")
    groups = max(1, -(-rows.count() // group_rows))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(groups)).cast("int"))
    key = F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.col("label").cast("string"), F.to_json("vector")), 256)
    chosen = staged(rows.where(anchors).withColumn("key", key), "negative-anchors")

    def met(queries: DataFrame, find: Callable, by_label: bool, schema: str) -> DataFrame:
        extra = [c for c in queries.columns if c not in ("id", "label", "vector")]
        nothing = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in extra]
        both = dealt.select("group", F.lit(False).alias("anchor"), "id", "label", "vector", *nothing).unionByName(
            queries.select(
                F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("anchor"), "id", "label", "vector", *extra
            )
        )
        return both.repartition(min(groups, 20_000), "group").sortWithinPartitions("group", "anchor").mapInArrow(_streamed(find, by_label), schema)

    def best_rows(anchors: _Rows, rows: _Rows, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        for label in np.unique(anchors.label):
            first, last = np.searchsorted(rows.label, [label, label + 1])
            mine = np.flatnonzero(anchors.label == label)
            if first == last:
                continue
            scores = strassen(left[mine], right[:, first:last])
            others = ~_same_row(anchors, rows)[mine][:, first:last]
            r, c = heap(scores, others, positives)
            yield pa.RecordBatch.from_arrays(
                [anchors.table["key"].combine_chunks().take(pa.array(mine[r])), _ids(rows, first + c), pa.array(scores[r, c])],
                names=["key", "found", "score"],
            )

    order = (F.col("score").desc(), F.col("found").asc_nulls_last())
    first = Window.partitionBy("key").orderBy(*order)
    found = (
        met(chosen, best_rows, True, "key string, found long, score long")
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= positives)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("place", "found", "score"))).alias("positives"))
    )
    pairs = staged(chosen.join(found, "key"), "negative-positives")

    def best_negatives(anchors: _Rows, rows: _Rows, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        scores = strassen(left, right)
        other = anchors.label[:, None] != rows.label
        listed = anchors.table["positives"].to_pylist()
        for place in range(max(map(len, listed))):
            mine = np.array([i for i, p in enumerate(listed) if len(p) > place])
            p = [listed[i][place]["score"] for i in mine]
            least = np.array([-(-low * v // 100) for v in p])[:, None]
            most = np.array([high * v // 100 for v in p])[:, None]
            held = scores[mine]
            r, c = heap(held, other[mine] & (held >= least) & (held <= most), negatives)
            yield pa.RecordBatch.from_arrays(
                [anchors.table["key"].combine_chunks().take(pa.array(mine[r])), pa.array(np.full(len(r), place + 1, dtype=np.int32)), _ids(rows, c), pa.array(held[r, c])],
                names=["key", "place", "found", "score"],
            )

    window = Window.partitionBy("key", "place").orderBy(*order)
    negative = (
        met(pairs, best_negatives, False, "key string, place int, found long, score long")
        .withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= negatives)
    )
    positive = pairs.select("key", F.col("id").alias("anchor_id"), F.inline("positives").alias("place", "positive_id", "positive_score"))
    return negative.join(positive, ["key", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
