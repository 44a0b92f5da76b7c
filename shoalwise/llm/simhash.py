"""Near duplicates by SimHash fingerprints, linked through multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shoalwise.llm.common import spaced_words, staged, text_bytes, unused

BITS = 64
SEED = 42


def simhash(words: list[bytes], shingle: int) -> int:
    """Fingerprint of a text's words: a bit is set where over half of the shingles' XXH64 have it."""
    import xxhash

    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[n - 1 :], strict=False)]
    counts = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 1 << 16):
        octets = values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<i8")[0])


def fingerprint(text: str | Column, shingle: int = 4) -> Column:
    """SimHash of a text's word shingles as a signed long; NULL and empty texts have 0."""

    @pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([simhash(spaced_words(bytes(t)), shingle) for t in batch], dtype="int64")

    return fingerprints(text_bytes(text))


def segments(distance: int, n: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of ``n`` segments of the fingerprint.

    The radii with one each added sum to ``distance + 1``: were every segment
    further apart than its radius, the whole would differ in more than
    ``distance`` bits.  So each link is inside the radius in some segment.
    """
    cuts = [BITS * i // n for i in range(n + 1)]
    spare = distance + 1 - n
    if spare < 0:
        raise ValueError("more segments than differing bits + 1")
    radii = [spare // n + (i < spare % n) for i in range(n)]
    return [(a, b - a, r) for a, b, r in zip(cuts, cuts[1:], radii, strict=False)]


def ball(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def links(prints: DataFrame, distance: int = 4, n_segments: int = 3) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in at most ``distance`` bits, each once.

    ``prints`` has one column ``print`` without repeats.  Every fingerprint
    goes into one table per segment, and looks up the small Hamming ball of
    its own segment there; a candidate counts if the complete distance fits and
    no earlier segment gives it too.  The tables' keys are 21 bits wide with
    three segments; take two (32 bits, larger balls) above some 2^24
    fingerprints.  The result is the same for any number of segments.
    """
    parts = segments(distance, n_segments)
    value = [F.shiftrightunsigned("print", s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w, _ in parts]
    table = prints.select(
        F.col("print").alias("b"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), v.alias("value")) for i, v in enumerate(value)])).alias("at"),
    ).select("b", "at.*")
    around = [
        F.struct(F.lit(i).alias("segment"), v.bitwiseXOR(F.lit(m).cast("long")).alias("value"))
        for i, (v, (_, w, r)) in enumerate(zip(value, parts, strict=True))
        for m in ball(w, r)
    ]
    probes = prints.select(F.col("print").alias("a"), F.explode(F.array(*around)).alias("at")).select(
        "a", F.col("at.segment").alias("p_segment"), F.col("at.value").alias("p_value")
    )
    apart = F.col("a").bitwiseXOR(F.col("b"))
    later = F.lit(True)
    for i, (s, w, r) in enumerate(parts):
        inside = F.bit_count(F.shiftrightunsigned(apart, s).bitwiseAND(F.lit((1 << w) - 1).cast("long"))) <= r
        later = later & ((F.col("segment") <= i) | ~inside)
    same = (F.col("segment") == F.col("p_segment")) & (F.col("value") == F.col("p_value"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(apart) <= distance) & later
    return probes.join(table, same & close).select("a", "b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach, by alternating stars.

    Each round hangs nodes under the smallest neighbour (large star), then
    under the smallest of those not larger (small star); the rounds end when
    nothing changes.  Only minima are aggregated and joined back, so a node
    with very many neighbours is never gathered; every round is written to the
    shared folder.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges"
    )
    before = None
    while True:
        sides = both(state)
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        down = large.join(lower, F.col("u") == F.col("k"))
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        state = staged(small.where("u > v").distinct(), "edges")
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    n_segments: int = 3,
) -> DataFrame:
    """doc_id, print (signed long), root and component_id of every row.

    Documents link at ``distance`` or fewer differing bits of their
    fingerprints; root is the smallest fingerprint reachable and component_id
    the smallest doc_id there.  Equal fingerprints are one node, so copies are
    never paired.  NULL and empty texts have fingerprint 0 and link like
    others.  A NULL doc_id is never a component_id unless all of the component
    are NULL; repeated rows stay.  Empty input gives no rows, other columns
    are ignored.
    """
    rows = staged(docs.select(F.col(key).alias("doc_id"), fingerprint(text, shingle).alias("print")), "prints")
    nodes = staged(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    pairs = links(nodes.select("print"), distance, n_segments)
    roots = components(pairs)
    placed = nodes.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    classes = placed.join(named, F.col("root") == F.col("r")).select(F.col("print").alias("p"), "root", "component_id")
    return rows.join(classes, F.col("print") == F.col("p")).select("doc_id", "print", "root", "component_id")


def hexadecimal(print_: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    n_segments: int = 3,
) -> DataFrame:
    """One row of each class of near duplicates, with all columns.

    The row with the smallest id stays, NULL ids last; of rows with equal ids
    the one whose columns hash lowest, so reruns agree.
    """
    row, at, missing, first_id, first_hash = unused(docs, "row", "at", "missing", "first_id", "first_hash")
    order = F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(*docs.columns))
    prints = docs.select(order.alias("o"), fingerprint(text, shingle).alias("print"))
    firsts = staged(prints.groupBy("print").agg(F.min("o").alias("o")), "firsts")
    roots = components(links(firsts.select("print"), distance, n_segments))
    placed = firsts.join(roots, F.col("print") == F.col("node"), "left")
    kept = placed.groupBy(F.coalesce("root", "print")).agg(F.min("o").alias("o")).select("o.*")
    kept = kept.toDF(missing, first_id, first_hash)
    hashed = docs.withColumn(row, F.xxhash64(*docs.columns))
    found = hashed.join(kept, (F.col(row) == F.col(first_hash)) & F.col(key).eqNullSafe(F.col(first_id)), "left_semi")
    # rows that repeat in every column: one stays; the join has dealt them by the same hash already
    first = F.row_number().over(Window.partitionBy(row, key).orderBy(row))
    return found.withColumn(at, first).where(F.col(at) == 1).drop(row, at)
