"""Mixing sources to target weights along a low-discrepancy schedule.

A golden-ratio sequence is mapped through the cumulative quotas of the
sources: slot by slot it names the source whose turn it is, so that every
stretch of the schedule has the sources in their shares.  A slot's rank within
its source is the number of the block it takes.  Blocks are equal runs of
words of the source's documents in shuffled order, passed through as often as
the target needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwise.frames import null_safe_join
from shoalwise.llm.common import spaced_word_count, staged, unused
from shoalwise.operators.ordered import running_in_blocks

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes.
SHARE = 1.5
#: No target is above so many times its source's size.
MOST = 2
#: Words in a block.
BLOCK_WORDS = 512
#: Step of the golden-ratio sequence (a fixed value).
GOLDEN = 0.6180339887498949
#: Slots, and stream entries on average, that are ranked together.
CHUNK, STREAM_CHUNK = 1 << 14, 1 << 10


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Number, weight and target of each source; ``sizes`` has (source, source_size), one row per source.

    Sources are numbered by code point, NULL last.  The level that the
    uncapped ones share per weight rises until none is above its cap; each
    step is one aggregate over the sources and brings two numbers back.
    """
    order = F.struct(F.col("source").isNull().alias("missing"), "source")
    keyed = sizes.withColumn("place", order)
    ranged = staged(keyed.repartitionByRange("place").withColumn("block", F.spark_partition_id()), "sources")
    numbered = running_in_blocks(ranged, [], "block", "place", F.lit(1), "number").select(
        "source", "source_size", (F.col("number") - 1).cast("long").alias("number")
    )
    listed = F.array(*[F.lit(float(w)) for w in weights])
    table = staged(
        numbered.withColumn("weight", listed[(F.col("number") % len(weights)).cast("int")]).withColumn(
            "most", F.col("source_size") * float(most)
        ),
        "sources",
    )
    words = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("most")
        got = table.agg(
            F.count(F.when(over, 1)),
            F.sum(F.when(over, F.col("most")).otherwise(0.0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))),
        ).first()
        if got[0] == capped or not got[2]:
            break
        capped, level = got[0], max(0.0, share * words - got[1]) / got[2]
    return table.withColumn("target", F.least("most", F.col("weight") * level))


def schedule(quotas: DataFrame) -> DataFrame:
    """(slot, number, block): which source's which block comes in each slot.

    ``quotas`` has (number, blocks): how many blocks each source gives.  Point
    t of the golden-ratio sequence falls into the quotas' running total; the
    unit interval is cut into cells, so that a point meets only the sources of
    its cell.  Points for blocks beyond a source's quota are left out, and the
    few blocks that no point has reached follow at the end.
    """
    spark = quotas.sparkSession
    blocked = quotas.withColumn("part", F.floor(F.col("number") / CHUNK))
    running = staged(running_in_blocks(blocked, [], "part", "number", F.col("blocks"), "upto"), "quotas")
    count, slots = running.agg(F.count(F.lit(1)), F.sum("blocks")).first()
    slots = slots or 0
    cells = 1 << max(10, math.ceil(math.log2(2 * count + 1)))
    span = max(slots, 1)
    low, high = (F.col("upto") - F.col("blocks")) / F.lit(span), F.col("upto") / F.lit(span)
    cell = lambda at: F.least(F.floor(at * cells), F.lit(cells - 1)).cast("long")
    shares = (
        running.where("blocks > 0")
        .select("number", "blocks", low.alias("low"), high.alias("high"))
        .withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    )
    points = spark.range(slots).select(
        F.col("id").alias("slot"), (((F.col("id") + 1) * GOLDEN) % 1.0).alias("at")
    ).withColumn("point_cell", cell(F.col("at")))
    drawn = points.join(
        shares, (F.col("point_cell") == F.col("cell")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    ).select("slot", "number", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    drawn = staged(drawn, "slots")
    ranked = running_in_blocks(drawn, ["number"], "chunk", "slot", F.lit(1), "rank").select(
        "slot", "number", (F.col("rank") - 1).cast("long").alias("block"), "blocks"
    )
    reached = drawn.groupBy("number").agg(F.count(F.lit(1)).alias("reached"))
    short = null_safe_join(running, reached, ["number"], "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    rest = short.where("reached < blocks").select(
        "number", (F.col("upto") - F.col("blocks")).alias("before"), F.explode(F.sequence("reached", F.col("blocks") - 1)).alias("block")
    )
    tail = rest.select((F.lit(slots) + F.col("before") + F.col("block")).alias("slot"), "number", "block")
    return ranked.where("block < blocks").drop("blocks").unionByName(tail)


class Mix:
    """A mix of documents: its sources, its stream and its schedule.

    ``sources``: source, number, source_size, weight, target, words (the
    rounded target).  ``stream``: one row per distinct document row with its
    number of copies and the words before it in its source's shuffled order.
    ``pieces``: slot, number, block, row, first (word of the row's copies) and
    words; ordering them by slot and first_word gives the mix.

    NULL texts have size 0, a NULL source is a source of its own, NULL ids are
    ids like others.  Rows that repeat in every column are one entry of the
    stream and share its words evenly.  Empty input gives an empty mix.  Other
    columns only enter the hash that shuffles.
    """

    def __init__(
        self,
        docs: DataFrame,
        key: str = "doc_id",
        text: str = "text",
        source: str = "source",
        weights: Sequence[float] = WEIGHTS,
        share: float = SHARE,
        most: float = MOST,
        block_words: int = BLOCK_WORDS,
        seed: int = 8,
    ):
        self.seed = seed
        rows = staged(
            docs.select(
                F.col(key).alias("key"),
                F.col(source).cast("string").alias("source"),
                spaced_word_count(text).alias("size"),
                row_hash(docs, seed).alias("row"),
            )
            .groupBy("key", "source", "size", "row")
            .agg(F.count(F.lit(1)).alias("copies")),
            "rows",
        )
        sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
        targets = source_targets(sizes, weights, share, most)
        self.sources = staged(targets.withColumn("words", F.floor(F.col("target") + 0.5).cast("long")), "targets")
        quotas = self.sources.select("number", F.ceil(F.col("words") / block_words).cast("long").alias("blocks"))
        self.schedule = staged(schedule(quotas), "schedule")

        # the shuffled order: blocks of the hash hold some STREAM_CHUNK rows each, whatever the source
        parts = rows.count() // STREAM_CHUNK + 1
        place = F.shiftrightunsigned("row", 1)
        hashed = rows.withColumn("part", F.floor(place / F.lit(2.0**63) * parts)).withColumn(
            "place", F.struct(place.alias("hash"), "row", "key", "size")
        )
        words = F.col("size") * F.col("copies")
        running = running_in_blocks(hashed, ["source"], "part", "place", words, "upto")
        placed = null_safe_join(running, self.sources, ["source"]).withColumn("before", F.col("upto") - words)
        self.stream = staged(
            placed.select("key", "source", "number", "size", "copies", "row", "before", "source_size", "target", "words"),
            "stream",
        )
        rounds = F.array(*[F.lit(i) for i in range(math.ceil(most))])
        passed = self.stream.where("size > 0").withColumn("round", F.explode(rounds))
        start = F.col("round") * F.col("source_size") + F.col("before")
        cut = passed.withColumn("start", start).withColumn(
            "end", F.least(F.col("words"), F.col("start") + F.col("size") * F.col("copies"))
        )
        blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))
        cut = cut.where("start < end").withColumn("block", F.explode(blocks))
        first = F.greatest("start", F.col("block") * block_words)
        last = F.least("end", (F.col("block") + 1) * block_words)
        pieces = cut.select(
            "number", "block", "row", "key", "size", (first - F.col("start")).alias("first"), (last - first).alias("words")
        )
        self.pieces = pieces.join(self.schedule, ["number", "block"])

    def taken(self) -> DataFrame:
        """The stream with ``taken``: the words that the mix takes of each entry, repeats counted."""
        sums = self.pieces.groupBy("number", "row", "key", "size").agg(F.sum("words").alias("taken"))
        joined = null_safe_join(self.stream, sums, ["number", "row", "key", "size"], "left")
        return joined.withColumn("taken", F.coalesce("taken", F.lit(0)))


def row_hash(docs: DataFrame, seed: int) -> Column:
    """Hash of all columns of a row."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in docs.columns])


def share_of(copy: Column, copies: str = "copies") -> Column:
    """Words that the ``copy``-th (from 1) of equal rows has of its entry's ``taken``."""
    even = F.floor(F.col("taken") / F.col(copies))
    return (even + F.when(copy <= F.col("taken") % F.col(copies), 1).otherwise(0)).cast("long")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    every = Mix(docs, **options).taken().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return every.select(F.col("key").alias("doc_id"), "size", "source_size", "target", share_of(F.col("copy")).alias("taken"))


def with_taken(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows``, which the mix was made of, with size, source_size, target and what the mix takes of each.

    The join deals the rows by the hash; equal rows are then numbered where they are.
    """
    row, copy, copies = unused(rows, "row", "copy", "copies")
    amounts = mix.taken().select(
        F.col("row").alias(row), "size", "source_size", "target", "taken", F.col("copies").alias(copies)
    )
    found = rows.withColumn(row, row_hash(rows, mix.seed)).join(amounts, row)
    number = F.row_number().over(Window.partitionBy(row).orderBy(row))
    taken = found.withColumn(copy, number).withColumn("taken", share_of(F.col(copy), copies))
    return taken.drop(row, copy, copies)
