"""Positions and running totals within a key that may be too large for one task.

A plain window over a key sorts the whole key in one task.  These helpers cut
each key into ordered blocks, work inside the blocks, and carry only one row
per block across them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwise.frames import as_list, durable, null_safe_join

BLOCK = 4096


def running_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: str,
    value: Column,
    out: str,
    how: Literal["sum", "max"] = "sum",
) -> DataFrame:
    """Running sum or maximum of ``value`` over ``order`` within each key; ties are included.

    ``block`` must never decrease as ``order`` grows, and must be the same each
    time it is computed.
    """
    keys = as_list(keys)
    fold = F.sum if how == "sum" else F.max
    inside = Window.partitionBy(*keys, block).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", fold(value).over(inside))
    carried = (
        df.groupBy(*keys, block)
        .agg(fold(value).alias("__v"))
        .select(*keys, block, fold("__v").over(earlier).alias("__before"))
    )
    joined = null_safe_join(local, carried, [*keys, block])
    if how == "sum":
        total = F.col("__local") + F.coalesce("__before", F.lit(0))
    else:
        total = F.greatest("__local", "__before")
    return joined.withColumn(out, total).drop("__local", "__before")


def position(df: DataFrame, keys: Sequence[str], index: str, out: str = "position") -> DataFrame:
    """Position 1..n of each row in the order of a whole-number index, unique per key.

    Blocks are runs of the index, so none has more than ``BLOCK`` rows.
    """
    blocked = df.withColumn("__block", F.floor(F.col(index) / BLOCK))
    return running_in_blocks(blocked, keys, "__block", index, F.lit(1), out).drop("__block")


def number_line(sizes: DataFrame, keys: Sequence[str], size: str, out: str) -> DataFrame:
    """Rows 1..size per key, made block by block."""
    keys = as_list(keys)
    last = F.col(size)
    blocks = sizes.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int"))))
    first = F.col("__block").cast("long") * BLOCK
    low, high = F.greatest(first, F.lit(1)), F.least(first + (BLOCK - 1), last)
    # the last block is empty when the size is 0
    return blocks.repartition(*keys, "__block").where(low <= high).withColumn(out, F.explode(F.sequence(low, high)))


def cumulative_weights(
    df: DataFrame, keys: Sequence[str], order: str, weight: str, out: str = "upto"
) -> DataFrame:
    """Running total of ``weight`` in the order of any column, one row per value.

    The rows are range partitioned over (keys, order); the partition number is
    the block.  It is written to the checkpoint folder before it is used twice.
    """
    keys = as_list(keys)
    rows = df.groupBy(*keys, order).agg(F.sum(weight).alias(weight))
    ranged = durable(rows.repartitionByRange(*keys, order).withColumn("__block", F.spark_partition_id()))
    return running_in_blocks(ranged, keys, "__block", order, F.col(weight), out).drop("__block")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles (the R default) per key, one column each.

    Exact without holding a key's values in one buffer: the two order
    statistics next to each probability are picked from running counts.
    ``weight`` is a count of equal rows.
    """
    keys = as_list(keys)
    count = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("__x"), count.alias("__n")
    )
    upto = cumulative_weights(rows, keys, "__x", "__n", "__upto")
    sizes = upto.groupBy(*keys).agg(F.max("__upto").alias("__size"))
    placed = null_safe_join(upto, sizes, keys) if keys else upto.withColumn("__size", sizes.select("__size").scalar())
    before = F.col("__upto") - F.col("__n")
    picks = []
    for i, p in enumerate(probabilities):
        spot = (F.col("__size") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        for name, at in ((f"__lo{i}", low), (f"__hi{i}", high)):
            picks.append(F.max(F.when((at >= before) & (at < F.col("__upto")), F.col("__x"))).alias(name))
        picks.append(F.max(spot - low).alias(f"__f{i}"))
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"__lo{i}") + F.col(f"__f{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(f"q{i}")
            for i in range(len(probabilities))
        ],
    )
