"""Species accumulation curves, by random orders and in closed form."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalwise.frames import as_list, attach, checkpoint_folder, null_safe_join, written
from shoalwise.functions.columns import log_factorial, sum_or_zero
from shoalwise.operators import ordered
from shoalwise.operators.ordered import number_line, running_in_blocks

#: exp(-x) is 0 as a double from here on.
ZERO_EXP = 746.0
#: Places of a key in one row of the written ranks, rows of taxa that a task counts at once, bytes of ranks it reads at once.
CHUNK, SLICE, READ = 4096, 1 << 22, 1 << 25


def _tows(obs: DataFrame, keys: list[str], sample: str, taxon: str, value: str) -> DataFrame:
    """One row per key, sample and taxon with its summed catch; incomplete rows dropped.

    Written once: the observations are read a single time, and what follows
    reads this much smaller table.
    """
    whole = obs.where(F.col(sample).isNotNull() & F.col(taxon).isNotNull())
    return written(whole.groupBy(*keys, sample, taxon).agg(sum_or_zero(value).alias("__n")))


def _ranks(samples: DataFrame, keys: list[str], name: Column, perm: Column, seed: int) -> DataFrame:
    """Rank of each row within its keys, by the order of md5(name-perm-seed).

    The order is repeatable and independent of partitioning.  The digest is
    uniform: its leading digits cut every key into ordered blocks of some
    ``BLOCK`` samples.  Equal names have equal ranks.
    """
    digest = F.md5(F.concat_ws("-", name, perm, F.lit(seed)).cast("binary"))
    share = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    blocks = F.ceil(F.col("__samples") / ordered.BLOCK)
    # the digest's bytes order as its digits do, in half the room
    cut = samples.withColumns({"__block": F.floor(share * blocks), "__h": F.unhex(digest)})
    return running_in_blocks(cut, keys, "__block", "__h", F.lit(1), "__rank").drop("__block", "__h", "__samples")


def _write_ranks(placed: DataFrame, permutations: int, seed: int) -> str:
    """Write the ranks in every permutation, a column each; returns the folder.

    A row holds the samples of ``CHUNK`` successive places of a key, four bytes
    a sample and permutation.
    """
    perms = placed.select(
        "__key", "__place", "__name", "__samples", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("__perm")
    )
    ranked = _ranks(perms, ["__key", "__perm"], F.col("__name"), F.col("__perm"), seed).select(
        "__key", F.floor(F.col("__place") / CHUNK).cast("int").alias("__chunk"),
        (F.col("__place") % CHUNK).cast("int").alias("__at"), F.col("__perm").cast("int"), F.col("__rank").cast("int"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, table = None, np.zeros((permutations, CHUNK), "<i4")

        def row() -> pd.DataFrame:
            return pd.DataFrame([{"__key": current[0], "__chunk": current[1]} | {f"p{i + 1}": r.tobytes() for i, r in enumerate(table)}])

        for batch in batches:
            key, chunk = batch["__key"].to_numpy(), batch["__chunk"].to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for low, high in zip([0, *change], [*change, len(batch)], strict=True):
                if low == high:
                    continue
                if current != (here := (int(key[low]), int(chunk[low]))):
                    if current is not None:
                        yield row()
                    current, table = here, np.zeros((permutations, CHUNK), "<i4")
                part = batch.iloc[low:high]
                table[part["__perm"].to_numpy() - 1, part["__at"].to_numpy()] = part["__rank"].to_numpy()
        if current is not None:
            yield row()

    together = ranked.repartition("__key", "__chunk").sortWithinPartitions("__key", "__chunk")
    schema = ", ".join(["__key long", "__chunk int", *[f"p{i + 1} binary" for i in range(permutations)]])
    packed = together.mapInPandas(pack, schema)
    folder = f"{checkpoint_folder(placed.sparkSession)}/ranks-{uuid.uuid4().hex}"
    # small row groups: a reader skips those of other keys
    groups = {"parquet.block.size": str(4 * 4 * CHUNK * permutations), "parquet.page.size.row.check.min": "1"}
    packed.write.options(**groups, compression="none").parquet(folder)
    return folder


class RankColumns:
    """The ranks that :func:`_write_ranks` wrote, read some permutations of a key at a time."""

    def __init__(self, folder: str, permutations: int, chunk: int, most: int):
        from pyarrow import dataset, fs

        system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.table = dataset.dataset(path, filesystem=system, format="parquet")
        self.permutations, self.chunk, self.most = permutations, chunk, most

    def places(self, key: int) -> int:
        """Places of a key, to the end of the last row."""
        from pyarrow import dataset

        chunks = self.table.to_table(columns=["__chunk"], filter=dataset.field("__key") == key)
        return self.chunk * (1 + max(chunks["__chunk"].to_pylist()))

    def read(self, key: int, places: int) -> Iterator[np.ndarray]:
        """Per permutation the ranks by place, at most ``most`` bytes or one permutation in memory."""
        from pyarrow import dataset

        some = max(1, self.most // (4 * places))
        for first in range(1, self.permutations + 1, some):
            names = [f"p{i}" for i in range(first, min(first + some, self.permutations + 1))]
            ranks = np.zeros((len(names), places), "<i4")
            scanner = self.table.scanner(
                columns=["__chunk", *names], filter=dataset.field("__key") == key, batch_size=8, batch_readahead=1,
                fragment_readahead=1, use_threads=False,
            )
            for batch in scanner.to_batches():
                for row, chunk in enumerate(batch.column(0).to_pylist()):
                    for i in range(len(names)):
                        ranks[i, chunk * self.chunk : (chunk + 1) * self.chunk] = np.frombuffer(batch.column(i + 1)[row].as_buffer(), "<i4")
            yield from ranks


def _first_ranks(cells: DataFrame, folder: str, permutations: int) -> DataFrame:
    """Per key and rank, in how many permutations some taxon is first met there, summed over the taxa.

    ``cells`` stand by key and taxon, ``__new`` marking a taxon's first row.  A
    task holds the places of ``SLICE`` of them, a taxon never cut, and the
    ranks of a key in a few permutations.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = RankColumns(folder, permutations, CHUNK, READ)
        key, width, held, size = None, 0, [], 0

        def count(places: np.ndarray, starts: np.ndarray) -> Iterator[pd.DataFrame]:
            places, met = places.astype(np.intp), np.zeros(width + 1, np.int64)
            for column in ranks.read(key, width):
                met += np.bincount(np.minimum.reduceat(column[places], starts), minlength=width + 1)
            at = np.flatnonzero(met)
            for low in range(0, len(at), 100_000):
                k = at[low : low + 100_000]
                yield pd.DataFrame({"__key": key, "k": k, "__new": met[k]})

        def flush(last: bool) -> Iterator[pd.DataFrame]:
            """Count what is held; the last taxon waits if more of it may come."""
            nonlocal held, size
            places, new = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            starts = np.flatnonzero(new)
            end = len(places) if last else int(starts[-1])
            if end:
                yield from count(places[:end], starts[starts < end])
            held, size = ([], 0) if last else ([(places[end:], new[end:])], len(places) - end)

        for batch in batches:
            keys = batch["__key"].to_numpy()
            change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for low, high in zip([0, *change], [*change, len(batch)], strict=True):
                if low == high:
                    continue
                if keys[low] != key:
                    if held:
                        yield from flush(True)
                    key = int(keys[low])
                    width = ranks.places(key)
                part = batch.iloc[low:high]
                held.append((part["__place"].to_numpy(np.int32), part["__first"].to_numpy(bool)))
                size += high - low
                if size >= SLICE:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return cells.mapInPandas(run, "__key long, k long, __new long").groupBy("__key", "k").agg(F.sum("__new").alias("__new"))


def accumulation(
    obs: DataFrame,
    keys: str | Sequence[str],
    sample: str = "sample_id",
    taxon: str = "taxon",
    value: str = "cpue",
    permutations: int = 100,
    seed: int = 1,
) -> DataFrame:
    """Mean number of taxa in the first k samples over random sample orders.

    Observations carry no ranks through a shuffle, only the place of their
    sample within the key, four bytes.  The ranks stand in the shared folder, a
    column per permutation; a task that has some taxa of a key reads the
    columns a few at a time, and a taxon's first discovery is the least rank at
    its places.  The mean curve then needs only the count of discoveries per
    key and rank.  A sample whose catch is all zero still counts as a sample.
    """
    keys = as_list(keys)
    tows = _tows(obs, keys, sample, taxon, value)
    samples = tows.groupBy(*keys, sample).agg(F.count_if(F.col("__n") > 0).alias("__cells"))
    sizes = written(
        samples.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__samples"), F.coalesce(F.sum("__cells"), F.lit(0)).alias("__cells"))
        .withColumn("__key", F.monotonically_increasing_id())
    )
    known = sizes.select(*keys, "__key", "__samples", F.ceil((F.col("__cells") + 1) / SLICE).alias("__parts"))
    named = attach(samples.select(*keys, sample), known, keys).withColumn("__name", F.col(sample).cast("string"))
    # any order would do for the places; samples of one name have one place, and one rank in all permutations
    spots = _ranks(named.withColumn("__size", F.col("__samples")), ["__key"], F.col("__name"), F.lit(0), seed)
    placed = written(
        spots.select(
            *keys, sample, "__key", "__name", "__parts", F.col("__size").alias("__samples"),
            (F.col("__rank") - 1).alias("__place"),
        )
    )
    folder = _write_ranks(placed, permutations, seed)
    present = tows.where(F.col("__n") > 0).select(*keys, sample, F.col(taxon).alias("__taxon"))
    cells = null_safe_join(
        present, placed.select(*keys, sample, "__key", "__parts", F.col("__place").cast("int")), [*keys, sample]
    ).select("__key", "__place", "__taxon", F.pmod(F.xxhash64("__taxon"), "__parts").alias("__part"))
    by_taxon = Window.partitionBy("__key", "__part", "__taxon").orderBy("__place")
    ready = cells.repartition("__key", "__part").withColumn("__first", F.row_number().over(by_taxon) == 1)
    discovered = written(_first_ranks(ready.select("__key", "__place", "__first"), folder, permutations))
    line = number_line(sizes, [*keys, "__key"], "__samples", "k").select(*keys, "__key", "__block", "k")
    steps = line.join(discovered, ["__key", "k"], "left").withColumn("__new", F.coalesce("__new", F.lit(0)))
    curve = running_in_blocks(steps, ["__key"], "__block", "k", F.col("__new"), "__total")
    return curve.select(*keys, F.col("k").cast("long").alias("k"), (F.col("__total") / permutations).alias("richness"))


def rarefaction(
    obs: DataFrame,
    keys: str | Sequence[str],
    sample: str = "sample_id",
    taxon: str = "taxon",
    value: str = "cpue",
    tolerance: float = 0.0,
) -> DataFrame:
    """Expected number of taxa in k random samples, without any randomness.

    With m of N samples holding a taxon, the chance to miss it in k samples is
    C(N-m, k) / C(N, k) <= exp(-k m / N).  Taxa are grouped by m.  Terms that
    are 0 as a double (k m > 746 N) are left out, which changes nothing: for
    all m together some 746 N log N terms are left.  With a ``tolerance`` terms
    below it are left out too, so a value is too high by at most tolerance
    times the number of taxa.
    """
    keys = as_list(keys)
    tows = _tows(obs, keys, sample, taxon, value)
    sizes = tows.select(*keys, sample).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__samples"))
    found = tows.where(F.col("__n") > 0).groupBy(*keys, taxon).agg(F.count(F.lit(1)).alias("__m"))
    same = found.groupBy(*keys, "__m").agg(F.count(F.lit(1)).alias("__taxa"))
    taxa = same.groupBy(*keys).agg(F.sum("__taxa").alias("__all"))
    n, m, k = F.col("__samples"), F.col("__m"), F.col("k")
    farthest = -math.log(tolerance) if tolerance > 0 else ZERO_EXP
    end = F.least(n - m, F.ceil(F.try_divide(F.lit(farthest) * n, m)))
    reach = attach(same, sizes, keys).withColumn("__reach", end)
    spread = number_line(reach, [*keys, "__m"], "__reach", "k")
    log_miss = log_factorial(n - m) - log_factorial(n - m - k) - log_factorial(n) + log_factorial(n - k)
    missed = spread.groupBy(*keys, "k").agg(F.sum(F.col("__taxa") * F.exp(log_miss)).alias("__missed"))
    line = number_line(sizes, keys, "__samples", "k").select(*keys, "k")
    curve = attach(null_safe_join(line, missed, [*keys, "k"], "left"), taxa, keys)
    return curve.select(
        *keys,
        F.col("k").cast("long").alias("k"),
        (F.coalesce("__all", F.lit(0)) - F.coalesce("__missed", F.lit(0.0))).alias("richness"),
    )
