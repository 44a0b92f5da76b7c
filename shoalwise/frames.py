"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_list(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else list(names)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the left keys are kept."""
    aliases = {k: f"__right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(aliases)
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[a]) for k, a in aliases.items()])
    return left.join(renamed, on, how).drop(*aliases.values())


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put the one-row-per-key columns of ``stats`` next to every row of ``df``.

    Without keys ``stats`` is a single row, and it enters as a scalar subquery.
    No broadcast is forced: Spark broadcasts ``stats`` when its measured size
    allows and splits hot keys of ``df`` by the adaptive skew join otherwise.
    """
    if keys:
        return null_safe_join(df, stats, keys, "left")
    names = stats.columns
    packed = stats.select(F.struct(*names).alias("s")).scalar()
    whole = df.withColumn("__stats", packed)
    return whole.select(*df.columns, *[F.col("__stats")[n].alias(n) for n in names])


def lookup(df: DataFrame, dimension: DataFrame, on: str | dict[str, str], how: str = "left") -> DataFrame:
    """Join a dimension whose key must be unique.

    ``on`` is a shared column name or ``{fact column: dimension column}``.  A
    duplicate key raises while the job runs instead of multiplying rows.
    """
    pairs = {on: on} if isinstance(on, str) else dict(on)
    dim_keys = list(pairs.values())
    rest = [c for c in dimension.columns if c not in dim_keys]
    unique = dimension.groupBy(*dim_keys).agg(
        F.count(F.lit(1)).alias("__copies"), *[F.any_value(c).alias(c) for c in rest]
    )
    unique = unique.where(
        F.when(F.col("__copies") == 1, F.lit(True)).otherwise(
            F.raise_error(F.lit("lookup key is not unique in the dimension table")).cast("boolean")
        )
    ).drop("__copies")
    renamed = unique.withColumnsRenamed({d: f"__dim_{d}" for d in dim_keys})
    cond = [F.col(f) == F.col(f"__dim_{d}") for f, d in pairs.items()]
    return df.join(renamed, cond, how).drop(*[f"__dim_{d}" for d in dim_keys])


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables that the session names."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        durable(spark.range(1))  # names the folder
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Like :func:`durable`, as Parquet files in the same folder, for tables that a fit makes again and again.

    A checkpoint hands Spark's optimiser the constraints of the plan behind
    it, which multiply from one iteration to the next; files have none.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the checkpoint folder the session names.

    Used before a frame is read more than once where both reads must see the
    same rows, or read repeatedly by an iterative fit.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="shoalwise-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
