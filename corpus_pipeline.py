"""Preparing a training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame,
which is written as Parquet in the shared folder and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwise.llm import decontam, mixing, private, simhash, toxicity
from shoalwise.llm.common import shipped, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold of toxicity; the model learns from ``labels``. All columns stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints within 4 bits: the smallest doc_id. All columns stay."""
    return simhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one in 20 words lies in a window of ``benchmark``. All columns stay."""
    items = decontam.Benchmark(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontam.decontaminate(docs, items)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in their texts become ``[kind]``, and ``n_chars`` is that of the new text."""
    masked = docs.withColumn("text", private.redacted("text", private.train(docs)))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(kind))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each (``taken``, repeats counted, at most twice its size).

    Adds size, source_size, target and taken; columns of these names in the
    input are replaced.
    """
    added = ("size", "source_size", "target", "taken")
    rows = docs.drop(*added)
    return mixing.with_taken(rows, mixing.Mix(rows)).select(*rows.columns, *added)


STAGES = [
    ("toxicity", shipped(drop_toxic)),
    ("near_duplicates", shipped(drop_near_duplicates)),
    ("decontamination", shipped(drop_contaminated)),
    ("private_data", shipped(mask_private)),
    ("mixing", shipped(mix_sources)),
]

#: SQL can express neither the learnt stages nor the fingerprints; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
