"""The registered queries of this folder; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalwise.llm import chats, decontam, katz, licenses, mixing, negatives, private, repair, simhash, tokencount, topk, toxicity, warc
from shoalwise.llm.common import crc_remainder, shipped


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Formatted conversations, read back; conversation -1 says the template's own marks."""
    said = "<|im_end|><|im_start|>assistant ok"
    marked = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    return chats.read_back(chats.format_chats(turns), in_order=True).drop("n_tokens", "loss_tokens")


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and notices of every document."""
    found = licenses.license_scan(_table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A record per page, written, then looked up by its URL in the two-level index and read back."""
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    archive = warc.write_archive(pages)
    read = warc.look_up(archive, pages, payloads=False, exact=True)
    # a revisit's bytes are those of the response it names
    whole = (
        read.where("record_type = 'response' AND page_id IS NOT NULL")
        .groupBy(F.col("page_id").alias("first_id"), F.col("payload_digest").alias("first_digest"))
        .agg(F.max("http_bytes").alias("first_bytes"))
    )
    same = (F.col("refers_to") == F.col("first_id")) & (F.col("payload_digest") == F.col("first_digest"))
    return read.join(whole, same, "left").select(
        "page_id",
        F.coalesce("http_bytes", "first_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """What every document has of the benchmark, by suffix arrays of the documents."""
    bench = decontam.Benchmark(_table(spark, folder, "benchmark"))
    docs = _table(spark, folder, "documents")
    found = docs.select("doc_id", decontam.contamination("text", bench).alias("found"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("found")).alias("contaminated"),
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal("print").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_documents(_table(spark, folder, "documents"))


def op2_private(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: exact patterns and what the random field adds."""
    docs = _table(spark, folder, "documents")
    field = private.train(docs)
    found = docs.select("doc_id", private.find_private("text", field).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in private.KINDS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, folder, "documents")
    model = toxicity.train(docs, _table(spark, folder, "labels"))
    scored = docs.select(
        "doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), toxicity.score("text", model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under a Katz model of the training documents."""
    return katz.score_documents(_table(spark, folder, "documents"))


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20, its whole text as the query."""
    docs = _table(spark, folder, "documents")
    return topk.search(docs, docs.where(F.col("doc_id") % 20 == 0), k=10)


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor, a row whose id is divisible by 100; labels of ids divisible by 7 are moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.prepared(_table(spark, folder, "embeddings"), "vec_id", moved, "embedding")
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = _table(spark, folder, "documents")
    counted = docs.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        tokencount.token_count(docs).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op13_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage is planted."""
    turns = _table(spark, folder, "conversations")
    return repair.repair_digests(turns.select("conv_id").distinct(), repair.repair_conversations(repair.damaged(turns)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f)
    for f in (
        op1_chats,
        op2_private,
        op3_licenses,
        op4_toxicity,
        op5_warc,
        op6_decontamination,
        op7_simhash,
        op8_mixing,
        op9_katz,
        op10_topk,
        op11_negatives,
        op12_tokens,
        op13_repair,
    )
}
