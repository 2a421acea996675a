"""The registered queries op1 to op13: each operator over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import scratch_path

from . import ann, exact_dedup, fingerprints, hard_negatives, mixing, near_dedup, packing, quality, repeats, sharding, url_filter, warc, whitening

#: The rules of the url query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SHARDS = 8
#: Bounds what one batch takes to a Python task, however long the texts are.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.size_of("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.assign_shards(rows, SHARDS, "doc_id", "size", ["text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm", f"warc-{uuid.uuid4().hex}")
    warc.write(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.nullif(F.regexp_extract(c, rf"^<{warc.ID_PREFIX}(.*)>$", 1), F.lit("")).cast("long")
    own = F.col("record_type") == "response"
    return warc.read(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes",
        F.when(own, warc.base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sampler = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, sampler, "doc_id", "text").select(
        F.col("id").alias("doc_id"), "log_weight", "key", (F.col("key") >= F.lit(sampler.least)).alias("kept"))


def repeats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_rules": url_rules,
    "op2_packing": packing_query,
    "op3_mixing": mixing_query,
    "op4_sharding": sharding_query,
    "op5_warc": warc_query,
    "op6_quality": quality_query,
    "op7_nearest": nearest_query,
    "op8_near_dedup": near_dedup_query,
    "op9_repeats": repeats_query,
    "op10_exact_dedup": exact_dedup_query,
    "op11_fingerprints": fingerprints_query,
    "op12_whitening": whitening_query,
    "op13_hard_negatives": hard_negatives_query,
}


def bound_batches(spark: SparkSession) -> None:
    for k, v in ARROW.items():
        spark.conf.set(k, v)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bounded(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return fn(spark, sf_dir)
        return run
    return {k: bounded(v) for k, v in QUERIES.items()}
