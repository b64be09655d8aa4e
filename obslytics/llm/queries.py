"""The registered queries over the synthetic corpus: each applies one operator to its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslytics.llm import decontamination, embedding_dedup, hard_negatives, jaccard_join, license_scan, packing, periodic_runs
from obslytics.llm import pii, quality, sharding, suffix_dedup, token_store, warc
from obslytics.llm.common import read_table

#: rows of an Arrow batch: whole texts are long, and a Python worker holds a batch at a time
ARROW_ROWS = "2000"


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.learnt(docs, read_table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, keep=("doc_id",)).select(
        "doc_id", F.coalesce(quality.remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_rows(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"), license_scan.templates_frame(spark))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), keep_text=True)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def with_planted_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the periodic runs are sought in: a tenth of the documents, chosen by id, end in repeats."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    first = g % len(words)
    rest = len(words) - first
    period = 1 + rest // (3 + g % 8)
    return words[:first] + (words[first: first + period] * -(-rest // period))[:rest]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents"), changed=with_planted_repeats)


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.written_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(vectors.withColumn("label", label), F.col("id") % 50 == 0)


def prepared(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return fn(spark, sf_dir)
    return run


QUERIES = {name: prepared(fn) for name, fn in {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_store": op12_token_store,
    "op13_hard_negatives": op13_hard_negatives,
}.items()}

SQL: dict[str, str] = {"op3_license_scan": license_scan.sql(), "op13_hard_negatives": hard_negatives.sql()}
