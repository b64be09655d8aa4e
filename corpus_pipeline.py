"""Corpus pipeline: quality, near-duplicates, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result as Parquet in the shared folder and rereads it as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obslytics.llm import decontamination, jaccard_join, packing, pii, quality
from obslytics.llm.common import read_table, stored
from obslytics.llm.queries import ARROW_ROWS

KEEP_SCORE = 0.7


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def _parcel(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns as one struct ``row``, whose names meet no column of an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("-"), *others).alias("row"))


def _unpacked(parcels: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order."""
    return parcels.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least ``KEEP_SCORE``.

    Every row is judged by its text alone: null and empty texts get the score of the features of an empty text, equal
    rows the same score; long texts are read whole.  An empty table gives no rows.  Extra columns pass through."""
    _ready(spark)
    model = quality.learnt(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    scored = quality.scored(_parcel(docs), model, keep=("doc_id", "text", "row"))
    return _unpacked(scored.where(F.col("quality_score") >= KEEP_SCORE), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id; of rows with that id the one whose text has the
    smallest hash, and of equal rows one.

    Null ids come after all others.  Null and empty texts and texts without words belong to no group and all stay.
    An empty table gives no rows.  Extra columns pass through; of rows with equal id and text any one's are kept."""
    _ready(spark)
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"), keep_key=True)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id_key"), "text_key")
    first = found.where("class is not null").groupBy("class").agg(F.min(key).alias("first")).select("first.*")
    keyed = _parcel(docs).withColumn("text_key", F.xxhash64("text")).select("*", key.alias("key"))
    keyed = keyed.select("doc_id", "text", "row", "key.*")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = ["no_id", "id_key", "text_key"]
    kept = keyed.where(words).join(first, same, "left_semi").dropDuplicates(same)
    return _unpacked(kept.unionByName(keyed.where(~words)), docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated.

    Judged by text, so ids may repeat or be null; null and empty texts stay, long texts are searched whole, equal rows
    are judged alike.  An empty table gives no rows.  Extra columns pass through."""
    _ready(spark)
    keyed = _parcel(docs).withColumn("text_key", F.xxhash64("text"))
    found = decontamination.contamination(keyed.select("text_key", "text"), read_table(spark, sf_dir, "benchmark"), id_col="text_key")
    # written first: Spark then knows its size, broadcasts it where it is small and else joins by shuffle
    gone = stored(found.where("contaminated").select("text_key").distinct(), "contaminated")
    return _unpacked(keyed.join(gone, "text_key", "left_anti"), docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; ``n_chars``, where present, follows the text.

    Null texts stay null, texts without personal data stay as they are, long texts are searched whole, equal rows are
    redacted alike.  An empty table gives no rows.  Extra columns pass through."""
    _ready(spark)
    found = pii.detected(_parcel(docs), keep=("doc_id", "text", "row"))
    text = F.when(F.col("text").isNotNull(), pii.redacted(F.col("pii_text"), F.col("all")))
    row = F.col("row")
    if "n_chars" in docs.columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.size("all") > 0, length).otherwise(F.col("row.n_chars")))
    return _unpacked(found.select("doc_id", text.alias("text"), row.alias("row")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in the training sequences.

    Null and empty texts give the end id alone; long texts are cut into pieces; equal rows, and rows with equal or null
    ids, are packed each for itself.  An empty table gives no rows.  Extra columns are not carried."""
    _ready(spark)
    return packing.packed_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", uncontaminated), ("pii", redacted),
          ("packing", packed)]

ORACLE_SQL = None  # learnt scores and placements cannot be written in SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
