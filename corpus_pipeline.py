"""From raw documents to training tokens, each stage one operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.durable import delete, ensure_checkpoint_dir
from millrace.llm import bpe, decontaminate, minhash, quality, secret_scan
from millrace.llm.queries import VOCABULARY


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards clean labelled text keeps.

    Null, empty and blank texts have nothing to score and go. Each row is judged by
    itself: repeated rows and rows of one doc_id may both stay, a null doc_id counts as
    not labelled. Without clean labels all documents with words stay.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, then of the least hash of all its columns.

    Rows are told apart by all their columns, so unlike rows of one doc_id each stay or
    go by their own text. Equal rows are one group, also without words; a null doc_id
    comes last in its group. Null and empty texts are otherwise groups of their own.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit("b"), *docs.columns).alias("b"))
    keyed = docs.withColumn(name, row)
    kept = minhash.near_duplicates(keyed, id_col=name).where("kept").select(name).distinct()
    return keyed.join(kept, name, "left_semi").dropDuplicates([name]).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together. Items
    without text match nothing, and without items all documents stay.
    """
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with a mark in the place of every secret, and n_chars to match; both stay null for a null text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit), and digests of them and of the text that they decode to.

    A row for each document, whatever its doc_id; a null or empty text has no ids.
    """
    coded = bpe.encode_decode(docs, VOCABULARY)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Sketches, randomness tests and merges aren't within SQL; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.

    Each stage but the last is written to a table in the folder of checkpoints, so none
    is computed twice and a lost executor costs a stage's tasks at most. A table is
    deleted when the next one is written; the last one stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
    return docs
