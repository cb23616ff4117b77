"""The queries on the corpus tables, one for each operator, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.durable import cut, ensure_checkpoint_dir
from millrace.llm import bpe, chat_format, decontaminate, license_scan, lm_scoring, minhash, quality, secret_scan, sql, vectors, warc

#: Where the vocabulary of op8 and the pipeline comes from.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.stupid_backoff(_table(spark, sf_dir, "documents"))
    hits = [F.get("hits", F.lit(k)).alias(name) for k, name in enumerate(("n_unseen", "n_unigram", "n_bigram", "n_trigram"))]
    return scored.select("doc_id", "n_words", *hits, F.round("log_score", 6).alias("log_score"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs are conversations 2k (chosen) and 2k + 1 (rejected)."""
    turns = _table(spark, sf_dir, "conversations").withColumn("pair_id", F.shiftright("conv_id", 1))
    odd = F.col("conv_id").bitwiseAND(F.lit(1)) == 1
    shown = lambda mask: F.concat_ws(",", F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"]))).alias(mask)
    pairs = chat_format.preferences(turns.where(~odd), turns.where(odd), "pair_id")
    return pairs.select("pair_id", "n_prompt_turns", "prompt", "chosen", shown("chosen_mask"), "rejected", shown("rejected_mask"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.sort_array(F.concat("base", "random"))).alias("spans")
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response's length is that of the chunks read back, a revisit's the one it states."""
    pages = _table(spark, sf_dir, "pages")
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    chunks = warc.read(spark, warc.write(pages, folder))
    read = F.when(F.col("record_type") == "response", F.sum(F.length("data"))).otherwise(F.max("n_bytes"))
    records = chunks.groupBy("path", "place", "record", "record_type", "refers_to").agg(read.alias("payload_bytes"), F.max_by("digest", "chunk").alias("payload_digest"))
    id_type = pages.schema["page_id"].dataType
    out = records.select(F.nullif("record", F.lit("")).cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))
    out = cut(out)
    warc.delete(spark, folder)
    return out


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"), VOCABULARY)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, language and id."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    found = license_scan.licences(docs.select(path.alias("path"), "text"))
    return found.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "licence", F.round("score", 6).alias("score"), "how", "origin")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_lm_scoring, op2_chat_formatting, op3_secret_scans, op4_minhash_near_dedup, op5_warc, op6_embedding_near_dedup, op7_benchmark_decontamination, op8_bpe_encode_decode, op9_quality_classifier, op10_license_scans]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
