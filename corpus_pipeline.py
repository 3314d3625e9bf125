"""A corpus pipeline: quality rules, near-duplicates, benchmark items, secrets, tokens.

Every stage works on all that the one before it kept, and its decisions take
effect. Results of a stage are written as Parquet and read again, so a lost
executor never costs more than the stage it was lost in.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketclime.llm import bpe, contamination, minhash, quality, secrets
from marketclime.llm.columns import shielded
from marketclime.session import scratch_path

RANKS = "byte_bpe_50k.tiktoken"
NEAR_PERCENT = 80  # similarity from which documents are near-duplicates; op8 by itself takes 85


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id."""
    return minhash.keep_one(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return contamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars set anew where there were some."""

    def masked(rows: DataFrame) -> DataFrame:
        found = secrets.redact(secrets.find_secrets(rows, into="_secrets"), secrets="_secrets")
        changed = F.when(F.size("_secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return found.withColumn("n_chars", changed)

    return shielded(docs, ("text", "n_chars"), masked)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text decoded from them."""
    coded = bpe.code_bpe(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_bpe),
]

ORACLE_SQL = None  # neither the quality model, MinHash nor BPE can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
