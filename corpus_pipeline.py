"""A training corpus from documents: quality rules, near-duplicate removal, secret redaction, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. What a stage has read is deleted once the next
one is written; the last one's input stays, as its result is read from it.

Cases, in every stage: a null or empty text fails the quality rules, so only they meet one; a null doc_id or source is
kept as it is, in the join as its operator says; repeated rows become one in the join; texts of any length are taken
whole; columns of any name pass through, but for the last stage's own; empty documents give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe, jaccard_join, mixing, quality_rules, secret_scan
from gristmill.llm.common import ensure_checkpoint_dir, remove, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return quality_rules.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: a similarity of 0.8 or more over
    shingles of five words."""
    small_batches(spark)
    return jaccard_join.keep_first(docs, size=5, least=80, per=100)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars brought up to date."""
    small_batches(spark)
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    small_batches(spark)
    return bpe.tokenize(docs).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources", mixture), ("byte-level BPE", tokens)]

#: Suffix arrays, decoding of secrets and BPE are beyond SQL; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
