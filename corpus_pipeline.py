"""A training-data pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, minhash, quality_rules
from tidemark.llm.common import shared_folder, table
from tidemark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts with them; repeated rows are judged one by one."""
    return quality_rules.accepted(quality_rules.judge_quality(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; every document stays, shorter where it repeats others. Null texts and rows without doc_id stay as they are."""
    return line_dedup.remove_lines(docs, line_dedup.duplicate_lines(docs)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates stays; empty texts stay, rows without doc_id go, repeated rows stay together."""
    # two values shared in a tree: probability 0.64 at similarity 0.80, so all 16 trees miss a pair with 8e-8
    kept = minhash.near_duplicates(docs, percent=80, least_depth=2).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    marked = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.coalesce(F.size("hits"), F.lit(0)) <= 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, with digests of the ids and of the decoded bytes; a null text has no ids."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.decode(bpe.encode(docs, path), path)).select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_forest", near_duplicates), ("decontaminate", benchmark_free), ("byte_bpe", tokens)]

#: The near-duplicate, decontamination and BPE stages cannot be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/tidemark-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
