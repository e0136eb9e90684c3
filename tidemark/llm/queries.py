"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bisector, bpe, decontaminate, factorisation, html_content, line_dedup, merkle, minhash, oracles, quality_rules, suffixes, token_counts, url_filters, vantage
from tidemark.llm.common import table

#: Rules of the url query (verdict, host, path), as its contract fixes them.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; TIDEMARK_TOKENIZERS names another folder."""
    if folder := os.environ.get("TIDEMARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return bpe.digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_words", "n_pieces", "n_unknown")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode_outer("hits").alias("hit")).where("hit is not null").select("doc_id", "hit.*")


def op6_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    model = factorisation.fit(docs, table(spark, sf_dir, "labels").where(fold != 0))
    scored = factorisation.score(docs, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_content.extract(pages, html_content.fit(pages)).select("page_id", "url", "text", "n_chars")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge_urls(pages, url_filters.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op11_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_byte_bpe, op2_token_counts, op3_line_dedup, op4_minhash_forest, op5_decontaminate, op6_factorisation, op7_html_content, op8_suffix_dedup, op9_quality_rules,
        op10_url_filters, op11_bisector_clusters, op12_merkle_manifest, op13_vantage_neighbours,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filters": oracles.URL_FILTERS, "op11_bisector_clusters": oracles.clusters(), "op12_merkle_manifest": oracles.manifest(), "op13_vantage_neighbours": oracles.NEIGHBOURS}
