"""Registered queries over whole tables; each calls its operator and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tuplemill.llm import bpe, decontam, filter_audit, langid, license_scan, merkle, ngram_join, quality_gam, sql, suffix_dedup, superkmer, toxicity, vector_codes, vector_search
from tuplemill.llm.storage import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"), window=200)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, percent=80)


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).filter("confirmed")


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.dedup_words(table(spark, sf_dir, "documents"), window=20)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.product_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_products(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_merkle_fingerprints": op7_merkle_fingerprints,
    "op8_license_scan": op8_license_scan,
    "op9_quality_gam": op9_quality_gam,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_exact_top_k": op13_exact_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": sql.OP1,
    "op5_suffix_array_dedup": sql.OP5,
    "op6_benchmark_decontamination": decontam.SQL,
    "op7_merkle_fingerprints": merkle.SQL,
    "op10_substring_dedup": sql.OP10,
    "op11_vector_codes": vector_codes.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_exact_top_k": vector_search.SQL,
}
