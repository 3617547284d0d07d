"""A corpus pipeline of five operators: quality, near duplicates, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplemill.llm import bpe, decontam, ngram_join, quality_gam, suffix_dedup
from tuplemill.llm.storage import settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on all labelled documents, doesn't reject."""
    model = quality_gam.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_gam.score_quality(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at 0.8, those of the smallest id; of equal rows, one.

    Rows without an id stay as long as one of them is in no group with an id.
    """
    named = docs.select(*COLUMNS)
    groups = ngram_join.jaccard_groups(named, k=5, percent=80)
    first = groups.filter("doc_id = component_id or component_id is null").select("doc_id").distinct()
    return named.join(first, named["doc_id"].eqNullSafe(first["doc_id"]), "left_semi").dropDuplicates(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that start anywhere else; ``n_chars`` follows a text that changes."""
    named = docs.select(*COLUMNS).withColumn("gap", F.col("text").isNull())
    kept = suffix_dedup.dedup_bytes(named, window=200, with_text=True, carry=("lang", "source", "n_chars", "gap"))
    text = F.when(~F.col("gap"), F.col("kept"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), k=5, percent=80)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded bytes, and the ids."""
    return bpe.encode_documents(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Trained and tokenising stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
