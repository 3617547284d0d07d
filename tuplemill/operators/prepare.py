"""Pruning and grouping of tuple records; every operator maps a records DataFrame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplemill.functions import tuples as T

MAX_RELATION_WORDS, MAX_SENTENCE_WORDS, MAX_DOCUMENT_RECORDS = 7, 75, 100
ID = ["docid", "sentid", "extrid"]


def with_alphanumeric_heads(records: DataFrame) -> DataFrame:
    return records.filter(T.has_alphanumeric(F.col("arg1Head.text")) & T.has_alphanumeric(F.col("relHead.text")) & T.has_alphanumeric(F.col("arg2Head.text")))


def with_short_relations(records: DataFrame, most: int = MAX_RELATION_WORDS) -> DataFrame:
    return records.filter(F.size(T.tokens(F.col("relHead.text"))) <= most)


def with_short_sentences(records: DataFrame, most: int = MAX_SENTENCE_WORDS) -> DataFrame:
    return records.filter(F.size(T.tokens(F.col("sentence"))) <= most)


def without_inferred_prepositions(records: DataFrame) -> DataFrame:
    return records.filter(~T.inferred_preposition(F.col("relHead.text"), F.col("sentence")))


def of_small_documents(records: DataFrame, most: int = MAX_DOCUMENT_RECORDS) -> DataFrame:
    """Counts are combined before the shuffle; only ids of large documents are joined."""
    large = records.groupBy("docid").count().filter(F.col("count") > most).select("docid")
    return records.join(large, "docid", "left_anti")


def without_redundant(records: DataFrame) -> DataFrame:
    """Drops a record if another extraction of its sentence says the same in heads that are no shorter.

    Of two equally long ones both go. One anti-join on document and sentence reaches the fixed point.
    """
    length = F.length(F.concat("arg1Head.text", "relHead.text", "arg2Head.text"))
    sized = records.withColumns({"size": length} | T.said_columns())
    one = sized.alias("o")
    two = sized.select("docid", "sentid", "extrid", "arg1", "rel", "arg2", "size", "said", "words_said").alias("i")
    redundant = T.same_arguments("o", "i", fold=False) | T.subsume_each_other("o", "i")
    same = (F.col("o.docid") == F.col("i.docid")) & (F.col("o.sentid") == F.col("i.sentid")) & (F.col("o.extrid") != F.col("i.extrid"))
    return one.join(two, same & (F.col("i.size") >= F.col("o.size")) & redundant, "left_anti").drop("size", "said", "words_said")


def with_canonical_verbs(records: DataFrame) -> DataFrame:
    return records.withColumn("relHead", F.col("relHead").withField("text", T.canonical_verbs(F.col("relHead.text"))))


def without_light_relations(records: DataFrame) -> DataFrame:
    """Drops relations of reporting, and bare forms of *be* and *have*."""
    return records.filter(~(T.is_reporting(F.col("relHead.text")) | T.is_be_or_had(F.col("relHead.text"))))


def pruned(records: DataFrame) -> DataFrame:
    """All pruning rules in order, and each record's ``position`` in its document by sentid * 1000 + extrid."""
    kept = without_redundant(with_short_relations(with_alphanumeric_heads(records)))
    kept = without_light_relations(with_canonical_verbs(kept))
    order = Window.partitionBy("docid").orderBy(F.col("sentid") * 1000 + F.col("extrid"), "sentid")
    return kept.withColumn("position", F.row_number().over(order) - 1)


def placed_sentences(records: DataFrame) -> DataFrame:
    """(docid, sentid, sentence, offset): where each sentence starts if all are joined by one character."""
    sentences = records.groupBy("docid", "sentid").agg(F.max_by("sentence", "extrid").alias("sentence"))
    before = Window.partitionBy("docid").orderBy("sentid").rowsBetween(Window.unboundedPreceding, -1)
    return sentences.withColumn("offset", F.coalesce(F.sum(F.length("sentence") + 1).over(before), F.lit(0)).cast("bigint"))


def sentence_offsets(records: DataFrame) -> DataFrame:
    """``placed_sentences`` without their texts."""
    return placed_sentences(records).drop("sentence")


def sentence_lists(records: DataFrame) -> DataFrame:
    """(docid, sentences, offsets) in sentence order; a document's sentences are bounded by its own size."""
    listed = F.array_sort(F.collect_list(F.struct("sentid", "sentence", "offset")))
    return placed_sentences(records).groupBy("docid").agg(listed.alias("s")).select("docid", F.transform("s", lambda s: s["sentence"]).alias("sentences"), F.transform("s", lambda s: s["offset"]).alias("offsets"))


def mention_documents(records: DataFrame, mentions: DataFrame, most: int) -> DataFrame:
    """(docid, size, offsets, mentions): a mention document of at most ``most`` records for each document that rows of mentions name.

    ``records`` are those that were resolved; ``mentions`` has docid, cluster_id, text, offset. Rows of larger documents are
    dropped before any list is made.
    """
    small = records.groupBy("docid").agg(F.count("*").alias("size")).filter(F.col("size") <= most)
    records, mentions = (rows.join(small, "docid", "left_semi") for rows in (records, mentions))
    listed = mentions.groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "text", "offset"))).alias("mentions"))
    offsets = sentence_lists(records).select("docid", "offsets")
    return listed.join(small.join(offsets, "docid"), "docid").select("docid", "size", "offsets", "mentions")


def merge_mentions(records: DataFrame, mentions: DataFrame, most: int = MAX_DOCUMENT_RECORDS) -> DataFrame:
    """All records, with the ``mentions`` and sentence ``offsets`` of their document and the flag ``has_mentions``.

    ``mentions`` are mention documents (docid, size, offsets, mentions), or rows that ``mention_documents`` takes. The size
    bound holds for mention documents only: records of a document without one within the bound get empty lists. Of
    several for one docid the least by its fields counts; those of unknown documents are dropped.
    """
    if "size" not in mentions.columns:
        mentions = mention_documents(records, mentions, most)
    fields = F.struct("size", "offsets", "mentions")
    small = mentions.filter(F.col("size") <= most).groupBy("docid").agg(F.min(fields).alias("m"))
    merged = records.join(small, "docid", "left")
    kinds = {f.name: f.dataType for f in mentions.schema}
    carried = {c: F.coalesce(F.col(f"m.{c}"), F.array().cast(kinds[c])) for c in ("offsets", "mentions")}
    return merged.withColumns(carried | {"has_mentions": F.coalesce(F.size("m.mentions") > 0, F.lit(False))}).drop("m")


def documents(records: DataFrame) -> DataFrame:
    """One row for each document with its records in order; for sinks."""
    fields = [c for c in records.columns if c != "docid"]
    ordered = F.array_sort(F.collect_list(F.struct("sentid", "extrid", F.struct(*fields).alias("r"))), lambda a, b: F.when(F.struct(a["sentid"], a["extrid"]) < F.struct(b["sentid"], b["extrid"]), -1).otherwise(1))
    return records.groupBy("docid").agg(ordered.alias("rows")).select("docid", F.transform("rows", lambda x: x["r"]).alias("records"))
