"""Audit of a chain of text filters: what each removes, alone and after others, in every order.

A document fails any of five filters; its failures are a mask of five bits. A chain's figures depend on
a document by its mask alone, so the table is read once into 32 counts for each part, and all 120 orders
are read off those counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplemill.llm.storage import settle

FILTERS = "ABCDE"
_BLANKS = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3, of the filters A to D: few words, repeated words, capitals, signs."""
    trimmed = F.trim(text, F.lit(" \t\n\v\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANKS))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    length = F.length(text).cast("long")
    capitals = length - F.length(F.translate(text, _UPPER, ""))
    fails = (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * length, text.rlike("[#$%&*|]"))
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """(key, doc_id, part, mask, n): ``n`` rows of one id, text and part fail the filters whose bits are in ``mask``.

    Texts are held against each other by SHA-256, so that no text travels. A row fails E if a smaller id
    has its text: the smallest id of each text is met with rows by text and id together, and so a text of
    very many documents is dealt over all tasks. Rows that agree in all of that are counted before.
    """
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = named.select("doc_id", "part", text_mask(F.col("text")).alias("bits"), F.unhex(F.sha2("text", 256)).alias("key"))
    rows = settle(rows.groupBy("doc_id", "part", "bits", "key").agg(F.count("*").alias("n")), "masks")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["key", "doc_id"], "left").select("key", "doc_id", "part", (F.col("bits") + F.when(repeated, 16).otherwise(0)).alias("mask"), "n")


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): at most 32 rows a part."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("place", F.lit(0))
    # rows without an id meet no label; they are dealt out instead of gathered
    rows = masks(docs).withColumn("place", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("key"), F.lit(4096)).cast("int")).otherwise(0))
    rows = rows.join(marks, ["doc_id", "place"], "left")
    sums = (F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def orders(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, own): the filters before a step and its own, as bits; 600 rows."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            rows.append((name, step, before, 1 << k))
            before |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, before int, own int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part is a ``lang``, null and empty together. Null texts are empty. Equal rows of one id don't fail E through each
    other; rows without an id fail no E and make none fail. A document is good (toxic) if any of its labels says 1; labels
    that are null or of no document count for nothing. Columns beside doc_id, text and lang are neither read nor returned.
    Without documents there is no part and no row.
    """
    cells = settle(histogram(docs, labels), "cells")
    own = F.explode(F.array(*(F.lit(1 << k) for k in range(len(FILTERS))))).alias("own")
    steps = cells.select("*", own).select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("before")).filter("before & own = 0")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda rows, column, name: F.sum(F.when(rows, F.col(column)).otherwise(0)).alias(name)
    # of the orders of all filters, those in which a filter stands before the others of a mask are one in so many as the mask has bits
    share = F.when(fails, F.col("n") * F.get(F.array(*(F.lit(120 // k) for k in range(1, 6))), F.bit_count("mask") - 1)).otherwise(0)
    figures = steps.groupBy("part", "before", "own").agg(
        total(~fails & ~gone, "n", "kept"),
        total(fails & ~gone, "n", "removed"),
        total(fails & gone, "n", "redundant"),
        total(F.col("mask") == F.col("own"), "n", "unique_fails"),
        total(fails & ~gone, "good", "good_lost"),
        total(fails & ~gone, "toxic", "toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )
    rows = figures.join(F.broadcast(orders(docs.sparkSession)), ["before", "own"])  # 600 rows
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS names, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT array_to_string(names, '') AS filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) t(step)),
x AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM x
"""
