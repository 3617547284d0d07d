"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

An item of n shingles lies in a document at containment t only if the document has at least one of
any ``floor((1 - t) * n) + 1`` of the item's shingles. Items are partitioned by size; every item of a
partition keeps as its sketch so many of its smallest min-hash values that the largest size of the
partition is served. A document that shares no value of an item's sketch can't contain it, so the
search loses nothing; what it finds is verified by exact containment of the shingles' words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplemill.llm.storage import settle

#: Bytes of a table that is broadcast at most; larger ones are joined by a shuffle. A row counts for this many bytes besides its strings.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 100
#: Parts of a frequent min-hash value in a join by shuffle.
SALTS = 64
#: Name a row of documents; rows equal in id and text are one document.
DOCUMENT = ["doc_place", "doc_text"]


def words_of(text: Column) -> Column:
    """Small-letter words ``[^\\x20\\x09-\\x0D]+``; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """Runs of ``k`` words, joined by a blank; none where there are fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<string>"))


def hashes(words: Column, k: int) -> Column:
    """Hashes of the shingles."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def of_widths(of: Callable[[Column, int], Column], words: Column, widths: list[int]) -> Column:
    """Shingles or hashes of several widths in one list."""
    return F.concat(*(of(words, k) for k in widths))


def small(df: DataFrame, *strings: str) -> bool:
    """Whether a table, with string arrays in the columns ``strings``, is small enough to broadcast; its bytes are summed up."""
    held = sum((F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s) + 16) for c in strings), F.lit(ROW_BYTES).cast("long"))
    return (df.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES


def near(df: DataFrame, *strings: str) -> DataFrame:
    """A broadcast hint if the table is small."""
    return F.broadcast(df) if small(df, *strings) else df


def item_sets(items: DataFrame, k: int) -> DataFrame:
    """(item_id, item_key, width, item_set, item_hashes): the distinct shingles of each distinct item, and their hashes.

    ``width`` is ``k``; an item of fewer words is one shingle of as many words as it has.
    """
    items = items.select("item_id", "text").dropDuplicates()
    sets = items.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), words_of(F.col("text")).alias("w"))
    sets = sets.withColumn("width", F.least(F.size("w"), F.lit(k)))

    def own(of: Callable[[Column, int], Column]) -> Column:
        out = of(F.col("w"), k)
        for n in range(1, k):
            out = F.when(F.col("width") == n, of(F.col("w"), n)).otherwise(out)
        return F.array_distinct(out)

    sets = sets.select("item_id", "item_key", "width", own(shingles).alias("item_set"), own(hashes).alias("item_hashes"))
    return sets.filter(F.size("item_set") > 0).dropDuplicates(["item_key"])


def sketches(sets: DataFrame, percent: int) -> DataFrame:
    """(h, item_key): the bottom min-hash values of each item, as many as its size partition asks for."""
    n = F.size("item_set")
    most = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1  # of the partition of sizes 2**b to 2**(b + 1) - 1
    keep = (F.floor(most * (100 - percent) / 100) + 1).cast("int")
    order = F.array_sort(F.transform("item_hashes", lambda h: F.struct(F.xxhash64(h).alias("rank"), h.alias("h"))))
    return sets.select("item_key", F.explode(F.slice(order, F.lit(1), keep)).alias("s")).select("item_key", "s.h")


def named(docs: DataFrame) -> list[Column]:
    """The columns of ``DOCUMENT``; a null id is named like the smallest one, which is told apart by nothing but its rows' ids."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("doc_place"), F.xxhash64(docs["text"]).alias("doc_text")]


def search(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    """``DOCUMENT``, ``doc_id`` and the columns of ``contained_items``."""
    sets = settle(item_sets(items, k), "items")
    sketch = settle(sketches(sets, percent), "sketches")
    widths = sorted(r["width"] for r in sets.select("width").distinct().collect()) or [k]  # ``k`` at most; only widths that items have
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *named(docs), docs["text"].alias("text"))
    hashed = keyed.select(*DOCUMENT, words_of(F.col("text")).alias("w")).select(*DOCUMENT, F.explode(of_widths(hashes, F.col("w"), widths)).alias("h"))
    if small(sketch):
        met = hashed.join(F.broadcast(sketch), "h")
    else:
        salted = sketch.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hashed.withColumn("salt", F.pmod(F.xxhash64(*DOCUMENT), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    pairs = settle(met.select(*DOCUMENT, "item_key").distinct(), "pairs")
    wanted = settle(pairs.select(*DOCUMENT).distinct(), "wanted")
    held = keyed.join(near(wanted), DOCUMENT, "left_semi").select("doc_id", *DOCUMENT, words_of(F.col("text")).alias("w"))
    held = held.select("doc_id", *DOCUMENT, F.array_distinct(of_widths(shingles, F.col("w"), widths)).alias("doc_set"))
    both = held.join(near(pairs), DOCUMENT).join(near(sets.drop("item_hashes", "width"), "item_set"), "item_key")
    n, shared = F.size("item_set"), F.size(F.array_intersect("item_set", "doc_set"))
    found = both.select(*DOCUMENT, "doc_id", "item_id", n.cast("long").alias("n_shingles"), shared.cast("long").alias("n_shared"))
    found = found.filter(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The items of which a document holds at least ``percent`` of the distinct ``k``-word shingles.

    Gives ``doc_id``, ``item_id``, ``n_shingles`` (of the item), ``n_shared``, ``containment``; one row for each
    pair of a document row and an item found in it. Texts that are null or have no word contain and are found
    in nothing; an item of fewer than ``k`` words is one shingle of its own width, found wherever a document has its words in a row;
    items that repeat count once; documents that repeat each give their rows; texts of any length are read
    whole; other columns are not read.
    """
    return search(docs, items, k, percent).drop(*DOCUMENT)


def decontaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows in which an item is contained; all columns stay, whatever their names. A null ``doc_id``
    is never dropped for another row's sake: rows are told apart by id and text. Null and empty texts stay; of rows that
    repeat all stay or all go; without items nothing goes."""
    bad = settle(search(docs, items, k, percent).select(*DOCUMENT).distinct(), "contaminated")
    place, text = named(docs)
    bad = near(bad)
    return docs.join(bad, (place == bad["doc_place"]) & (text == bad["doc_text"]), "left_anti")


SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), widths AS (SELECT 5 AS n UNION SELECT DISTINCT len(w) FROM item_words WHERE len(w) BETWEEN 1 AND 4
), item_shingles AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM item_words
), doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM doc_words, widths WHERE len(w) >= n
), sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS c FROM doc_shingles JOIN item_shingles USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, c AS n_shared, c::DOUBLE / n::DOUBLE AS containment
FROM shared JOIN sizes USING (item_id) WHERE c * 100 >= n * 80
"""
