"""An inverted index with places, and lookups that read only the part of it that holds their terms.

Two tables stand below the index's path. ``rows`` has the indexed table, each row with a number; a folder for each
task that wrote it, so that a lookup opens only folders with results. ``postings`` has, for each field and token, the
numbers of the rows that hold it, in blocks of bounded size; a folder for each bucket of tokens. A token of very many
rows has many blocks, which are dealt over several files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplemill.functions import tuples as T
from tuplemill.stages import materialised

FIELDS = ("farg1", "frel", "farg2")
BUCKETS = 64
#: Row numbers whose upper bits agree share a block: 4,096 rows at most.
BLOCK_BITS = 12
#: Row numbers count up within the task that wrote them; the task stands in the bits above.
TASK_BITS = 33
#: Above so many folders a lookup doesn't name those it needs.
MAX_FOLDERS = 2_000
WORD, PLACED = "word", "placed"
POSTINGS = "kind string, field string, token string, block bigint, rows array<struct<row:bigint,places:array<int>>>, bucket int"


def words(text: Column) -> Column:
    """The distinct words of a text, small letters; blanks and ``:`` part them."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s:]+"), lambda w: w != ""))


def placed(text: Column) -> Column:
    """The tokens of a text in order, as phrases see them: array<struct<token, begins, ends>>.

    Blanks, ``:`` and ``_`` part tokens; ``begins`` and ``ends`` say whether a blank or an end of the text is next to it.
    """
    chunk = lambda c: F.transform(c, lambda t, i: F.struct(t.alias("token"), (i == 0).alias("begins"), (i == F.size(c) - 1).alias("ends")))
    tokens = F.flatten(F.transform(F.split(F.lower(text), r"\s+"), lambda c: chunk(F.split(c, "[:_]+"))))
    return F.filter(tokens, lambda t: t["token"] != "")


class Clause(NamedTuple):
    """What a query asks of a field: one of several words, or a phrase of tokens in a row."""

    field: str
    tokens: tuple[str, ...]
    phrase: bool

    @classmethod
    def of(cls, field: str, text: str) -> Clause:
        """A text in double quotes is a phrase; of other texts every word counts but prepositions."""
        text = text.strip().lower()
        if len(text) > 1 and text[0] == text[-1] == '"':
            return cls(field, tuple(w for w in re.split(r"[\s:_]+", text[1:-1]) if w), True)
        return cls(field, tuple(dict.fromkeys(w for w in re.split(r"[\s:]+", text) if w and w not in T.PREPOSITIONS)), False)

    @property
    def kind(self) -> str:
        return PLACED if self.phrase else WORD


def _bucket(field: Column, token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(field, token), F.lit(buckets)).cast("int")


def postings(rows: DataFrame, fields: tuple[str, ...] = FIELDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, kind, field, token, block, rows) of a table with ``row`` numbers.

    ``rows`` lists, in order, a block's rows with the token; of placed tokens also their places, four times the place
    plus two for a token that begins and one for one that ends a blank-parted text.
    """
    named = rows.select("row", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x")).select("row", "x.*")
    none = F.array().cast("array<int>")
    plain = named.select(F.lit(WORD).alias("kind"), "field", "row", F.explode(words(F.col("text"))).alias("token"), none.alias("places"))
    tokens = named.select("field", "row", F.posexplode(placed(F.col("text"))).alias("at", "t"))
    place = F.col("at") * 4 + F.when(F.col("t.begins"), 2).otherwise(0) + F.when(F.col("t.ends"), 1).otherwise(0)
    places = tokens.groupBy("field", "row", F.col("t.token").alias("token")).agg(F.array_sort(F.collect_list(place)).alias("places"))
    every = plain.unionByName(places.withColumn("kind", F.lit(PLACED)))
    block = F.shiftright("row", BLOCK_BITS).alias("block")
    listed = every.groupBy("kind", "field", "token", block).agg(F.array_sort(F.collect_list(F.struct("row", "places"))).alias("rows"))
    return listed.withColumn("bucket", _bucket(F.col("field"), F.col("token"), buckets))


def write(table: DataFrame, path: str, fields: tuple[str, ...] = FIELDS, buckets: int = BUCKETS) -> InvertedIndex:
    """Writes ``table`` and the postings of its ``fields`` below ``path``."""
    spark = table.sparkSession
    numbered = table.withColumn("row", F.monotonically_increasing_id()).withColumn("task", F.shiftright("row", TASK_BITS).cast("int"))
    numbered.limit(0).write.parquet(f"{path}/schema")  # a table without rows has no folder that could tell it
    numbered.write.partitionBy("task").parquet(f"{path}/rows")
    rows = InvertedIndex(spark, path, fields, buckets).rows()
    dealt = postings(rows, fields, buckets).hint("rebalance", "bucket")  # a folder's blocks go to as many files as their size asks for
    dealt.sortWithinPartitions("bucket", "kind", "field", "token", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    return InvertedIndex(spark, path, fields, buckets)


@dataclass(frozen=True)
class InvertedIndex:
    """An index that ``write`` has written; ``fields`` and ``buckets`` must be those it was written with."""

    spark: SparkSession
    path: str
    fields: tuple[str, ...] = FIELDS
    buckets: int = BUCKETS

    def rows(self) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(kind).parquet(f"{self.path}/rows")

    def blocks(self, clauses: list[Clause]) -> DataFrame:
        """The postings of all clauses' tokens, from their buckets alone."""
        terms = list(dict.fromkeys((c.kind, c.field, t) for c in clauses for t in c.tokens))
        one = lambda kind, field, token: (F.col("kind") == kind) & (F.col("field") == field) & (F.col("token") == token)
        some = F.lit(False)
        for term in terms:
            some = some | one(*term)
        found = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        return found.filter(F.col("bucket").isin(*(_bucket(F.lit(f), F.lit(t), self.buckets) for _, f, t in terms)) & some)

    def hits(self, clauses: list[Clause]) -> DataFrame:
        """(row) of the rows that satisfy all clauses; one shuffle of the terms' postings by row."""
        uses = F.array(*(F.struct(F.lit(k).alias("clause"), F.lit(c.kind).alias("kind"), F.lit(c.field).alias("field"), F.lit(t).alias("token"), F.lit(i).alias("i"), F.lit(len(c.tokens)).alias("n")) for k, c in enumerate(clauses) for i, t in enumerate(c.tokens)))
        mine = F.filter(uses, lambda u: (u["kind"] == F.col("kind")) & (u["field"] == F.col("field")) & (u["token"] == F.col("token")))
        rows = self.blocks(clauses).select("kind", F.explode(mine).alias("u"), "rows").select("kind", "u.clause", "u.i", "u.n", F.explode("rows").alias("r"))
        # a word stands at no place; a phrase's token tells the place at which the phrase would begin
        rows = rows.select("clause", "i", "n", "r.row", F.explode(F.when(F.col("kind") == WORD, F.array(F.lit(-1))).otherwise(F.col("r.places"))).alias("p"))
        sound = (F.col("p") < 0) | (((F.col("i") > 0) | (F.col("p").bitwiseAND(2) > 0)) & ((F.col("i") < F.col("n") - 1) | (F.col("p").bitwiseAND(1) > 0)))
        at = F.when(F.col("p") < 0, F.lit(-1)).otherwise(F.shiftright("p", 2) - F.col("i"))
        seen = rows.filter(sound).groupBy("row").agg(F.collect_set(F.struct("clause", at.alias("at"), "i")).alias("seen"))
        good = F.lit(True)
        for k, c in enumerate(clauses):
            good = good & self._satisfied(k, len(c.tokens) if c.phrase else 1)
        return seen.filter(good).select("row")

    @staticmethod
    def _satisfied(clause: int, tokens: int) -> Column:
        """Some place has all tokens of a clause; a clause of words needs one."""
        own = F.filter("seen", lambda s: s["clause"] == clause)
        return F.exists(own, lambda s: F.size(F.filter(own, lambda o: o["at"] == s["at"])) >= tokens)

    def candidates(self, wanted: dict[str, str | None]) -> DataFrame:
        """Rows of the indexed table whose fields match all wanted texts; none if no text, or a text without tokens, is given.

        Row numbers are found first; the table is read where they stand.
        """
        clauses = [Clause.of(f, text) for f, text in wanted.items() if text]
        if not clauses or not all(c.tokens for c in clauses):
            return self.rows().limit(0).drop("row", "task")
        hits = materialised(self.hits(clauses).withColumn("task", F.shiftright("row", TASK_BITS).cast("int")), "hits")
        folders = [r["task"] for r in hits.select("task").distinct().limit(MAX_FOLDERS + 1).collect()]
        rows = self.rows()
        rows = rows.filter(F.col("task").isin(folders)) if len(folders) <= MAX_FOLDERS else rows
        return rows.join(hits, ["task", "row"], "left_semi").drop("row", "task")
