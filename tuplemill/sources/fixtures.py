"""Records derived from the tables of conversations and documents, for queries and benchmarks.

Sentences are cut at full stops and line ends. Records of conversations have one token a field: every token at
an odd place is a relation between its neighbours. Records of documents have phrases, so that every rule on words,
types and hashes meets cases. Spans count tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _once(value: Column) -> Column:
    """A generator of ``value`` alone: it is computed once, where Spark would repeat a column's expression in the filters that read it."""
    return F.explode(F.array(value))


def sentences_of(texts: DataFrame, least: int) -> DataFrame:
    """(docid, sentid, sentence, tk) of ``texts`` (docid, turn, text): sentences of ``least`` tokens or more."""
    x = texts.select("docid", "turn", _once(F.split("text", "[.\\n]+")).alias("parts")).select("docid", "turn", F.posexplode("parts").alias("pos", "sentence"))
    x = x.select("docid", (F.col("turn") * 1000 + F.col("pos")).cast("int").alias("sentid"), F.trim("sentence").alias("sentence")).filter("sentence <> ''")
    return x.withColumn("tk", _once(F.regexp_extract_all("sentence", F.lit("[A-Za-z0-9]+"), F.lit(0)))).filter(F.size("tk") >= least)


def _cut(sentences: DataFrame, step: int, tokens: int, last: str, *more: Column) -> DataFrame:
    """(docid, sentid, sentence, extrid, tk, more) of ``sentences_of``: each ``step`` tokens a record of ``tokens`` tokens up to number ``last``.

    What belongs to the whole sentence is made before it is cut, and a record carries its own tokens alone.
    """
    parts = F.transform(F.expr(f"sequence(0, {last})"), lambda k: F.struct(k.alias("extrid"), F.slice("tk", k * step + 1, F.lit(tokens)).alias("tk")))
    cut = sentences.select("docid", "sentid", "sentence", *more, _once(parts).alias("parts"))
    return cut.withColumn("x", F.explode("parts")).select(*(c for c in cut.columns if c != "parts"), "x.*")


def records_of(texts: DataFrame) -> DataFrame:
    """``texts``: docid, turn, text."""
    z = _cut(sentences_of(texts, 3), 2, 3, "cast(floor((size(tk) - 1) / 2) as int) - 1", F.array(_hash(F.col("sentence"))).alias("hashes"))

    def span(k: int) -> Column:
        at = F.col("extrid") * 2 + k
        return F.struct(F.get("tk", F.lit(k)).alias("text"), at.alias("start"), (at + 1).alias("end"))

    size = F.length(F.get("tk", F.lit(0)))
    kind = F.when(size <= 3, "Type:short").when(size <= 6, "Type:mid").otherwise("Type:long")
    return z.select(
        "docid", "sentid", "sentence", "extrid", "hashes", span(0).alias("arg1"), span(1).alias("rel"), span(2).alias("arg2"),
        span(0).alias("arg1Head"), span(1).alias("relHead"), span(2).alias("arg2Head"), F.array(kind).alias("arg1Types"), F.array().cast("array<string>").alias("arg2Types"),
    )


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return records_of(t.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("docid"), "turn", "text"))


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("int")


def phrase_records_of(texts: DataFrame) -> DataFrame:
    """Records of five tokens, the last of which the next record begins with.

    By the place in the sentence, relations begin with a form of *be* or *have*, are bare or of reporting, have eight
    words or end in a preposition; a second argument has no letter. A head is a phrase's last word. A record has the
    hashes of its sentence and of the sentence's first two tokens, which other sentences share.
    """
    opening = F.lower(F.concat_ws(" ", F.get("tk", F.lit(0)), F.get("tk", F.lit(1))))
    z = _cut(sentences_of(texts, 5), 4, 5, "cast(floor((size(tk) - 5) / 4) as int)", F.length("sentence").alias("length"), F.array(_hash(F.col("sentence")), _hash(opening)).alias("hashes"))
    z = z.select("docid", "sentid", "sentence", "extrid", "hashes", (F.col("extrid") * 4).alias("at"), F.pmod(F.col("extrid") + F.col("length"), F.lit(11)).alias("v"), *(F.get("tk", F.lit(k)).alias(f"t{k}") for k in range(5)))
    one1, one2 = F.col("extrid") % 3 == 0, F.col("extrid") % 2 == 0
    span = lambda text, start, end: F.struct(text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    at = F.col("at")
    arg1 = span(F.when(one1, F.col("t0")).otherwise(F.concat_ws(" ", "t0", "t1")), at, F.when(one1, at + 1).otherwise(at + 2))
    head1 = span(F.when(one1, F.col("t0")).otherwise(F.col("t1")), F.when(one1, at).otherwise(at + 1), F.when(one1, at + 1).otherwise(at + 2))
    forms = {0: F.concat(F.lit("be "), "t2"), 1: F.concat(F.lit("has "), "t2"), 2: F.lit("is"), 3: F.lit("said to"), 4: F.concat("t2", F.lit(" a b c d e f g")), 5: F.concat("t2", F.lit(" in"))}
    rel = F.col("t2")
    for v, form in forms.items():
        rel = F.when(F.col("v") == v, form).otherwise(rel)
    bare = F.col("v") == 6
    arg2 = span(F.when(bare, "--").when(one2, F.col("t4")).otherwise(F.concat_ws(" ", "t3", "t4")), F.when(one2, at + 4).otherwise(at + 3), at + 5)
    head2 = span(F.when(bare, "--").otherwise(F.col("t4")), at + 4, at + 5)
    size = F.length("t0") % 5
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    types1 = F.when(size == 0, strings("Type:number", "Type:time_unit")).when(size == 1, strings("Type:person")).when(size == 2, strings("Type:number")).when(size == 3, strings("Type:place")).otherwise(strings(""))
    types2 = F.when(F.length("t4") % 5 == 3, strings("Type:place")).otherwise(strings())
    relation = span(rel, at + 2, at + 3)
    return z.select(
        "docid", "sentid", "sentence", "extrid", "hashes", arg1.alias("arg1"), relation.alias("rel"), arg2.alias("arg2"),
        head1.alias("arg1Head"), relation.alias("relHead"), head2.alias("arg2Head"), types1.alias("arg1Types"), types2.alias("arg2Types"),
    )


def document_records(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    """Phrase records of all documents; ``by_document``: their texts are dealt by document, so that the records need not be."""
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = t.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("docid"), F.lit(0).alias("turn"), "text")
    return phrase_records_of(texts.repartition("docid") if by_document else texts)


def phrase_mentions(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """(docid, cluster_id, text, offset): first arguments of two words, those with one first letter together; and long openings of
    sentences, which are too long to count. ``offsets``: docid, sentid, offset."""
    rows = records.join(offsets, ["docid", "sentid"])
    two = rows.filter("extrid % 3 <> 0").select("docid", F.ascii(F.lower("arg1.text")).alias("cluster_id"), F.col("arg1.text").alias("text"), (F.col("offset") + F.col("arg1.start")).cast("int").alias("offset"))
    opening = F.array_join(F.slice(F.regexp_extract_all("sentence", F.lit("[A-Za-z0-9]+"), F.lit(0)), 1, 6), " ")
    long = rows.filter("extrid = 1").select("docid", F.ascii(F.lower("arg1.text")).alias("cluster_id"), opening.alias("text"), F.col("offset").cast("int").alias("offset"))
    return two.union(long).distinct()
