"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections, in DataFrame operations only.

Sections are parted by blank lines, paragraphs by line ends, and a paragraph's blocks are up to
``BLOCK_WORDS`` words with the blanks before them, so that every character lies in one node. Equal
roots mean equal texts; where roots differ, the branches that differ locate the edit, and the share
of leaves that two trees have in common is their likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WORDS = 4
_BLOCK = r"(?: *[^ ]+){1,4}| +"
#: Rows that a range of ids is to have, and ranges at most.
RANGE_ROWS, RANGES = 500, 1024
_FIRST = -(2**63)


def sections(text: Column) -> Column:
    """array<array<array<string>>>: the block hashes of each paragraph of each section."""
    blocks = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_BLOCK), F.lit(0)), lambda b: F.md5(b.cast("binary")))
    return F.transform(F.split(text, r"\n\n"), lambda s: F.transform(F.split(s, r"\n"), blocks))


def _join_md5(hashes: Column) -> Column:
    return F.md5(F.array_join(hashes, "").cast("binary"))


def paragraph_hashes(tree: Column) -> Column:
    return F.transform(tree, lambda s: F.transform(s, _join_md5))


def root(tree: Column) -> Column:
    tops = F.transform(paragraph_hashes(tree), _join_md5)
    return F.sha2(F.array_join(tops, "").cast("binary"), 256)


def leaves(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared leaves over all leaves; 1 for two trees without leaves."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def trees(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``root``, ``sections`` (array of section hash and paragraph hashes) and ``blocks`` of every document.

    A null text is an empty one: one section of one paragraph without blocks.
    """
    tree = docs.select("doc_id", sections(F.coalesce("text", F.lit(""))).alias("blocks")).withColumn("paragraphs", paragraph_hashes(F.col("blocks")))
    named = F.transform("paragraphs", lambda p: F.struct(_join_md5(p).alias("section"), p.alias("paragraphs")))
    return tree.select("doc_id", root(F.col("blocks")).alias("root"), named.alias("sections"), "blocks")


def edits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where two versions of documents differ: (doc_id, section, paragraph) of ``a`` whose hash ``b`` hasn't.

    ``a`` and ``b`` come from ``trees``. Documents whose roots agree are never opened, nor are sections that agree.
    """
    both = a.alias("a").join(b.alias("b"), "doc_id").filter("a.root <> b.root")
    known = F.transform("b.sections", lambda s: s["section"])
    open_ = both.select("doc_id", F.posexplode("a.sections").alias("section", "s"), known.alias("known"), F.flatten(F.transform("b.sections", lambda s: s["paragraphs"])).alias("there"))
    open_ = open_.filter(~F.array_contains("known", F.col("s.section"))).select("doc_id", "section", F.posexplode("s.paragraphs").alias("paragraph", "p"), "there")
    return open_.filter(~F.array_contains("there", F.col("p"))).select("doc_id", "section", "paragraph")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``next_text``: the text of the next document in ascending (doc_id, text); the last one's is the first.

    Ids are dealt into ranges by their quantiles (at most ``RANGES`` bounds come to the driver); within a
    range the next row is a window function, and the last row of a range takes the head of the next one.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("place"))
    n = docs.count()
    parts = min(RANGES, n // RANGE_ROWS + 1)
    bounds = []
    if parts > 1:
        bounds = docs.select(F.percentile_approx("place", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = F.array(*(F.lit(int(b)) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<bigint>")
    ranged = docs.withColumn("range", F.size(F.filter(bounds, lambda b: b < F.col("place"))))
    heads = ranged.groupBy("range").agg(F.min("place").alias("place"))
    heads = ranged.join(F.broadcast(heads), ["range", "place"]).groupBy("range").agg(F.min("text").alias("head"))  # RANGES rows at most
    in_order = Window.orderBy("range")  # over the heads only
    wrap = heads.select("range", F.coalesce(F.lead("head").over(in_order), F.first("head").over(in_order)).alias("wrap"))
    lead = ranged.withColumn("next_text", F.lead("text").over(Window.partitionBy("range").orderBy("place", "text")))
    return lead.join(wrap.hint("merge"), "range").select("doc_id", "text", F.coalesce("next_text", "wrap").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text has the first floor(n / 2) code points of the next document (or all it has) in place of the
    last floor(n / 2) own ones. Gives ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. Equal texts have equal fingerprints; a null text is an empty one; rows of one id
    follow one another by text; a null id comes first; other columns are dropped.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(docs).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    grown = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(sections(F.col(c)).alias(c) for c in ("text", "edited", "next_text")))
    sets = grown.select("doc_id", "n_chars", "edited_sha256", root(F.col("text")).alias("fingerprint"), root(F.col("edited")).alias("edited_fingerprint"), *(leaves(F.col(c)).alias(c) for c in ("text", "edited", "next_text")))
    return sets.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("next_text")).alias("near_next"))


_TREE = r"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?: *[^ ]+){{1,4}}| +'), lambda b: md5(b))))"
_ROOT = "sha256(array_to_string(list_transform({t}, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))), ''))"
_LIKE = "CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM d),
e AS (SELECT *, left(text, (length(text) - length(text) // 2)::BIGINT) || left(next_text, (length(text) // 2)::BIGINT) AS edited FROM n),
t AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
  {_TREE.format(t="text")} AS t1, {_TREE.format(t="edited")} AS t2, {_TREE.format(t="next_text")} AS t3 FROM e),
l AS (SELECT *, list_distinct(flatten(flatten(t1))) AS l1, list_distinct(flatten(flatten(t2))) AS l2, list_distinct(flatten(flatten(t3))) AS l3 FROM t)
SELECT doc_id, n_chars, edited_sha256, {_ROOT.format(t="t1")} AS fingerprint, {_ROOT.format(t="t2")} AS edited_fingerprint,
  {_LIKE.format(a="l1", b="l2")} AS near_edited, {_LIKE.format(a="l1", b="l3")} AS near_next FROM l
"""
