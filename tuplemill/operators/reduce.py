"""Merging documents' counts. Pair counts are gated by sentence hashes, tuple counts are summed.

A document counts for a key only if neither side's hashes meet those of the documents accepted before it,
in order of ``docid``. The outcome depends on that order, but little of the data needs it:

* of documents with the same hashes on both sides only the first can be accepted, so equal ones are combined
  by a partial aggregation (a sentence with very many copies is one row);
* a row whose hashes no other row of its key has is always accepted and blocks nothing;
* the rest is settled in rounds of joins (``first_come``). No key's rows are gathered. Rows that wait for one other row alone
  make chains, which are followed to their ends by pointer jumping, so that a chain of n rows takes about log2(n) steps.

A side's hashes stop to grow once they are ``MAX_HASHES``. What follows the document that fills a side is settled
apart (``_after_full``), for keys that get so far only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuplemill.operators.extract import KEPT, PAIR, TUPLE
from tuplemill.stages import forget, materialised

MAX_HASHES = 10_000


def _with_sets(rows: DataFrame, payload: list[str]) -> DataFrame:
    hashes = [F.array_sort(F.array_distinct(h)).alias(h) for h in ("fhashes", "shashes")]
    return rows.select("docid", *PAIR, *hashes, F.struct(*payload).alias("p"))


def _by_first_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*PAIR, "fhashes", "shashes").agg(F.min("docid").alias("docid"), F.min_by("p", "docid").alias("p"))


def _exploded(rows: DataFrame, *sides: str) -> DataFrame:
    """(key, row, docid, side, hash) of the hash columns ``sides``; rows have ``row``."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("h")) for c in sides)))
    return rows.select(*PAIR, "row", "docid", each.alias("s")).select(*PAIR, "row", "docid", "s.side", F.explode("s.h").alias("hash"))


def _greedy(rows: DataFrame, *sides: str) -> DataFrame:
    """The rows that a gate over the hash columns ``sides`` lets through in order of ``docid``. ``rows`` must be materialised."""
    slot = [*PAIR, "side", "hash"]
    hashes = _exploded(rows, *sides)
    # slots that several rows may have, by a hash of theirs; few are left for the slots themselves to be told apart
    token = F.xxhash64(*slot).alias("token")
    some = materialised(hashes.select(token).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token"), "tokens")
    if some.isEmpty():
        return rows
    hashes = materialised(hashes.withColumn("token", token).join(some, "token", "left_semi").drop("token"), "slots")
    shared = hashes.groupBy(*slot).agg(F.count("*").alias("n")).filter("n > 1").select(*slot, F.monotonically_increasing_id().alias("slot"))
    shared = materialised(shared, "shared-hashes")
    if shared.isEmpty():
        return rows
    doubtful = materialised(hashes.join(shared, slot).select("row", "docid", "slot"), "doubtful")
    certain = rows.join(doubtful, "row", "left_anti")
    return certain.union(rows.join(first_come(doubtful), "row", "left_semi"))


def accepted_documents(document_rows: DataFrame, payload: list[str], most_hashes: int = MAX_HASHES) -> DataFrame:
    """The rows (key, docid, ``alone``, payload) that the gate lets through.

    ``document_rows`` has key, docid, ``fhashes``, ``shashes`` and the payload; a key has a document once. A side's hashes
    grow by all of an accepted document while there are fewer than ``most_hashes``. ``alone``: the key has no other row,
    so that nothing needs to be summed, nor settled here; most keys are such, and don't leave the place they were written to.
    """
    raw = _with_sets(document_rows, payload)
    key = Window.partitionBy(*PAIR)
    # hashes that a key's documents have at most: fewer can't fill a side
    bound = F.sum(F.greatest(F.size("fhashes"), F.size("shashes"))).over(key) >= most_hashes
    rows = _by_first_document(raw).withColumns({"alone": F.count("*").over(key) == 1, "may_fill": bound})
    rows = materialised(rows.withColumn("row", F.monotonically_increasing_id()), "first-documents")
    out = [*PAIR, "docid", "alone", "p"]
    several = rows.filter("not alone")
    kept = _greedy(several, "fhashes", "shashes")
    if not several.filter("may_fill").isEmpty():
        kept = materialised(kept, "accepted")
        could = kept.filter("may_fill")
        cuts = [_filled(could.withColumn("n", F.size(c)), F.lit(0), most_hashes).withColumnRenamed("cut", f"{c}_cut") for c in ("fhashes", "shashes")]
        full = materialised(cuts[0].join(cuts[1], PAIR, "full_outer"), "full")
        if not full.isEmpty():
            late = _after_full(raw, kept, full, most_hashes).withColumn("alone", F.lit(False))
            kept = kept.join(full, PAIR, "left_anti").select(*out).unionByName(late.select(*out))
    return rows.filter("alone").select(*out).union(kept.select(*out)).select(*PAIR, "docid", "alone", "p.*")


def _parts(passed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with one accepted document, which need no sums, and the others."""
    if "alone" not in passed.columns:
        return passed.limit(0), passed
    return passed.filter("alone"), passed.filter("not alone")


def _filled(accepted: DataFrame, before: Column, most: int) -> DataFrame:
    """(key, cut): the document with which the running sum of ``n`` over a key's accepted documents, and ``before``, gets to ``most``.

    The first ``most`` documents that add any hash are enough to get there; Spark drops the others before the shuffle.
    """
    order = Window.partitionBy(*PAIR).orderBy("docid")
    few = accepted.filter("n > 0").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    total = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) + before
    return few.withColumn("total", total).filter(F.col("total") >= most).groupBy(*PAIR).agg(F.min("docid").alias("cut"))


def _after_full(raw: DataFrame, kept: DataFrame, full: DataFrame, most: int) -> DataFrame:
    """The accepted documents of keys of which a side gets full.

    Up to the document that fills the first side (``x``), ``kept`` holds. After it that side is fixed and the other (``y``) goes on
    to grow, until it is full too; then every document passes that meets neither. Equal documents aren't combined here, as a full
    side doesn't learn of the first.
    """
    f_first = F.coalesce(F.col("shashes_cut").isNull() | (F.col("fhashes_cut") <= F.col("shashes_cut")), F.lit(False))
    sides = {"x": F.when(f_first, F.col("fhashes")).otherwise(F.col("shashes")), "y": F.when(f_first, F.col("shashes")).otherwise(F.col("fhashes"))}
    sided = lambda rows: rows.join(full, PAIR).withColumns(sides | {"d1": F.least("fhashes_cut", "shashes_cut")})
    early = materialised(sided(kept).filter("docid <= d1").select(*PAIR, "row", "docid", "x", "y", "p"), "early")
    late = materialised(sided(raw).filter("docid > d1").select(*PAIR, F.monotonically_increasing_id().alias("row"), "docid", "x", "y", "p"), "late")
    slot = [*PAIR, "side", "hash"]

    def clear(rows: DataFrame, of: DataFrame, *sides: str) -> DataFrame:
        """Rows that share no hash with any of ``of``."""
        met = _exploded(rows, *sides).join(_exploded(of, *sides).select(*slot).distinct(), slot, "left_semi").select("row").distinct()
        return rows.join(met, "row", "left_anti")

    late = materialised(clear(late, early, "x", "y"), "late")
    middle = materialised(_greedy(late, "y"), "middle")
    base = early.groupBy(*PAIR).agg(F.sum(F.size("y")).alias("y0"), F.max("docid").alias("d1"))
    cut = _filled(middle.withColumn("n", F.size("y")).join(base, PAIR), F.col("y0"), most)
    ends = base.join(cut, PAIR, "left").select(*PAIR, F.when(F.col("y0") >= most, F.col("d1")).otherwise(F.col("cut")).alias("d2"))
    ends = materialised(ends, "ends")
    middle = middle.join(ends, PAIR).filter("d2 is null or docid <= d2").drop("d2")
    rest = clear(late.join(ends, PAIR).filter("docid > d2").drop("d2"), middle, "y")
    return early.union(middle.select(*early.columns)).union(rest.select(*early.columns)).select(*PAIR, "docid", "p")


def first_come(claims: DataFrame) -> DataFrame:
    """The rows that get all their slots if rows claim them in order of ``docid``: (row).

    ``claims``: row, docid, slot; materialised. A row gets its slots only if all are free, and then takes them. In each round a row
    that is first at all its slots is accepted, and the rows that share a slot with it go. A row that waits for a single other row
    gets its slots just if that one doesn't; such rows are followed along to the row at the end of their chain, and if
    that one is accepted, every second row of the chain is as well.
    """
    accepted = []
    while not claims.isEmpty():
        first = claims.groupBy("slot").agg(F.min(F.struct("docid", "row")).alias("first"))
        queued = claims.join(first, "slot").select("row", "docid", "slot", F.col("first.docid").alias("d"), F.col("first.row").alias("ahead"))
        second = queued.filter("docid > d").groupBy("slot").agg(F.min("docid").alias("second"))
        place = F.when(F.col("docid") == F.col("d"), 1).when(F.col("docid") == F.col("second"), 2).otherwise(3)
        placed = queued.join(second, "slot", "left").withColumn("place", place)
        waits = F.when(F.col("place") == 2, F.col("ahead"))
        nodes = placed.groupBy("row").agg(F.max("place").alias("place"), F.min(waits).alias("up"), F.max(waits).alias("other"))
        nodes = materialised(nodes.select("row", (F.col("place") == 1).alias("free"), F.when((F.col("place") == 2) & (F.col("up") == F.col("other")), F.col("up")).alias("up")), "nodes")
        free = nodes.filter("free").select("row")
        ends = _chain_ends(nodes.filter("up is not null").select("row", "up"))
        even = ends.filter("even").join(free.select(F.col("row").alias("end")), "end", "left_semi").select("row")
        accepted.append(materialised(free.union(even), "free"))
        taken = claims.join(accepted[-1], "row", "left_semi").select("slot").distinct()
        decided = claims.join(taken, "slot", "left_semi").select("row").distinct()
        left = materialised(claims.join(decided, "row", "left_anti"), "claims")
        forget(nodes, *([claims] if len(accepted) > 1 else []))  # the first claims are the caller's
        claims = left
    return reduce(DataFrame.union, accepted) if accepted else claims.select("row")


def _chain_ends(links: DataFrame) -> DataFrame:
    """(row, end, even): where the chain of ``up`` from each row ends, and whether it is an even number of steps away.

    Each step doubles the reach of all rows that aren't at their end yet.
    """
    inner = links.select(F.col("row").alias("up"), F.lit(False).alias("done"))
    links = materialised(links.join(inner, "up", "left").select("row", "up", F.lit(False).alias("even"), F.coalesce("done", F.lit(True)).alias("done")), "links")
    while not links.filter("not done").isEmpty():
        far = links.select(F.col("row").alias("up"), F.col("up").alias("on"), F.col("even").alias("more"), F.col("done").alias("far_done"))
        moved = links.filter("not done").join(far, "up").select("row", F.col("on").alias("up"), (F.col("even") == F.col("more")).alias("even"), F.col("far_done").alias("done"))
        further = materialised(links.filter("done").union(moved), "links")
        forget(links)
        links = further
    return links.select("row", F.col("up").alias("end"), "even")


def reduced_pairs(document_rows: DataFrame, most_hashes: int = MAX_HASHES) -> DataFrame:
    """(key, window, n) over all documents; ``document_rows`` has key, docid, hashes and ``counts``."""
    return sum_pairs(accepted_documents(document_rows, ["counts"], most_hashes))


def with_alone(rows: DataFrame) -> DataFrame:
    """Rows of ``extract.plain_rows`` or ``variable_rows`` with ``alone``: no other row of them has the key.

    Rows stay where they were dealt to and are sorted by a number for each key, not by its six strings.
    """
    key = Window.partitionBy("token", "frel", "farg2", "srel", "sarg2")
    return rows.withColumn("token", F.xxhash64(*PAIR)).withColumn("alone", F.count("*").over(key) == 1).drop("token")


def reduced_rows(rows: DataFrame, most_hashes: int = MAX_HASHES) -> DataFrame:
    """(key, ``counts`` by window) over all documents, of rows with ``alone``, materialised; a key's rows must all be there.

    A key with one row needs no gate. The others' rows are counted by document and shuffled once, by key, for that and for the gate.
    """
    one = rows.filter("alone").select(*PAIR, F.create_map("window", F.lit(1).cast("bigint")).alias("counts"))
    key = ["docid", *PAIR, "fhashes", "shashes"]
    windows = rows.filter("not alone").repartition(*PAIR).groupBy(*key, "window").agg(F.count("*").alias("n"))
    several = windows.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("window", "n"))).alias("counts"))
    return one.union(reduced_maps(several, most_hashes))


def lone_maps(rows: DataFrame) -> DataFrame:
    """(key, counts) of rows that are alone with their key."""
    return rows.select(*PAIR, F.create_map("window", F.lit(1).cast("bigint")).alias("counts"))


def lone_heads(rows: DataFrame) -> DataFrame:
    """``reduced_heads`` of rows that are alone with their key."""
    heads = zip(HEAD_MAPS, ("f1", "f2", "s1", "s2"))
    return rows.select(*PAIR, *(F.create_map(F.col(f"heads.{c}"), F.lit(1).cast("bigint")).alias(n) for n, c in heads))


def lone_ids(rows: DataFrame) -> DataFrame:
    """``reduced_ids`` of rows that are alone with their key."""
    name = lambda e: F.array(F.concat_ws("-", "docid", F.col("sentid").cast("string"), F.col(e).cast("string")))
    return rows.select(*PAIR, name("extrid").alias("first_ids"), name("inner_extrid").alias("second_ids"))


def sum_pairs(passed: DataFrame) -> DataFrame:
    """(key, window, n) of accepted documents with ``counts``."""
    one, several = (rows.select(*PAIR, F.explode("counts").alias("window", "n")) for rows in _parts(passed))
    return one.union(several.groupBy(*PAIR, "window").agg(F.sum("n").alias("n")))


def reduced_maps(document_rows: DataFrame, most_hashes: int = MAX_HASHES) -> DataFrame:
    """``reduced_pairs`` with one row for each key, which has ``counts`` by window."""
    return sum_maps(accepted_documents(document_rows, ["counts"], most_hashes))


def sum_maps(passed: DataFrame) -> DataFrame:
    """(key, counts) of accepted documents with ``counts``."""
    one, several = _parts(passed)
    summed = several.select(*PAIR, F.explode("counts").alias("window", "n")).groupBy(*PAIR, "window").agg(F.sum("n").alias("n"))
    mapped = summed.groupBy(*PAIR).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("window", "n")))).alias("counts"))
    return one.select(*PAIR, F.map_from_entries(F.array_sort(F.map_entries("counts"))).alias("counts")).union(mapped)


HEAD_MAPS = ["first_arg1", "first_arg2", "second_arg1", "second_arg2"]


def reduced_heads(document_rows: DataFrame, most: int = KEPT) -> DataFrame:
    """Head-count maps per key: accepted documents are added in order while a map has fewer than ``most`` heads."""
    return sum_heads(accepted_documents(document_rows, HEAD_MAPS), most)


def sum_heads(passed: DataFrame, most: int = KEPT) -> DataFrame:
    """``reduced_heads`` of accepted documents with head maps.

    The last document that is added is the one that brings the ``most``-th head, so sums up to that document do;
    no key's documents are gathered.
    """
    one, several = _parts(passed)
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(n).alias("m")) for n in HEAD_MAPS))).alias("x")
    rows = several.select(*PAIR, "docid", sides).select(*PAIR, "docid", "x.side", F.explode("x.m").alias("head", "n"))
    key = [*PAIR, "side"]
    firsts = rows.groupBy(*key, "head").agg(F.min("docid").alias("first"))
    order = F.row_number().over(Window.partitionBy(*key).orderBy("first", "head"))
    last = firsts.withColumn("r", order).filter(F.col("r") <= most).filter(F.col("r") == most).select(*key, F.col("first").alias("last"))
    added = rows.join(last, key, "left").filter("last is null or docid <= last").groupBy(*key, "head").agg(F.sum("n").alias("n"))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("head", "n"))))).alias(n) for n in HEAD_MAPS]
    own = [F.map_from_entries(F.array_sort(F.map_entries(n))).alias(n) for n in HEAD_MAPS]
    return one.select(*PAIR, *own).union(added.groupBy(*PAIR).agg(*maps))


def reduced_ids(document_rows: DataFrame, most: int = KEPT) -> DataFrame:
    """``first_ids`` and ``second_ids`` per key: accepted documents' ids are added in order while there are fewer than ``most``.

    ``document_rows`` has ``fids`` and ``sids``, which name their document and so never repeat in another. Each document
    has one id at least: only the first ``most`` of a key can matter, and Spark drops the others before the shuffle.
    """
    return join_ids(accepted_documents(document_rows, ["fids", "sids"]), most)


def join_ids(passed: DataFrame, most: int = KEPT) -> DataFrame:
    """``reduced_ids`` of accepted documents with ``fids`` and ``sids``."""
    order = Window.partitionBy(*PAIR).orderBy("docid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    one, several = _parts(passed)
    few = several.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    for c in ("fids", "sids"):
        few = few.withColumn(f"n{c}", F.coalesce(F.sum(F.size(c)).over(before), F.lit(0)))
    lists = [F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"n{c}") < most, F.struct("docid", F.col(c).alias("ids"))))), lambda e: e["ids"])).alias(n) for c, n in (("fids", "first_ids"), ("sids", "second_ids"))]
    own = [F.col(c).alias(n) for c, n in (("fids", "first_ids"), ("sids", "second_ids"))]
    return one.select(*PAIR, *own).union(few.groupBy(*PAIR).agg(*lists))


def join_hashes(passed: DataFrame, most: int = MAX_HASHES) -> DataFrame:
    """``first_hashes`` and ``second_hashes`` per key: accepted documents' hashes in order while there are fewer than ``most``.

    ``passed`` has ``fhashes`` and ``shashes``. The last document that counts is the one that brings the ``most``-th hash.
    """
    rows = _exploded(passed.withColumn("row", F.lit(0)), "fhashes", "shashes")
    key = [*PAIR, "side"]
    firsts = rows.groupBy(*key, "hash").agg(F.min("docid").alias("first"))
    order = F.row_number().over(Window.partitionBy(*key).orderBy("first", "hash"))
    last = firsts.withColumn("r", order).filter(F.col("r") <= most).filter(F.col("r") == most).select(*key, F.col("first").alias("last"))
    added = firsts.join(last, key, "left").filter("last is null or first <= last")
    lists = [F.array_sort(F.collect_list(F.when(F.col("side") == c, F.col("hash")))).alias(n) for c, n in (("fhashes", "first_hashes"), ("shashes", "second_hashes"))]
    return added.groupBy(*PAIR).agg(*lists)


def with_lone(document_rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a document and a ``key`` each, in buckets of documents, with ``lone``: no other document has the key.

    Numbers of keys go to where they are counted, and those that several documents have come back; the rows stay. Two keys of one number
    aren't ``lone``, so the other rows' keys must be told apart still.
    """
    token = F.xxhash64(*key)
    several = F.count("*").over(Window.partitionBy("token")) > 1
    found = document_rows.select("docid", token.alias("token")).withColumn("several", several).filter("several")
    found = materialised(found.distinct(), "several", True)
    return document_rows.withColumn("token", token).join(found, ["docid", "token"], "left").withColumn("lone", F.col("several").isNull()).drop("token", "several")


def whole_pairs(document_rows: DataFrame, most: int = KEPT, most_hashes: int = MAX_HASHES) -> DataFrame:
    """Reduced tuple pairs with all they carry: key, ``counts``, head maps, and the tuples ``first`` and ``second``.

    ``document_rows`` come from ``extract.with_tuples``, with head maps. A tuple has the hashes and ids of accepted documents, each up to
    its bound, and the sentences and heads of the first. Rows that are ``lone`` (``with_lone``) need no gate. Neither they nor any sentences
    are shuffled, if the rows are in buckets of documents: results come to the sentences of their first document.
    """
    payload = ["counts", *HEAD_MAPS, "fhashes", "shashes", "fids", "sids"]
    passed = materialised(accepted_documents(document_rows.filter("not lone"), payload, most_hashes), "passed", True)
    one, several = (rows.drop("alone") for rows in _parts(passed))
    out = sum_maps(several)
    for more in (sum_heads(several, most), join_ids(several, most), join_hashes(several, most_hashes), several.groupBy(*PAIR).agg(F.min("docid").alias("docid"))):
        out = out.join(more, PAIR)
    sorted_map = lambda c: F.map_from_entries(F.array_sort(F.map_entries(c))).alias(c)
    hashes = [F.array_sort(F.array_distinct(c)).alias(n) for c, n in (("fhashes", "first_hashes"), ("shashes", "second_hashes"))]
    own = lambda rows, *more: rows.select("docid", *PAIR, *map(sorted_map, ("counts", *HEAD_MAPS)), F.col("fids").alias("first_ids"), F.col("sids").alias("second_ids"), *hashes, *more)
    said = document_rows.filter("not lone").select("docid", *PAIR, "fsaid", "ssaid")
    out = own(document_rows.filter("lone"), "fsaid", "ssaid").unionByName(out.unionByName(own(one)).repartition("docid").join(said, ["docid", *PAIR]))
    whole = []
    for side, name in (("f", "first"), ("s", "second")):
        fields = [F.col(f"{side}{c}").alias(c) for c in TUPLE]
        fields += [F.coalesce(f"{name}_hashes", F.array().cast("array<int>")).alias("hashes"), F.col(f"{side}said.sentences").alias("sentences"), F.col(f"{name}_ids").alias("ids")]
        fields += [F.col(f"{side}said.{c}").alias(c) for c in ("arg1_heads", "arg2_heads")]
        whole.append(F.struct(*fields).alias(name))
    return out.select(*PAIR, "counts", *HEAD_MAPS, *whole)


def reduced_tuples(document_tuples: DataFrame) -> DataFrame:
    return document_tuples.groupBy(*TUPLE).agg(F.sum("n").alias("n"))


def tuple_totals(tuple_rows: DataFrame) -> DataFrame:
    """``reduced_tuples`` from rows of single occurrences, in one shuffle."""
    return tuple_rows.groupBy(*TUPLE).agg(F.count("*").alias("n"))


def reduced_details(details: DataFrame) -> DataFrame:
    """Counts and head counts summed, if there are any; hashes, sentences and ids of the first document.

    Rows that are ``lone``, if there is such a column (``with_lone``), are their tuples' results as they are; what first documents say
    isn't shuffled then either, as sums come to it.

    Heads are summed as rows, so a tuple with very many heads is combined before the shuffle; the map that is made of
    them last has a tuple's distinct heads. What the first document says is one more such row, so that nothing is joined.
    """
    said = ["hashes", "sentences", "ids"]
    if "lone" in details.columns:
        several = details.filter("not lone").drop("lone")
        firsts = several.select("docid", *TUPLE, *said)
        sums = reduced_details(several.withColumns({"hashes": F.lit(None), "ids": F.lit(None), "sentences": F.col("docid")}))
        several = sums.withColumnRenamed("sentences", "docid").drop("hashes", "ids").repartition("docid").join(firsts, ["docid", *TUPLE])
        return details.filter("lone").select(*details.drop("docid", "lone").columns).unionByName(several.drop("docid"))
    first = F.struct("docid", *said)
    if "arg1_heads" not in details.columns:
        return details.groupBy(*TUPLE).agg(F.sum("n").alias("n"), F.min(first).alias("first")).select(*TUPLE, "n", "first.hashes", "first.sentences", "first.ids")
    none = F.when(F.lit(False), first)
    entry = lambda side, head, c, said: F.struct(F.lit(side).alias("side"), head.alias("head"), c.cast("bigint").alias("c"), said.alias("first"))
    of_side = lambda k, n: F.transform(F.map_entries(n), lambda e: entry(k, e["key"], e["value"], none))
    entries = [of_side(k, n) for k, n in enumerate(("arg1_heads", "arg2_heads"))]
    rows = details.select(*TUPLE, F.explode(F.concat(*entries, F.array(entry(2, F.lit(None).cast("string"), F.col("n"), first)))).alias("x")).select(*TUPLE, "x.*")
    summed = rows.groupBy(*TUPLE, "side", "head").agg(F.sum("c").alias("c"), F.min("first").alias("first"))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("head", F.col("c").cast("int").alias("c")))))).alias(n) for k, n in enumerate(("arg1_heads", "arg2_heads"))]
    found = summed.groupBy(*TUPLE).agg(F.sum(F.when(F.col("side") == 2, F.col("c"))).alias("n"), F.min("first").alias("first"), *maps)
    return found.select(*TUPLE, "n", "first.hashes", "first.sentences", "first.ids", "arg1_heads", "arg2_heads")
