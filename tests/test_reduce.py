"""The gate by sentence hashes against a loop: chains, sides that get full, and the hashes of a document's tuples."""

import random

import pytest
from pyspark.sql import functions as F

from tuplemill.operators import extract as E
from tuplemill.operators import reduce as R
from tuplemill.plans.jobs import Defaults, nearest_rows
from tuplemill.sources import fixtures

KEY = ", ".join(f"{c} string" for c in E.PAIR)


def rows_of(spark, per_key):
    """``per_key``: for each key a list of (first hashes, second hashes), in order of documents."""
    rows = [(f"d{d:06}", f"k{k}", "r", "b", "c", "q", "d", sorted(f), sorted(s), {1: d + 1}) for k, docs in enumerate(per_key) for d, (f, s) in enumerate(docs)]
    return spark.createDataFrame(rows, f"docid string, {KEY}, fhashes array<int>, shashes array<int>, counts map<int,bigint>").repartition(4)


def loop(per_key, most):
    out = set()
    for k, docs in enumerate(per_key):
        f, s = set(), set()
        for d, (a, b) in enumerate(docs):
            if not (f & a or s & b):
                f, s = f | a if len(f) < most else f, s | b if len(s) < most else s
                out.add((f"k{k}", f"d{d:06}"))
    return out


def accepted(df, **how):
    return {(r["farg1"], r["docid"]) for r in R.accepted_documents(df, ["counts"], **how).collect()}


@pytest.mark.parametrize("most", [1, 3, 6, 10_000])
def test_gate_with_full_sides_against_a_loop(spark, most):
    rng = random.Random(most)
    some = lambda top: {rng.randint(0, top) for _ in range(rng.randint(1, 3))}
    per_key = [[(some(top), some(top)) for _ in range(rng.randint(1, 25))] for top in (4, 9, 30, 60) for _ in range(6)]
    per_key += [[({1}, {2})] * 5, [(set(), {1}), (set(), {1}), (set(), set())], [({d}, {0}) for d in range(9)], [({d, d + 1}, {100 + d}) for d in range(20)]]
    got = accepted(rows_of(spark, per_key), most_hashes=most)
    want = loop(per_key, most)
    assert got == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each of 10,000 documents shares a hash with the next; every second one is accepted."""
    written = []
    keep = R.materialised
    monkeypatch.setattr(R, "materialised", lambda df, name: (written.append(name), keep(df, name))[1])
    chain = [[({d, d + 1}, {-d - 1}) for d in range(10_000)]]
    got = accepted(rows_of(spark, chain))
    assert got == {("k0", f"d{d:06}") for d in range(0, 10_000, 2)}
    assert written.count("claims") == 1 and written.count("links") <= 16


def test_forests_of_chains_against_a_loop(spark):
    """Rows wait for one row, or for several, along paths that meet and part."""
    rng = random.Random(12)
    per_key = []
    for _ in range(8):
        edges = [(rng.randrange(d), d) for d in range(1, 60)] + [(rng.randrange(59), 59) for _ in range(3)]
        sets = [{10_000 + d} for d in range(60)]
        for e, (a, b) in enumerate(edges):
            sets[a].add(e), sets[b].add(e)
        per_key.append([(s, {-d - 1}) for d, s in enumerate(sets)])
    assert accepted(rows_of(spark, per_key)) == loop(per_key, 10_000)


def test_hashes_are_those_of_a_tuples_first_record(spark):
    """A document's tuple has the hashes of the record it first stands in, whichever pair is counted."""
    texts = spark.createDataFrame([("a", 0, "Ann met Bob and saw Cy then hit Dan or so. Ann met Bob and saw Eve then hit Flo or so")], "docid string, turn int, text string")
    records = fixtures.phrase_records_of(texts)
    plain, equal = nearest_rows(records, None, Defaults(equality=True))
    first = {(r["arg1"], r["rel"], r["arg2"]): r["hashes"] for r in E.tuple_hashes(records, equal).collect()}
    by_sentence = {r["sentid"]: r["hashes"] for r in records.select("sentid", "hashes").collect()}
    in_order = {}
    for r in E.record_tuples(E.indexed(records)).orderBy("sentid", "extrid").collect():
        in_order.setdefault((r["arg1"], r["rel"], r["arg2"]), by_sentence[r["sentid"]])
    assert {k: first[k] for k in in_order} == in_order and set(map(str, by_sentence.values())) == set(map(str, in_order.values()))
    rows = E.document_counts(plain, E.tuple_hashes(records, equal)).collect()
    assert rows and all(r["fhashes"] == first[tuple(r[c] for c in E.PAIR[:3])] and r["shashes"] == first[tuple(r[c] for c in E.PAIR[3:])] for r in rows)
    assert E.document_counts(plain).select(F.count("*")).first()[0] == len(rows)
