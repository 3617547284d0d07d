"""The hand-derived corpus, small loop models, and the line formats."""

import random

import pytest
from pyspark.sql import functions as F

from tuplemill.functions import counts as C
from tuplemill.functions import tuples as T
from tuplemill.operators import extract as E
from tuplemill.operators import inverted
from tuplemill.operators import measures as M
from tuplemill.operators import prepare as P
from tuplemill.operators import reduce as R
from tuplemill.operators import search as S
from tuplemill.operators import stats
from tuplemill.plans.jobs import Defaults, all_tuples, assert_unique, nearest_rows, union
from tuplemill.sources import text

SENTENCE = "Ann met Bob who hired Cy"
BOTH = Defaults(equality=True)


def line(doc, extr, a, r, b, hash_, kind="Type:person", sentence=SENTENCE, sentid=0):
    spans = [f"{t}_SPAN_{s}-{s + len(t)}" for t, s in (a, r, b)]
    return "\t".join([doc, str(sentid), sentence, str(extr), str(hash_), *spans, *spans, kind, ""])


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    for doc, h in (("d1", 11), ("d2", 11), ("d3", 33)):
        rows += [line(doc, 1, ("Ann", 0), ("met", 4), ("Bob", 8), h), line(doc, 2, ("Bob", 8), ("hired", 16), ("Cy", 22), h)]
    df = spark.createDataFrame([(x,) for x in rows], "value string")
    return df.select(text.parse_record(F.col("value")).alias("r")).select("r.*").cache()


@pytest.fixture(scope="module")
def reduced(records):
    plain, equal = nearest_rows(records, None, BOTH)
    rows = E.document_pairs(union(plain, equal)).cache()
    return rows, R.reduced_pairs(rows).cache(), R.reduced_tuples(E.document_tuples(all_tuples(records, equal))).cache()


def test_tuples_per_document(records):
    got = {(r["docid"], r["arg1"], r["rel"], r["arg2"]): r["n"] for r in E.document_tuples(E.record_tuples(E.indexed(records))).collect()}
    assert got == {(d, *t): 1 for d in ("d1", "d2", "d3") for t in (("ann", "met", "bob"), ("type:person", "met", "bob"), ("bob", "hired", "cy"), ("type:person", "hired", "cy"))}


def test_reduced_counts(reduced):
    _, pairs, tuples = reduced
    got = {tuple(r[c] for c in E.PAIR): (r["window"], r["n"]) for r in pairs.collect()}
    plain = {(a, "met", "bob", b, "hired", "cy") for a in ("ann", "type:person") for b in ("bob", "type:person")}
    equal = {(a, "met", "XVAR", b, "hired", "cy") for a in ("ann", "type:person") for b in ("XVAR", "XVAR:type:person")}
    assert got == dict.fromkeys(plain | equal, (1, 2))
    n = {(r["arg1"], r["rel"], r["arg2"]): r["n"] for r in tuples.collect()}
    assert n[("ann", "met", "bob")] == n[("type:person", "hired", "cy")] == 3
    assert n[("ann", "met", "XVAR")] == n[("XVAR", "hired", "cy")] == n[("XVAR:type:person", "hired", "cy")] == 6


def test_heads(reduced):
    heads = R.reduced_heads(reduced[0])
    row = heads.filter("farg1 = 'type:person' and farg2 = 'bob' and sarg1 = 'bob'").first()
    assert row["first_arg1"] == {"Ann": 2} and row["second_arg2"] == {"Cy": 2}


def test_measures_and_search(reduced):
    _, pairs, tuples = reduced
    m = M.measures(pairs, tuples, width=3, directed=1, least=2)
    assert m.count() == 16
    index = M.index(m, alpha=0.5, delta=1.0, more_than=None).cache()
    row = index.filter("farg1 = 'ann' and farg2 = 'bob' and sarg1 = 'bob'").first()
    assert row["counts"] == row["biterm"] == {1: 2, 2: 2, 3: 2} and (row["f"], row["s"]) == (3, 3)
    assert row["first_undir"]["values"] == [0.5] * 3 and row["first_undir"]["combined"] == pytest.approx(0.5)
    flip = index.filter("sarg1 = 'ann' and sarg2 = 'bob' and farg1 = 'bob'").first()
    assert flip["counts"] == {} and flip["biterm"] == row["biterm"] and flip["first_dir"]["combined"] == 0.0

    def found(**how):
        return S.prune(index, S.Query(**how)).select(*E.PAIR).distinct().count()

    typed = "type:person"
    assert found(equality="noequality") + found(equality="typednoequality") == 8
    assert {tuple(r) for r in S.prune(index, S.Query(equality="equality")).select("farg1", "sarg1").collect()} == {("ann", "XVAR"), ("type:person", "XVAR"), ("XVAR", "ann"), ("XVAR", "type:person")}
    assert S.search(index, S.Query(arg1="ann")).count() == 3 and S.search(index, S.Query()).count() == 0
    assert S.search(index, S.Query(arg1=f'"{typed}"'), pruned=False).filter(f"farg1 <> '{typed}'").count() == 0


def test_thresholds(spark):
    rows = spark.createDataFrame([("a", "r", "b", "c", "q", "d", 1, 5)], ", ".join(f"{c} string" for c in E.PAIR) + ", window int, n bigint")
    mapped = M.as_maps(rows)
    assert M.above_directed(mapped, 5).count() == 0 and M.above_directed(mapped, 4).count() == 1
    assert M.undirected(mapped, 5).count() == 2 and M.undirected(mapped, 6).count() == 0
    assert M.frequency_filter(mapped, 10, 5).count() == 0 and M.frequency_filter(mapped, 10, 5, strict=False).count() == 1
    spread = M.cumulated(mapped, 3).first()["counts"]
    assert spread == {1: 5, 2: 5, 3: 5}
    zero = M.frequency_filter(mapped, 3, 1).first()["counts"]
    assert zero == {0: 0, 1: 5, 2: 5}


def test_gate_against_a_loop(spark):
    """Random hash sets; documents in order; a row is accepted if both sides are disjoint from what was accepted."""
    rng = random.Random(4)
    rows, expected = [], {}
    for key in range(30):
        f, s, total = set(), set(), 0
        for doc in range(rng.randint(1, 12)):
            a, b = ({rng.randint(0, 9) for _ in range(rng.randint(1, 2))} for _ in "fs")
            n = rng.randint(1, 5)
            rows.append((f"d{doc:02}", f"k{key}", "r", "b", "c", "q", "d", sorted(a), sorted(b), {1: n}))
            if not (f & a or s & b):
                f, s, total = f | a, s | b, total + n
        expected[f"k{key}"] = total
    df = spark.createDataFrame(rows, "docid string, " + ", ".join(f"{c} string" for c in E.PAIR) + ", fhashes array<int>, shashes array<int>, counts map<int,bigint>")
    assert {r["farg1"]: r["n"] for r in R.reduced_pairs(df).collect()} == expected


def test_pruning_rules(spark):
    lines = [
        line("d", 1, ("Ann", 0), ("met", 4), ("Bob", 8), 1),
        line("d", 2, ("Ann", 0), ("has met", 4), ("Bob", 8), 1),  # same arguments, longer: the shorter goes
        line("d", 3, ("Cy", 22), ("was", 9), ("Bob", 8), 1),
        line("d", 4, ("!!", 0), ("met", 4), ("Dan", 8), 1),
        line("d", 5, ("Eve", 0), ("a b c d e f g h", 4), ("Flo", 8), 1),
        line("d", 6, ("Gus", 0), ("told", 4), ("Hal", 8), 1),
        line("e", 1, ("Ann", 0), ("met", 4), ("Bob", 8), 1),
        line("e", 2, ("Bob", 8), ("met", 4), ("Ann", 0), 1),  # switched and as long: both go
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string").select(text.parse_record(F.col("value")).alias("r")).select("r.*")
    got = [(r["docid"], r["extrid"], r["relHead"]["text"], r["position"]) for r in P.pruned(df).collect()]
    assert got == [("d", 2, "had met", 0)]
    assert P.of_small_documents(df, 2).select("docid").distinct().count() == 1
    assert {r["bin"]: r["documents"] for r in stats.document_sizes(df).collect()} == {10: 2}
    with pytest.raises(ValueError):
        assert_unique(df.union(df))


def test_default_limits(spark, tmp_path):
    """The queries with the reference's limits keep 100 records of a document and 75 words of a sentence, no more."""
    from tuplemill import catalog

    short, long = " ".join(["w"] * 75), " ".join(["w"] * 76)
    texts = [(1, 0, ".".join(["a b c"] * 100)), (2, 0, ".".join(["a b c"] * 101)), (3, 0, short), (4, 0, long)]
    spark.createDataFrame(texts, "conv_id bigint, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    kept = lambda name: {r["docid"] for r in catalog.QUERIES[name](spark, str(tmp_path)).select("docid").distinct().collect()}
    assert kept("doc_size_guard_default") == {"c1", "c3", "c4"} and kept("long_sentence_filter_default") == {"c1", "c2", "c3"}


def test_word_functions(spark):
    def of(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert of(T.inferred_preposition(F.lit("born in"), F.lit("Ann was born there"))) and not of(T.inferred_preposition(F.lit("born in"), F.lit("born in Rome")))
    assert of(T.argument_forms(F.lit("Two"), F.array(F.lit("Type:number"), F.lit("Type:time_unit"), F.lit("")))) == ["two", "type:time_unit"]
    assert of(T.type_name(F.lit("XVAR:type:person"))) == "person" and of(T.display_argument(F.lit("XVAR:type:person"))) == "X:[person]"
    assert not of(T.types_compatible(*map(F.lit, ("XVAR:type:a", "x", "XVAR:type:b", "y")))) and of(T.types_compatible(*map(F.lit, ("XVAR:type:a", "x", "XVAR", "y"))))
    assert of(C.add_until_full(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1)), 1)) == {"a": 1}
    assert of(C.decayed(F.array(F.lit(1.0), F.lit(0.0)), 0.5)) == pytest.approx(0.5 / 0.75) and of(C.decayed(F.array().cast("array<double>"), 0.5)) == 0
    assert of(C.weighted_average(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 1.0
    assert [e["key"] for e in of(C.top_entries(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), 1))] == ["b"]


def test_mentions_widen_equality(spark, records):
    """Ann of the first tuple and Cy of the second are one by a mention cluster."""
    mentions = spark.createDataFrame([("d1", 0, "Ann", 0), ("d1", 0, "Cy", 22)], "docid string, cluster_id int, text string, offset int")
    pairs = E.pairs(E.indexed(records))
    shared = {r["docid"]: r["shared"] for r in E.shared_arguments(pairs, E.mention_keys(records, mentions)).collect()}
    assert shared == {"d1": "12", "d2": "21", "d3": "21"}
    assert P.merge_mentions(records, mentions).filter("has_mentions").select("docid").distinct().count() == 1


def test_merge_keeps_all_records(spark, records):
    """The size bound takes mentions from large mention documents; it drops no record."""
    mentions = spark.createDataFrame([("d1", 0, "Ann", 0), ("x", 0, "Cy", 22)], "docid string, cluster_id int, text string, offset int")
    for most, found in ((2, True), (1, False)):
        got = P.merge_mentions(records, mentions, most).collect()
        assert sorted((r["docid"], r["has_mentions"]) for r in got) == [("d1", found)] * 2 + [("d2", False)] * 2 + [("d3", False)] * 2
        one = next(r for r in got if r["docid"] == "d1")
        assert ([m["text"] for m in one["mentions"]], one["offsets"]) == ((["Ann"], [0]) if found else ([], []))
    kind = "docid string, size bigint, offsets array<bigint>, mentions array<struct<cluster_id int, text string, offset int>>"
    twice = spark.createDataFrame([("d2", 1, [0], [(0, "Bob", 8)]), ("d2", 2, [0], [(0, "Cy", 22)]), ("d3", 101, [0], [(0, "Ann", 0)])], kind)
    got = P.merge_mentions(records, twice).collect()
    assert len(got) == 6 and {(r["docid"], *(m["text"] for m in r["mentions"])) for r in got} == {("d1",), ("d2", "Bob"), ("d3",)}


def test_formats_round_trip(spark, reduced, tmp_path):
    def of(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    good = line("d", 1, ("Ann", 0), ("met", 4), ("Bob", 8), 7)
    document = f"d{text.DOCID_SEP}{good}{text.RECORD_SEP}bad"
    assert of(F.size(text.parse_document(F.lit(document))["records"])) == 1 and of(text.parse_document(F.lit("d"))) is None
    assert of(text.parse_record(F.lit("a\tb"))) is None and of(text.parse_record(F.lit(good.replace("\t7\t", "\tx\t")))) is None
    mentions = f"Ann{text.MENTION_FIELD}0{text.MENTION_VALUE}she{text.MENTION_FIELD}9{text.MENTIONS}bad"
    whole = f"{document}{text.TDOC_SEP}0,25{text.TDOC_SEP}{mentions}"
    parsed = of(text.parse_document_mentions(F.lit(whole)))
    assert parsed["offsets"] == [0, 25] and parsed["mentions"][0]["values"][0]["text"] == "she"
    assert of(text.parse_document_mentions(F.lit(document)))["mentions"] == []
    assert of(text.parse_string_counts(F.lit("a_CSEP_1_ESEP_b_ESEP_c_CSEP_3"))) == {"a": 1, "c": 3} and of(text.parse_window_counts(F.lit("x"))) == {}
    tuple_line = "ann\tmet\tbob\t1,2\ts1_SENT_SEP_s2\td-0-1\tAnn_CSEP_2\tBob_CSEP_2"
    counts = f"{tuple_line}{text.PAIR_SEP}{tuple_line}{text.PAIR_COUNTS_SEP}1:2,3:4{text.PAIR_COUNTS_SEP}a_CSEP_1\tb_CSEP_1\tc_CSEP_1\td_CSEP_1"
    measures = f"{counts}{text.UNDIRECTED_SEP}1:2{text.MEASURES_SEP}5"
    back = of(text.format_measures(text.parse_measures(F.lit(measures))))
    assert back == f"{measures}{text.MEASURES_SEP}0"
    assert of(text.format_tuple_counts(text.parse_tuple_counts(F.lit(tuple_line + "\t9"))["tuple"], F.lit(9))) == tuple_line + "\t9"
    affinity = text.AFFINITY_SEP.join(["0.5,0.25_WSEP_0.37500000"] * 4)
    assert of(text.format_affinities(text.parse_affinities(F.lit(affinity)))) == affinity
    spark.createDataFrame([(counts,), ("bad",)], "value string").write.text(str(tmp_path / "r"))
    assert text.read_pairs(spark, str(tmp_path / "r")).count() == 1
    assert of(text.blocks(F.lit("abcde"), 2)) == ["ab", "cd", "e"]


def test_jobs_end_to_end(spark, records, tmp_path):
    from tuplemill.plans import jobs

    lines = records.select(text.format_record(F.struct("*")).alias("value"))
    text.write(lines, str(tmp_path / "lines"))
    jobs.prepare(spark, str(tmp_path / "lines"), str(tmp_path / "records"))
    d = Defaults(equality=True, min_directed=1, min_undirected=2, measure_window=3)
    jobs.extract(spark, str(tmp_path / "records"), str(tmp_path / "out"), d=d)
    jobs.frequency_filter(spark, str(tmp_path / "out/pairs"), str(tmp_path / "filtered"), least=1)
    jobs.measure(spark, str(tmp_path / "out/pairs"), str(tmp_path / "out/tuples"), str(tmp_path / "measures"), d)
    jobs.build_index(spark, str(tmp_path / "measures"), str(tmp_path / "index"), Defaults(index_min=1))
    assert inverted.InvertedIndex(spark, str(tmp_path / "index")).rows().count() == 16
    with pytest.raises(ValueError):
        nearest_rows(records, None, Defaults(equality=False, noequality=False))
