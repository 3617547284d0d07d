"""Lines of documents and mentions, the jobs from lines to lines, mentions near heads, and resolvers that fail."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tuplemill.operators import coreference as X
from tuplemill.operators import extract as E
from tuplemill.operators import prepare as P
from tuplemill.operators import search as S
from tuplemill.plans import jobs
from tuplemill.sources import documents, fixtures, text


def brute_keys(records, offsets, mentions):
    """For each head what it may refer to: itself, and all short mentions of the clusters with one that covers it."""
    out = {}
    for r in records:
        for side in (1, 2):
            h, off = r[f"arg{side}Head"], offsets.get((r["docid"], r["sentid"]), -1_000_000)
            start, end = h["start"] + off, h["end"] + off
            keys = {(h["text"].lower(), start, end)}
            short = [m for m in mentions if m[0] == r["docid"] and len(m[2].split(" ")) <= 5]
            clusters = {m[1] for m in short if m[3] <= start and m[3] + len(m[2]) >= end}
            keys |= {(m[2].lower(), m[3], m[3] + len(m[2])) for m in short if m[1] in clusters}
            out[r["docid"], r["sentid"], r["extrid"], side] = keys
    return out


def test_mention_keys_meet_just_when_the_mentions_do(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))
    texts = [(f"d{i}", 0, ". ".join(" ".join(word() for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 6)))) for i in range(12)]
    records = fixtures.phrase_records_of(spark.createDataFrame(texts, "docid string, turn int, text string")).cache()
    offsets = {(r["docid"], r["sentid"]): r["offset"] for r in P.sentence_offsets(P.with_short_sentences(records)).collect()}
    rows = []
    for i in range(12):
        for _ in range(40):
            rows.append((f"d{i}", rng.randint(0, 5), " ".join(word() for _ in range(rng.choice([1, 1, 2, 5, 6]))), rng.randint(-3, 400)))
        rows += [(f"d{i}", c, "x" * 300, 5) for c in (6, 7)] + [(f"d{i}", 8, "", 9)] + rows[-3:-1]
    mentions = spark.createDataFrame(rows, "docid string, cluster_id int, text string, offset int")
    got = E.mention_keys(records, mentions).collect()
    want = brute_keys(records.collect(), offsets, rows)
    have = {(r["docid"], r["sentid"], r["extrid"], side): set(r[f"keys{side}"]) for r in got for side in (1, 2)}
    assert have.keys() == want.keys()
    for a in want:
        for b in want:
            if a[:2] == b[:2]:
                assert bool(have[a] & have[b]) == bool(want[a] & want[b])


def test_heads_meet_only_mentions_near_them(spark):
    """A document of 100,000 mentions; the rows that a head meets don't grow with them."""
    n = 100_000
    heads = spark.range(n).select(F.lit("d").alias("docid"), F.col("id").cast("int").alias("sentid"), F.lit(0).alias("extrid"), F.lit(0).alias("side"), (F.col("id") * 8).alias("start"), (F.col("id") * 8 + 4).alias("end"))
    mentions = spark.range(n).select(F.lit("d").alias("docid"), F.col("id").cast("int").alias("cluster_id"), (F.col("id") * 8).alias("mstart"), (F.col("id") * 8 + 6).alias("mend"))
    hits = E.covering(heads, mentions)
    assert hits.filter("sentid = cluster_id").count() == hits.count() == n
    cells = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in cells and "NestedLoop" not in cells
    near = heads.withColumn("cell", F.floor(F.col("start") / E.CELL)).join(mentions.withColumn("cell", F.explode(F.sequence(F.floor(F.col("mstart") / E.CELL), F.floor(F.col("mend") / E.CELL)))), ["docid", "cell"])
    assert near.count() < 10 * n


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("a", 0, "Ann Lee met Bob in Rome then she told Cy it was old.\nLee saw Rome and he hit Dan Roe"), ("b", 0, "one two three four five six seven eight nine ten eleven"), ("c", 0, "Ann Lee met Bob in Rome then she told Cy it was old.\nnine ten eleven twelve more of it all over now")]
    return spark.createDataFrame(rows, "docid string, turn int, text string")


def test_lines_round_trip(spark, texts, tmp_path):
    records = fixtures.phrase_records_of(texts).cache()
    mentions = spark.createDataFrame([("a", 0, "Ann Lee", 0), ("a", 0, "she", 29), ("a", 3, "Rome", 19), ("b", 1, "two", 4)], "docid string, cluster_id int, text string, offset int")
    offsets = P.sentence_lists(records).select("docid", "offsets")
    text.write(documents.lines(records, mentions, offsets), str(tmp_path / "one"))
    with open(tmp_path / "bad.txt", "w") as f:
        f.write("no document\n")
    spark.read.text([str(tmp_path / "one"), str(tmp_path / "bad.txt")]).write.text(str(tmp_path / "both"))
    back = documents.read(spark, str(tmp_path / "both"))
    assert back.counts == {"parsed": 3, "failed": 1}
    same = back.records.drop("place", "arg1Types", "arg2Types")  # without types, a line has one empty type
    assert same.exceptAll(records.select(same.columns)).count() == 0 == records.select(same.columns).exceptAll(same).count()
    assert sorted((r["docid"], r["cluster_id"], r["key"]["text"], r["text"], r["offset"]) for r in back.mentions.collect()) == [("a", 0, "Ann Lee", "Ann Lee", 0), ("a", 0, "Ann Lee", "she", 29), ("a", 1, "Rome", "Rome", 19), ("b", 0, "two", "two", 4)]
    text.write(documents.lines(*back[:3]), str(tmp_path / "two"))
    lines = [sorted(r["value"] for r in spark.read.text(str(tmp_path / p)).collect()) for p in ("one", "two")]
    assert lines[0] == lines[1] and len(lines[0]) == 3
    plain = documents.lines(records).collect()
    assert len(plain) == 3 and not any(text.TDOC_SEP in r["value"] for r in plain)


def test_jobs_from_lines_to_lines(spark, texts, tmp_path):
    at = lambda name: str(tmp_path / name)
    records = fixtures.phrase_records_of(texts.union(texts.withColumn("docid", F.concat("docid", F.lit("2")))).union(texts.withColumn("docid", F.concat("docid", F.lit("3")))))
    records = records.withColumn("hashes", F.when(F.col("docid").endswith("3"), F.transform("hashes", lambda h: h + 1)).otherwise(F.col("hashes")))
    lines = records.select(text.format_record(F.struct(*documents.FIELDS)).alias("value"))
    text.write(lines.union(spark.createDataFrame([("x\ty",)], "value string")), at("records"))
    assert jobs.prepare(spark, at("records"), at("documents"), lines=True) == {"parsed": records.count(), "failed": 1}
    assert jobs.resolve(spark, at("documents"), at("resolved"))["failed"] == 0
    jobs.merge_mentions(spark, at("documents"), at("resolved/documents"), at("merged"))
    d = jobs.Defaults(equality=True, min_directed=1, min_undirected=1, measure_window=3, index_min=0)
    jobs.extract(spark, at("merged"), at("lines"), d=d, from_lines=True, lines=True)
    docs = documents.read(spark, at("merged"))
    docs.records.write.parquet(at("table/records")), docs.mentions.write.parquet(at("table/mentions"))
    jobs.extract(spark, at("table/records"), at("out"), at("table/mentions"), d=d)
    pairs, again = spark.read.parquet(at("out/pairs")), text.read_pairs(spark, at("lines/pairs"))
    shown = lambda df: sorted((str(sorted(r.asDict(True).items())) for r in df.collect()))
    assert shown(pairs) == shown(again) and pairs.count() > 0
    one = pairs.filter("farg1 = 'lee' and farg2 = 'in'").first() or pairs.first()
    assert one["first"]["ids"] and one["first"]["sentences"] and one["first"]["arg1_heads"] and len(one["first"]["hashes"]) >= 2
    tuples = spark.read.parquet(at("out/tuples"))
    assert shown(tuples) == shown(text.read_tuples(spark, at("lines/tuples")))
    jobs.frequency_filter(spark, at("lines/pairs"), at("filtered"), least=1, from_lines=True, lines=True)
    kept = text.read_pairs(spark, at("filtered"))
    assert 0 < kept.count() <= pairs.count()
    jobs.measure(spark, at("lines/pairs"), at("lines/tuples"), at("measures"), d, from_lines=True, lines=True)
    jobs.measure(spark, at("out/pairs"), at("out/tuples"), at("table/measures"), d)
    measures = text.read_measures(spark, at("measures"))
    assert shown(measures) == shown(spark.read.parquet(at("table/measures")).select(measures.columns)) and measures.count() >= 2
    flip = measures.filter(F.size("counts") == 0).first()
    assert flip["first"]["arg1"] == flip["farg1"] and flip["second"]["rel"] == flip["srel"]
    index = jobs.build_index(spark, at("measures"), at("index"), d, from_lines=True)
    row = measures.first()
    assert S.search(index, S.Query(arg1=f'"{row["farg1"]}"'), pruned=False).count() > 0
    jobs.index_records(spark, at("documents"), at("record-index"), from_lines=True)
    r = docs.records.first()
    assert S.find_record(spark.read.parquet(at("record-index")), f"{r['docid']}-{r['sentid']}-{r['extrid']}").first()["id"] == f"{r['docid']}-{r['sentid']}-{r['extrid']}"
    assert jobs.statistics(spark, at("documents"), at("sizes"))["parsed"] == spark.read.parquet(at("sizes")).selectExpr("sum(documents)").first()[0]
    (tmp_path / "old").mkdir()
    (tmp_path / "old/x.txt").write_bytes("né\n\nü".encode("latin-1"))
    text.recode(spark, at("old"), at("utf8"), "iso-8859-1")
    assert sorted(r["value"] for r in spark.read.text(at("utf8")).collect()) == ["", "né", "ü"]


def test_sieve():
    text_ = "Ann Lee met Bob\nlater Lee told him that she likes Rome\nIt is old\nThen the Romans came"
    clusters = {}
    for c, t, o in X.sieve(text_):
        assert text_[o : o + len(t)] == t
        clusters.setdefault(c, []).append(t)
    assert sorted(map(sorted, clusters.values())) == [["Ann Lee", "Lee", "him"], ["Bob", "she"], ["It", "Rome"]]  # kinds tell pronouns apart, not who they are
    assert X.sieve("") == [] and X.sieve("all small letters\nit rains") == []
    assert X.sieve("Ann Lee and Bob Lee met\nLee left") == []  # Lee is one of two


def test_clusters_feed_the_arguments(spark):
    """Two arguments of a sentence that one cluster covers are shared."""
    records = fixtures.phrase_records_of(spark.createDataFrame([("a", 0, "Rome x y z near then by and Rome x y z too")], "docid string, turn int, text string"))
    mentions = spark.createDataFrame([("a", 0, "Rome", 0), ("a", 0, "Rome", 8)], "docid string, cluster_id int, text string, offset int")
    pairs = E.pairs(E.indexed(records))
    without = E.shared_arguments(pairs, E.mention_keys(records, None)).count()
    assert E.shared_arguments(pairs, E.mention_keys(records, mentions)).count() >= without


def test_a_failing_resolver_loses_its_document_only(spark):
    def resolver(t):
        if t == "bad":
            raise ValueError("no")
        if t == "slow":
            while True:
                time.sleep(0.01)
        return None if t == "none" else "xy" if t == "odd" else [(0, t, 0)]

    rows = [("a", "good"), ("b", "bad"), ("c", "slow"), ("d", "none"), ("e", "odd"), ("f", None), ("g", "fine")]
    got = {r["docid"]: r for r in X.resolved(spark.createDataFrame(rows, "docid string, text string").coalesce(1), resolver, timeout=0.5).collect()}
    assert {d: (r["error"] or "").split(":")[0] for d, r in got.items()} == {"a": "", "b": "ValueError", "c": "TimeoutError", "d": "gave up", "e": "ValueError", "f": "", "g": ""}
    assert [m["text"] for m in got["g"]["mentions"]] == ["fine"] and got["f"]["mentions"] == [] and got["c"]["mentions"] is None
