import pytest
from pyspark.sql import functions as F

from tuplemill.llm import decontam, merkle


@pytest.fixture(scope="module")
def items(spark):
    words = [f"q{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 40 : k * 40 + n])) for k, n in enumerate((40, 12, 5, 3, 30))] + [(90, None), (91, ""), (0, " ".join(words[:40]))]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def brute(docs, items, k=5, percent=80):
    def sets(t, n):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    width = {i: min(k, len((t or "").split())) for i, t in items}
    named = {i: (width[i], sets(t, width[i])) for i, t in items if width[i]}
    found = ((d, i, len(s), len(s & sets(t, n))) for d, t in docs for i, (n, s) in named.items())
    return sorted((x for x in found if 100 * x[3] >= percent * x[2]), key=str)


def test_containment_against_brute_force(spark, corpus, items):
    planted = {r["item_id"]: r["text"] for r in items.collect()}
    texts = [f"start here {planted[0]} and more", planted[0][: len(planted[0]) * 85 // 100], planted[0][: len(planted[0]) // 2], f"x {planted[1].upper()}", planted[3], f"a {planted[3]} b", planted[4] + " " + planted[2], None, "", planted[4]]
    rows = [(5000 + i, t) for i, t in enumerate(texts)] + [(None, planted[4]), (5009, planted[4])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").union(corpus.select("doc_id", "text"))
    got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in decontam.contained_items(docs, items).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.dropDuplicates().collect()])
    clean = decontam.decontaminated(docs, items)
    assert clean.count() == docs.count() - len({(d, t) for d, t in rows if any(x[0] == d for x in got)}) - 1  # 5009 stands twice
    assert decontam.contained_items(docs.limit(0), items).count() == decontam.contained_items(docs, items.limit(0)).count() == 0


def test_short_items_are_found_inside_long_documents(spark):
    items = spark.createDataFrame([(1, "Blue  whale sings"), (2, "one"), (3, "four words are these"), (4, "exactly five words stand here")], "item_id bigint, text string")
    filler = " ".join(f"f{i}" for i in range(1000))
    texts = [f"{filler} blue whale\nSINGS {filler}", "blue whale sings", "blue whale x sings", "x one", "on e", "four words are these", "four words are", "exactly five words stand here too", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.contained_items(docs, items).collect())
    assert got == [(0, 1), (1, 1), (3, 2), (5, 3), (7, 4)]
    assert {r["doc_id"] for r in decontam.decontaminated(docs, items).collect()} == {2, 4, 6, 8, 9}


def test_containment_by_shuffle_and_with_clashing_columns(spark, corpus, items, monkeypatch):
    planted = items.filter("item_id = 0").first()["text"]
    rows = [(6000 + i, f"{planted} {i}" if i % 3 else "x", "a", "b", 1) for i in range(60)] + [(None, planted, None, None, 2), (None, "x", "a", "b", 3), (7000, "w " * 30_000 + planted, "a", "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, doc_place string, item_key string, h int")
    got = {r for r in decontam.contained_items(docs, items).collect()}
    left = decontam.decontaminated(docs, items)
    assert left.columns == docs.columns and {r["h"] for r in left.collect()} == {1, 3} and left.count() == 21
    assert {r["doc_id"] for r in got} == {6000 + i for i in range(60) if i % 3} | {None, 7000}
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert {r for r in decontam.contained_items(docs, items).collect()} == got
    assert decontam.decontaminated(docs, items).count() == 21


def test_fingerprints(spark, corpus, empty):
    got = {r["doc_id"]: r for r in merkle.fingerprints(corpus).collect()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in corpus.collect())
    by_text = {}
    for k, (d, t) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][1], len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        import hashlib

        assert got[d]["n_chars"] == n and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        assert by_text.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
        assert (got[d]["near_edited"] == 1) >= (t == edited) and (got[d]["near_next"] == 1) >= (t == after)
    assert len(set(by_text.values())) == len(by_text)
    assert merkle.fingerprints(empty).count() == 0


def test_edits_are_located(spark):
    text = "one two\nthree four\n\nfive six\nseven eight"
    a = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    b = a.withColumn("text", F.when(F.col("doc_id") == 1, F.replace("text", F.lit("seven"), F.lit("7"))).otherwise(F.col("text")))
    assert [tuple(r) for r in merkle.edits(merkle.trees(a), merkle.trees(b)).collect()] == [(1, 1, 1)]
