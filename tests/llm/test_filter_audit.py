"""The audit against filters applied one after another."""

import random
from itertools import permutations

from tuplemill.llm import filter_audit


def brute(docs, labels):
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1 and r["doc_id"] is not None} for c in ("quality", "toxic"))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
        fails = ""
        fails += "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * (d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs))
        rows.append((lang or "", fails, d in good, d in toxic))
    out, removed = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(failing) - len(gone), sum(r[1] == f for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone))
                removed[part, f] = removed.get((part, f), 0) + len(gone)
    return {key: (*v, removed[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_against_filters_one_by_one(spark, corpus):
    rng = random.Random(4)
    long_ = " ".join(f"w{i}" for i in range(250))
    rows = [tuple(r) for r in corpus.collect()]
    texts = [long_, long_, long_ + " #", long_.upper(), "a b " * 150, "\tA\x0bB\x0c#\r\n ", " " * 5000, "É" * 40, "x y", "a " * 60_000, long_.replace("w1", "$")]
    rows += [(1000 + i, t, rng.choice(["en", "", None, "xx"]), "s", 1) for i, t in enumerate(texts)]
    rows += [(None, long_, "en", "s", 1), (None, long_, "en", "s", 1), (1000, long_, "fr", "s", 1), (1000, long_, "fr", "s", 1), (900, "A #", "en", "s", 1), (900, "A #", None, "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, mask int, key string").repartition(4)
    marks = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.6] + [(None, 1, 1), (77777, 1, 1), (1000, 1, 0), (1000, 0, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    want = brute([(r[0], r[1], r[2]) for r in rows], labels.collect())
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[3:] == want[r["part"], r["filter_order"], r["step"]]


def test_empty_tables(spark, corpus, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(empty, none).count() == 0
    rows = filter_audit.audit(corpus, none)
    assert rows.count() == 600 * corpus.selectExpr("coalesce(lang, '')").distinct().count() and rows.filter("good_lost + toxic_lost > 0").count() == 0
