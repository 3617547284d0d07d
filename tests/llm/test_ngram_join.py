import random
import re

import numpy as np
import pytest

from tuplemill.llm import ngram_join
from tuplemill.llm.components import components
from tuplemill.llm.arrays import Shingles, binary_column
from tuplemill.llm.ngram_join import bands, bound_holds, folded, jaccard_groups, jaccard_links, signatures
from tests.llm.test_repeats import thue_morse


def brute(rows, k=4, percent=85):
    sets = []
    for _, t in rows:
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, len(s), min(groups[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def check(df, **how):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard_groups(df, **how).collect())) == brute(rows, **how)


def test_against_brute_force(corpus):
    check(corpus)
    check(corpus, k=2, percent=50)


def test_chains_and_crowded_tiles(spark, monkeypatch):
    """Texts that differ from neighbours in a few words: links chain, and tiles are split into blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(11)
    rows, words = [], [f"w{i}" for i in range(80)]
    for i in range(120):
        words = list(words)
        words[rng.randrange(80)] = f"n{i}"
        if rng.random() < 0.5:
            words.append(f"m{i}")
        rows.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent in (85, 70):
        check(df, percent=percent)


def test_crowded_tiles_in_rounds(spark, monkeypatch):
    """Copies with many edits each share tiles, but few link: each node's nearest comes first, the rest after it."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in rng.sample(range(90), rng.choice([1, 2, 3, 4])):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent in (85, 75, 60):
        check(df, percent=percent)


def test_words_that_defeat_polynomial_hashes(spark):
    one, two = thue_morse(2048)
    rest = "a b c d e f g h i j k l m n o p"
    check(spark.createDataFrame([(1, one), (2, two), (3, f"{one} {rest}"), (4, f"{two} {rest}"), (5, one)], "doc_id bigint, text string"))


def test_all_links(spark, corpus):
    """Every link between unlike sets, with each document's number of links."""
    links, documents = jaccard_links(corpus)
    node = {r["doc_id"]: (r["node"], r["n_links"]) for r in documents.collect()}
    sets = {}
    for r in corpus.collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode()))
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset({tuple(w)} if w else ())
    assert set(node) == set(sets)
    unlike = sorted(set(sets.values()), key=lambda x: sorted(x))
    expected = {frozenset((a, b)) for i, a in enumerate(unlike) for b in unlike[:i] if a and b and 100 * len(a & b) >= 85 * len(a | b)}
    of = {node[d][0]: s for d, s in sets.items() if s}
    assert {frozenset((of[r["a"]], of[r["b"]])) for r in links.collect()} == expected
    for d, s in sets.items():
        assert (node[d][0] is None) == (not s) and node[d][1] == sum(s in e for e in expected)


def test_edges_of_input(spark, empty):
    assert jaccard_groups(empty).count() == 0
    same = "a b c d e"
    df = spark.createDataFrame([(5, same), (5, same), (None, same), (2, "A B c d E"), (7, None), (None, "")], "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard_groups(df).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (None, 2, 2), (2, 2, 2), (7, 0, 7), (None, 0, None)], key=str)


def test_bound_never_drops_a_link():
    rng = np.random.default_rng(2)
    for _ in range(500):
        base = rng.integers(1, 2**63, rng.integers(1, 300)).astype(np.uint64)
        a = np.unique(base[rng.random(len(base)) < 0.95])
        b = np.unique(base[rng.random(len(base)) < 0.95])
        if not len(a) or not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 85 * (len(a) + len(b) - shared):
            n = np.array([len(a), len(b)])
            z = np.zeros(0, np.int64)
            raw = binary_column(*signatures(Shingles(np.repeat([0, 1], n), np.concatenate((a, b)), z, z), n))
            low, high = sorted(bands(n))
            assert high - low <= 1
            one, two = folded(raw, (1 << low) // 8)
            differ = int(np.bitwise_count(one ^ two).sum())
            assert bound_holds(85, np.array([len(a)]), np.array([len(b)]), np.array([differ]))[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 400 + i) for i in range(20)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got) == set(label)
    assert len({(got[x], label[x]) for x in got}) == len(set(label.values())) == len(set(got.values()))
