"""Product codes and exact searches against brute force over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tuplemill.llm import vector_codes, vector_search

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, score double, block int, place int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, many equal vectors, repeated rows, ties, nulls, non-finite and huge components, other lengths, clashing columns."""
    rng = random.Random(3)
    rows = []
    for i in range(150):
        centre = (i % 5) / 7
        rows.append((i * 4 - 20, [round(rng.gauss(centre if j % 2 else -centre, 0.1), 3) for j in range(16)], i % 4 or None))
    rows += [(1000 + 5 * i, rows[7][1], 2) for i in range(40)]
    rows += [rows[0], rows[0], (None, rows[3][1], None), (None, rows[3][1], 1), (rows[10][0], rows[11][1], 0)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1), (2020, [None] + [0.0] * 15, 1), (2040, [nan] * 16, 1), (2060, [inf] + [0.0] * 15, 1), (2080, [], 1), (2100, [0.5] * 8, 1), (2120, [3e30] * 16, 1)]
    rows += [(2200, [0.0] * 16, 9), (2220, [-0.0001] * 16, 9)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, e, lab, "c", 0.5, 1, 2) for i, e, lab in rows], SCHEMA).repartition(5)


def clean(vectors, scale):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    good = [(i, e, lab) for i, e, lab in rows if e is not None and len(e) == 16 and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in e)]
    return [(i, [math.floor(scale * x) for x in e], lab) for i, e, lab in good]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def test_codes_against_brute_force(vectors):
    rows = clean(vectors, 4096)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = lambda x: [tuple(x[2 * k : 2 * k + 2]) for k in range(8)]
    books = [[parts(r[1])[k] for r in order[:16]] for k in range(8)]
    for _ in range(6):
        for k in range(8):
            own = [[] for _ in range(16)]
            for _, x, _ in rows:
                p = parts(x)[k]
                own[min(range(16), key=lambda e: (far(p, books[k][e]), e))].append(p)
            books[k] = [tuple(sum(c) // len(ps) for c in zip(*ps)) if ps else b for ps, b in zip(own, books[k])]
    want = []
    for i, x, lab in rows:
        e = [min(range(16), key=lambda e: (far(parts(x)[k], books[k][e]), e)) for k in range(8)]
        want.append([i, lab, bytes(e).hex(), sum(far(parts(x)[k], books[k][e[k]]) for k in range(8))])
    for w in want:
        w.append(sum(v[3] for v in want if v[1] == w[1]))
    got = vector_codes.product_codes(vectors).collect()
    assert sorted(([r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]] for r in got), key=str) == sorted(want, key=str)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_few_and_no_rows(vectors):
    assert vector_codes.product_codes(vectors.limit(0)).count() == 0
    assert vector_codes.product_codes(vectors.filter("vec_id in (2000, 2040)")).count() == 0
    few = vector_codes.product_codes(vectors.filter("vec_id in (2200, 2220)")).orderBy("vec_id").collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in few] == [("00" * 8, 0, 0), ("01" * 8, 0, 0)]
    with pytest.raises(ValueError):
        vector_codes.product_codes(vectors, parts=7)


def test_labels_small_and_large_meet_their_sums(vectors, monkeypatch):
    want = sorted(map(str, vector_codes.product_codes(vectors, rounds=1).collect()))
    for share in (1, 10**9):  # no label is large; all are
        monkeypatch.setattr(vector_codes, "HOT_SHARE", share)
        assert sorted(map(str, vector_codes.product_codes(vectors, rounds=1).collect())) == want


def test_trees_find_the_nearest_and_skip_entries():
    rng = np.random.default_rng(5)
    for entries in (rng.integers(-50, 50, (16, 3)), rng.integers(0, 2, (16, 2)), rng.integers(-(2**27), 2**27, (16, 4)), np.zeros((16, 2), np.int64), rng.integers(0, 9, (1, 2))):
        tree = vector_codes.build(entries)
        x = np.concatenate((entries, rng.integers(entries.min() - 2, entries.max() + 3, (500, entries.shape[1]))))
        best, square, taken = vector_codes.nearest(tree, entries, x)
        all_ = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (best == all_.argmin(axis=1)).all() and (square == all_.min(axis=1)).all() and taken <= all_.size
    spread = np.repeat(np.arange(16) * 1000, 2).reshape(16, 2)
    assert vector_codes.nearest(vector_codes.build(spread), spread, spread + 1)[2] < 16 * 16 * 0.7


def brute_top(rows, k):
    out = []
    for q, (i, x, _) in enumerate(rows):
        if i is not None and i % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(x, y)), j is None, j or 0) for c, (j, y, _) in enumerate(rows) if c != q]
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, query_block, k", [(8192, 1024, 20), (40, 5, 20), (7, 3, 5), (8192, 1024, 500)])
def test_search_against_brute_force(vectors, block, query_block, k):
    got = vector_search.top_products(vectors, k=k, block=block, query_block=query_block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_top(clean(vectors, 64), k)


def test_search_of_few_and_no_rows(vectors):
    assert vector_search.top_products(vectors.limit(0)).count() == 0
    assert vector_search.top_products(vectors.filter("vec_id = 2200")).count() == 0
    two = vector_search.top_products(vectors.filter("vec_id in (2200, 2220)")).orderBy("query_id").collect()
    assert [tuple(r) for r in two] == [(2200, 1, 2220, 0), (2220, 1, 2200, 0)]


def test_bounds_hold_and_most_vectors_are_not_read():
    rng = np.random.default_rng(11)
    for spread in (8, 2**20, 2**27):
        x = rng.normal(0, spread, (3000, 12)).astype(np.int64)
        cells, low, high = vector_search.quantise(x)
        q = x[:40]
        below, above = vector_search.bounds(q, cells, low, high)
        exact = q @ x.T
        assert (below <= 2 * exact).all() and (2 * exact <= above).all()
        places, scores, read = vector_search.search(q, cells, low, high, x, np.arange(len(x)), 10, np.arange(40))
        for k in range(40):
            others = np.delete(np.arange(len(x)), k)
            order = others[np.lexsort((others, -exact[k, others]))][:10]
            assert (places[k] == order).all() and (scores[k] == exact[k, order]).all()
        assert read < exact.size / 8
