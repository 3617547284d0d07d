import hashlib
import random
import re
from collections import Counter

import numpy as np

from tuplemill.llm import repeats, superkmer
from tuplemill.llm.suffix_dedup import dedup_bytes, suffix_order
from tuplemill.llm.superkmer import dedup_words


def brute_bytes(docs, window):
    starts = Counter(t[i : i + window] for _, t in docs for i in range(len(t) - window + 1))
    out = []
    for d, t in docs:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if starts[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(docs, window):
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", t) for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), (d, i))
    out = []
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]


def test_suffix_order_against_sorting():
    rng = random.Random(3)
    for _ in range(150):
        parts, bounds = [], [0]
        for _ in range(rng.randint(1, 6)):
            letters = rng.choice([1, 2, 3, 20])
            parts += [rng.randint(1, letters) for _ in range(rng.randint(0, 60))] + [0]
            bounds.append(len(parts))
        got = suffix_order(np.array(parts, np.int16), np.array(bounds, np.int64))
        for a, b in zip(bounds, bounds[1:]):
            assert list(got[a:b]) == sorted(range(a, b), key=lambda i: parts[i:b])


def test_bytes_against_brute_force(corpus):
    for window in (200, 40):
        got = sorted(map(tuple, dedup_bytes(corpus, window).collect()))
        assert got == brute_bytes(rows_of(corpus), window)


def test_words_against_brute_force(corpus):
    for window in (20, 5):
        got = sorted(map(tuple, dedup_words(corpus, window).collect()))
        assert got == brute_words(rows_of(corpus), window)


def test_kept_texts(corpus):
    for r in dedup_bytes(corpus, 40, with_text=True).collect():
        assert len(r["kept"].encode()) <= r["n_bytes"] - r["n_removed"]
    for r in dedup_words(corpus, with_text=True).collect():
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_empty_tables_and_repeated_rows(spark, empty):
    assert dedup_bytes(empty).count() == dedup_words(empty).count() == 0
    text = " ".join(f"v{i}" for i in range(60))
    twice = spark.createDataFrame([(1, text), (1, text), (None, "a b")], "doc_id bigint, text string")
    assert sorted(r["n_removed"] for r in dedup_words(twice).collect()) == [0, 0, 0]
    assert sorted(r["n_removed"] for r in dedup_bytes(twice).collect()) == [0, len(text), len(text)]


def test_many_passages_at_random_places(spark):
    """Passages of all lengths around a window's, in unlike surroundings: the filter must lose none of their windows."""
    rng = random.Random(12)
    word = lambda: f"{rng.choice('abcdefg')}{rng.randint(0, 9999)}"
    passages = [[word() for _ in range(rng.randint(18, 70))] for _ in range(40)]
    rows = []
    for i in range(250):
        words = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            words += rng.choice(passages) + [word() for _ in range(rng.randint(0, 60))]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, dedup_bytes(df).collect())) == brute_bytes(rows_of(df), 200)
    assert sorted(map(tuple, dedup_words(df).collect())) == brute_words(rows_of(df), 20)


def thue_morse(n):
    """A word over a and b, and its complement; polynomial hashes modulo 2**64 don't tell such words apart."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_defeat_polynomial_hashes(spark):
    one, two = thue_morse(2048)
    same = " ".join(f"v{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {two}"), (3, f"{one} {two}"), (4, f"{same} {one}")], "doc_id bigint, text string")
    assert sorted(map(tuple, dedup_words(df).collect())) == brute_words(rows_of(df), 20)
    assert sorted(map(tuple, dedup_bytes(df).collect())) == brute_bytes(rows_of(df), 200)


def test_unlike_windows_of_one_hash(spark, corpus, monkeypatch):
    """If all hashes of windows were equal, bytes would still decide."""
    monkeypatch.setattr(superkmer, "grams_hash", lambda codes, m: np.zeros(len(codes) - m + 1, np.uint64))
    data = [b"a b c d", b"b c d e", b"a b c d", b"x y z w"]
    s = repeats.Strings(np.zeros(4, np.int64), np.array([2, 2, 2, 2], np.int32), data, np.array([3, 1, 2, 4]), np.zeros(4, np.int64), np.ones(4, np.int64))
    got = superkmer.later_windows(repeats.Scheme("word", 3, 1, 2), s)
    assert [g.tolist() for g in got] == [[True, True], [False, False], [False, True], [False, False]]


def test_large_buckets_are_dealt_anew(spark, corpus, monkeypatch):
    """Every bucket of two strings is taken as too large, level by level; rows stay the same."""
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 300)
    rng = random.Random(5)
    passage = " ".join(f"{rng.choice('abcdefg')}{rng.randint(0, 9999)}" for _ in range(60))
    rows = [(1000 + i, f"{rng.randint(0, 9**9)} {passage[rng.randint(0, 9) :]} {rng.randint(0, 99)} {rng.randint(0, 9**9)}") for i in range(60)]
    df = corpus.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, dedup_bytes(df).collect())) == brute_bytes(rows_of(df), 200)
    assert sorted(map(tuple, dedup_bytes(df, 40).collect())) == brute_bytes(rows_of(df), 40)
    assert sorted(map(tuple, dedup_words(df).collect())) == brute_words(rows_of(df), 20)
