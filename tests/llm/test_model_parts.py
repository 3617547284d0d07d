"""Parts of the trained operators against plain Python: counts and FTRL steps of op2, features and boosting rounds of op9."""

import math
import random

import numpy as np
import pyarrow as pa

from tuplemill.llm import fitting, langid, quality_gam


def grams_by_hand(text):
    """Counts of n-gram hashes, computed code point by code point."""
    points = [ord(c) + 32 if 65 <= ord(c) <= 90 or (0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7) else ord(c) for c in text]
    seeds, mask, out = [int(s) for s in langid._SEEDS], 0xFFFFFFFF, {}
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            h = 0
            for k in range(n):
                h = ((h ^ points[i + k]) * seeds[k]) & mask
                h ^= h >> 15
            bucket = ((h * seeds[n - 1]) & mask) >> 19
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_counts_of_character_grams():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbÉéß中😀 .x") for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["", "é", "AB"]
    got = np.concatenate(list(langid.gram_counts(pa.array(texts))))
    assert len(got) == len(texts)
    for t, row in zip(texts, got):
        assert {int(b): int(row[b]) for b in np.flatnonzero(row)} == grams_by_hand(t)


def test_ftrl_steps_by_hand():
    """Every coordinate of a learner after many steps, against the recurrences written out for each."""
    rng = random.Random(6)
    alpha, beta, l1, l2, features, classes = 0.5, 1.0, 0.6, 0.1, 7, 3
    learner = fitting.Ftrl(features, classes, alpha, beta, l1, l2)
    z, n = [[0.0] * classes for _ in range(features + 1)], [[0.0] * classes for _ in range(features + 1)]  # the last row is the bias

    def weight(i, c):
        if abs(z[i][c]) <= (l1 if i < features else 0.0):
            return 0.0
        return -(z[i][c] - math.copysign(l1 if i < features else 0.0, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    for _ in range(60):
        index = sorted(rng.sample(range(features), 3))
        value, label = [rng.random() for _ in index], rng.randrange(classes)
        w = {(i, c): weight(i, c) for i in [*index, features] for c in range(classes)}
        logits = [sum(v * w[i, c] for i, v in zip(index, value)) + w[features, c] for c in range(classes)]
        total = sum(math.exp(x) for x in logits)
        for c in range(classes):
            error = math.exp(logits[c]) / total - (c == label)
            for i, v in [*zip(index, value), (features, 1.0)]:
                g, old = error * v, n[i][c]
                n[i][c] = old + g * g
                z[i][c] += g - (math.sqrt(n[i][c]) - math.sqrt(old)) / alpha * w[i, c]
        learner.learn(np.array(index), np.array(value), label)
    got, bias = learner.weights()
    assert np.allclose(got, [[weight(i, c) for c in range(classes)] for i in range(features)], atol=1e-6) and (got == 0).any()
    assert np.allclose(bias, [weight(features, c) for c in range(classes)], atol=1e-6)


def features_by_hand(text):
    raw = text.encode()
    words = raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\v", b" ").replace(b"\f", b" ").split(b" ")
    words = [w for w in words if w]
    low, n, k = [w.lower() for w in words], max(1, len(raw)), max(1, len(words))
    marks = {c for c in range(33, 127) if not chr(c).isalnum()}
    share = lambda chars: sum(b in chars for b in raw) / n
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / k, share(set(range(65, 91))), share(set(range(48, 58))), share(marks), share(b"!"), share(b"|"),
        share(b"#$%&*@^~<>{}[]\\=+_"), share(b".,;:?"), share(set(range(128, 256))), sum(a == b for a, b in zip(low, low[1:])) / k, sum(a == b for a, b in zip(low, low[2:])) / k,
        len(set(low)) / k**0.8, sum(w[-1] in marks for w in words) / k, len(words) / (raw.count(b"\n") + 1), math.log1p(max(map(len, words), default=0)), sum(65 <= w[0] <= 90 for w in words) / k,
    ]


def test_quality_features_by_hand():
    rng = random.Random(7)
    texts = ["".join(rng.choice("aAbB  \n\t!|#.,é9中") for _ in range(rng.randint(0, 200))) for _ in range(200)] + ["", " \n ", "one", "The the THE a the", None]
    got = quality_gam.features(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(quality_gam.FEATURES))
    for t, row in zip(texts, got):
        assert np.allclose(row, features_by_hand(t or "")), t


def leaves_by_hand(g, h, depth):
    """The best cut by trying each; sides go on until the depth is used up."""
    score = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    if depth and len(g) > 1:
        gains = [score(0, c) + score(c, len(g)) for c in range(1, len(g))]
        cut = gains.index(max(gains)) + 1
        if gains[cut - 1] > score(0, len(g)) + 1e-9:
            return leaves_by_hand(g[:cut], h[:cut], depth - 1) + leaves_by_hand(g[cut:], h[cut:], depth - 1)
    return [sum(g) / (sum(h) + 1)] * len(g)


def test_a_boosting_round_by_hand(monkeypatch):
    rng = np.random.default_rng(8)
    for _ in range(30):
        g, h = rng.integers(-8, 9, 9) / 4, rng.integers(1, 9, 9) / 4
        assert np.allclose(quality_gam._leaves(g, h, 2), leaves_by_hand(g.tolist(), h.tolist(), 2))
    monkeypatch.setattr(quality_gam, "ROUNDS", 2)
    monkeypatch.setattr(quality_gam, "PAIR_ROUNDS", 0)
    x = rng.normal(0, 1, (200, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.2).astype(float)
    model = quality_gam.Gam(x, y)
    z = np.full(200, model.bias)
    tables = [[0.0] * len(t) for t in model.tables]
    bins = [[sum(v >= c for c in cuts) for v in column] for cuts, column in zip(model.cuts, x.T)]
    for _ in range(2):
        for f in range(3):
            g, h = [0.0] * len(tables[f]), [0.0] * len(tables[f])
            for i in range(200):
                p = 1 / (1 + math.exp(-z[i]))
                g[bins[f][i]] += y[i] - p
                h[bins[f][i]] += p * (1 - p)
            step = [quality_gam.RATE * s for s in leaves_by_hand(g, h, 2)]
            tables[f] = [a + b for a, b in zip(tables[f], step)]
            z += np.array([step[b] for b in bins[f]])
    for mine, theirs in zip(tables, model.tables):
        assert np.allclose(mine, theirs)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-z)))
