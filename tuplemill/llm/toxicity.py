"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic; the rest is documents of the learning fold taken as
unlabelled, whatever their label, which hold positives at the class prior's rate. The prior is
estimated from these two samples alone (``class_prior``). The risk on unlabelled rows, less the prior times
the risk of positives taken as negatives, estimates the risk on negatives; where a batch drives
that estimate below zero, the step goes the other way instead (it would only fit noise).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplemill.llm import fitting
from tuplemill.llm.arrays import LOWER, U64, slices, spans_hash

#: Positives, and unlabelled documents, that the classifiers are fitted on at most.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Hash buckets of words, buckets that a classifier weighs, classifiers averaged.
SPACE, CHOSEN, MODELS = 1 << 18, 800, 3
#: Bytes of a longer word's beginning, which counts as a word too.
STEM = 6
#: Parts of the sample; words that rank a part's rows come from the others, and the first is held back for the scores' scale.
PARTS = 4
STEPS, DECAY, SCALE = 400, 1e-4, 2.0
#: Positives from which on the class prior is estimated from ranks; below, it is the rate of confirmed documents.
FEWEST = 30

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_buckets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts, owner, bucket): every distinct pair of a text and the bucket of a word in it, slice by slice.

    Words are runs of ASCII letters and bytes above 127, in small letters; a long word also has the bucket of its stem.
    """
    for _, _, data, offs in slices(column):
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = _LETTER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
        ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
        low = LOWER[data]
        long = starts[ends - starts > STEM]
        h = np.concatenate((spans_hash(low, starts, ends), ~spans_hash(low, long, long + STEM))) & U64(SPACE - 1)
        owner = np.searchsorted(offs, np.concatenate((starts, long)), "right") - 1
        pairs = np.unique(owner.astype(np.int64) * SPACE + h.astype(np.int64))
        yield len(offs) - 1, pairs // SPACE, pairs % SPACE


class Model(NamedTuple):
    column_of: np.ndarray  # bucket to weighed column, or -1
    weights: np.ndarray  # columns by classifiers
    bias: np.ndarray
    scale: float
    shift: float

    def margin(self, n: int, owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        column = self.column_of[bucket]
        hit = column >= 0
        z = np.zeros((n, self.weights.shape[1]))
        np.add.at(z, owner[hit], self.weights[column[hit]])
        return (z + self.bias).mean(axis=1)

    def score(self, n: int, owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(n, owner, bucket) + self.shift, -30, 30)))


def risk(unlabelled: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The PU risk of margins, its part on negatives, and the risk's slopes by the margins of unlabelled and positive rows."""
    negative = np.log1p(np.exp(unlabelled)).mean() - prior * np.log1p(np.exp(positive)).mean()
    su, sp = 1 / (1 + np.exp(-unlabelled)), 1 / (1 + np.exp(-positive))
    return prior * np.log1p(np.exp(-positive)).mean() + negative, negative, su / len(unlabelled), prior * (sp - 1) / len(positive) - prior * sp / len(positive)


def nn_pu(x: np.ndarray, positive: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier under the non-negative PU risk."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    pos, rest = np.flatnonzero(positive), np.flatnonzero(~positive)
    p, u = x[pos], x[rng.permutation(rest)[: max(1, len(rest) * 4 // 5)]]  # whole samples: small ones would often seem to have no negatives
    for step in range(1, STEPS + 1):
        zu, zp = (np.clip(rows @ w.astype(x.dtype) + b, -30, 30).astype(np.float64) for rows in (u, p))  # in the rows' type, or each step would convert them
        _, negative, du, dp = risk(zu, zp, prior)
        if negative < 0:
            du, dp = -1 / (1 + np.exp(-zu)) / len(u), prior / (1 + np.exp(-zp)) / len(p)
        g = np.append(u.T @ du.astype(x.dtype) + p.T @ dp.astype(x.dtype) + DECAY * w, du.sum() + dp.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Word frequencies cover the whole learning fold; classifiers are fitted on bounded samples of it, in which an id counts once."""
    known = labels.filter("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).filter(fitting.fold(3) != 1)
    fold = docs.filter(fitting.fold(3) != 1)

    def documents_with(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(SPACE + 64, np.int64)
        for n, _, bucket in word_buckets(batch.column(0)):
            total[:SPACE] += np.bincount(bucket, minlength=SPACE)
            total[SPACE] += n
        return total

    seen = fitting.corpus_counts(fold.select("text"), documents_with, SPACE + 64)
    toxic = fitting.sample_ids(known, positives, seed=3).withColumn("y", F.lit(1))
    other = fitting.sample_ids(fold.select("doc_id"), unlabelled, seed=4).withColumn("y", F.lit(0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for n, owner, bucket in word_buckets(batch.column(0)):
                lists += np.split(bucket.astype(np.int32), np.searchsorted(owner, np.arange(1, n)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lists, pa.list_(pa.int32()))], ["y", "part", "buckets"])

    texts = fold.join(F.broadcast(toxic.unionByName(other)), "doc_id")  # ``positives`` + ``unlabelled`` small rows
    texts = texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS)).cast("int")  # both rows of a document are in one part
    got = texts.select("row.text", "y", part.alias("part")).mapInArrow(rows, "y int, part int, buckets array<int>").toPandas()
    y, part = got["y"].to_numpy(np.int64), got["part"].to_numpy(np.int64)
    lists = [np.asarray(b, np.int64) for b in got["buckets"]]
    order = sorted(range(len(y)), key=lambda i: (y[i], part[i], len(lists[i]), int(lists[i].sum())))  # the same fit, however rows arrive
    y, part, lists = y[order], part[order], [lists[i] for i in order]
    column_of = np.full(SPACE, -1, np.int32)
    if not y.any() or y.all():
        return Model(column_of, np.zeros((0, 1)), np.zeros(1), 0.0, -7.0)
    often = (seen[:SPACE] + 1) / (seen[SPACE] + 2)
    rank = np.zeros(len(y))
    for k in range(PARTS):
        words, weight = telling_words([lists[i] for i in np.flatnonzero((y == 1) & (part != k))], often)
        value = np.zeros(SPACE)
        value[words] = weight
        for i in np.flatnonzero(part == k):
            rank[i] = value[lists[i]].sum()
    rate = (known.distinct().count() + 1) / (seen[SPACE] + 2)  # of the fold's documents, those that are confirmed
    prior = class_prior(rank[y == 1], rank[y == 0], rate)
    chosen, _ = telling_words([lists[i] for i in np.flatnonzero(y)], often)
    column_of[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)), np.float32)
    for i, b in enumerate(lists):
        c = column_of[b]
        x[i, c[c >= 0]] = 1
    back = part == 0
    learn = ~back if all((y[rows] == c).any() for rows in (back, ~back) for c in (0, 1)) else np.ones(len(y), bool)
    fits = [nn_pu(x[learn], y[learn] == 1, prior, seed) for seed in range(MODELS)]
    weights, bias = np.stack([w for w, _ in fits], axis=1), np.array([b for _, b in fits])
    margin = (x @ weights + bias).mean(axis=1)
    held = back if (~learn).any() else learn
    return Model(column_of, weights, bias, *calibrated(margin[held & (y == 0)], prior))


def telling_words(positive: list[np.ndarray], often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that positives have far oftener than the corpus, at most ``CHOSEN``, and the logarithm of how much oftener."""
    n, inside = max(1, len(positive)), np.zeros(SPACE)
    for buckets in positive:
        inside[buckets] += 1
    lift = np.where(inside > max(2, 0.005 * n), (inside / n - often) / np.sqrt(often * (1 - often) / n), 0.0)
    chosen = np.argsort(-lift, kind="stable")[:CHOSEN]
    chosen = chosen[lift[chosen] > 4]
    return chosen, np.log((inside[chosen] + 1) / (n + 2)) - np.log(often[chosen])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, rate: float) -> float:
    """The share of positives among unlabelled rows, from any score of both; ``rate`` where scores can't tell.

    For each threshold, the share of unlabelled rows above it is at least the prior times the share of positives
    above it; so the smallest ratio of the two bounds the prior, and is near it where hardly any negative scores as
    high. Shares are taken with a standard error against small samples, at thresholds that a fifth of the positives and
    not all unlabelled rows pass. Without such a threshold, or with fewer than ``FEWEST`` positives, shares say nothing.
    """
    order = np.sort(positive), np.sort(unlabelled)
    at = np.unique(positive)
    above = [(len(v) - np.searchsorted(v, at)) / len(v) for v in order]
    p, u = (share + sign * np.sqrt(share * (1 - share) / len(v)) for share, v, sign in zip(above, order, (-1, 1)))
    use = (above[0] >= 0.2) & (above[1] < 1) & (p > 0)
    return float(np.clip((u[use] / p[use]).min() if len(positive) >= FEWEST and use.any() else rate, 0.001, 0.9))


def calibrated(unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The scale of margins, and the shift with which the mean score of held-back unlabelled rows is the class prior."""
    low, high = -40.0, 40.0
    for _ in range(60):
        shift = (low + high) / 2
        mean = (1 / (1 + np.exp(-np.clip(SCALE * unlabelled + shift, -30, 30)))).mean()
        low, high = (shift, high) if mean < prior else (low, shift)
    return SCALE, (low + high) / 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """Scores every whole text: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from ``threshold`` on).

    Learned from documents whose crc32 of the id, modulo 3, isn't 1. Null and empty texts get the score of
    a text without any weighed word. A document is a confirmed positive if any of its labels says so; without a
    positive label all texts get one score below 0.001. Repeated rows each give a row; other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, positives, unlabelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.value.score(*part) for part in word_buckets(batch.column(2))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (fitting.fold(3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
