"""Document quality by a generalised additive model with pairwise interactions.

Each feature is binned; a lookup table holds its part of the log-odds. Tables are learned by
cyclic boosting: in each round every feature in turn gets a small step of a shallow tree over
its bins, fitted to the current gradients; then the pairs of features with the largest gain
get two-dimensional tables in the same way. A score is a sum of looked-up bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tuplemill.llm import fitting
from tuplemill.llm.arrays import slices, word_codes, words

#: Labelled rows that the model is fitted on at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 60, 30, 0.2

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "exclamations", "bars", "signs", "stops", "high",
    "same_as_last", "same_as_before_last", "distinct_words", "marked_ends", "line_words", "longest_word", "capital_starts",
)


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_MARK = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_BYTE_CLASSES = (_UPPER, _DIGIT, _MARK, _class(b"!"), _class(b"|"), _class(b"#$%&*@^~<>{}[]\\=+_"), _class(b".,;:?"), _class(bytes(range(128, 256))))


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; all zero for a null or empty one."""
    out = []
    for _, _, data, offs in slices(column):
        n = np.diff(offs)
        starts, ends, woff = words(data, offs)
        codes = word_codes(data, starts, ends, lower=True)
        k = np.diff(woff)
        safe_n, safe_k = np.maximum(n, 1), np.maximum(k, 1)
        owner = np.repeat(np.arange(len(n)), k)

        def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])

        sizes = ends - starts
        same = np.zeros((2, len(codes)), bool)
        for back in (1, 2):
            same[back - 1, back:] = (codes[back:] == codes[:-back]) & (owner[back:] == owner[:-back])
        order = np.lexsort((codes, owner))
        new = np.ones(len(codes), bool)
        new[1:] = (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order[new]], minlength=len(n))
        longest = np.zeros(len(n))
        np.maximum.at(longest, owner, sizes)
        lines = per_text(data == 0x0A, offs) + 1
        rows = [
            np.log1p(n), np.log1p(k), per_text(sizes, woff) / safe_k,
            *(per_text(t[data], offs) / safe_n for t in _BYTE_CLASSES),
            per_text(same[0], woff) / safe_k, per_text(same[1], woff) / safe_k, distinct / safe_k ** 0.8,
            per_text(_MARK[data[ends - 1]], woff) / safe_k, k / lines, np.log1p(longest), per_text(_UPPER[data[starts]], woff) / safe_k,
        ]
        out.append(np.stack(rows, axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """The steps of a tree of that depth over ordered bins with gradients ``g`` and curvatures ``h``."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            return np.concatenate((_leaves(g[:cut], h[:cut], depth - 1), _leaves(g[cut:], h[cut:], depth - 1)))
    return np.full(len(g), g.sum() / (h.sum() + 1))


class Gam:
    """Cut points, bias, one table for each feature and one for each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        rate = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(y) and 0 < y.sum() < len(y):
            self._fit(x, y)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        z = np.full(len(y), self.bias)
        bins = [np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T)]

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for table, b in zip(self.tables, bins):
                g, h = (np.bincount(b, v, len(table)) for v in slopes())
                step = RATE * _leaves(g, h, 2)
                table += step
                z += step[b]
        coarse = [np.searchsorted(c, v, "right") for c, v in zip(self.coarse, x.T)]
        g, h = slopes()
        gains = []
        for a, b in combinations(range(len(bins)), 2):
            cell = coarse[a] * PAIR_BINS + coarse[b]
            gains.append((float((np.bincount(cell, g) ** 2 / (np.bincount(cell, h) + 1)).sum()), a, b))
        chosen = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for a, b, table in chosen:
                cell = coarse[a] * PAIR_BINS + coarse[b]
                g, h = (np.bincount(cell, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in slopes())
                step = np.zeros_like(table)
                rows = _leaves(g.sum(axis=1), h.sum(axis=1), 1)  # a cut of one feature, then cuts of the other on each side
                for value in np.unique(rows):
                    side = rows == value
                    step[side] = RATE * _leaves(g[side].sum(axis=0), h[side].sum(axis=0), 1)
                table += step
                z += step.reshape(-1)[cell]
        self.pairs = chosen

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for cuts, table, v in zip(self.cuts, self.tables, x.T):
            z += table[np.searchsorted(cuts, v, "right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Gam:
    """Fits on at most ``bound`` labelled documents outside the held-out fold; an id that repeats counts once."""
    known = labels.filter("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(fitting.fold(5) != 0)
    known = fitting.sample_ids(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), bound, seed=9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(features(batch.column(0))), pa.list_(pa.float64()))], ["y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # ``bound`` small rows
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", F.col("quality").cast("int").alias("y"))).alias("row"))
    got = texts.select("row.text", "row.y").mapInArrow(run, "y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["y"]))  # the same fit, however rows arrive
    return Gam(x[order], got["y"].to_numpy(np.float64)[order])


def score_quality(docs: DataFrame, model: Gam, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) in place of any columns so named."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model_.value.score(features(batch.column(batch.schema.get_field_index("text"))))
            columns = [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    schema = StructType(list(kept.schema.fields)).add("score", "double").add("predicted", "integer")
    return kept.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """Scores every whole text: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Learned from the text and label of documents whose crc32 of the id, modulo 5, isn't 0; at most
    ``bound`` of them. Null and empty texts are scored as having no words. Labels that repeat count
    once, by their maximum; without any label all documents score 0.5. Repeated rows each give a row,
    with equal scores; other columns are neither read nor returned.
    """
    model = fit_quality(docs, labels, bound)
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, threshold)
    return scored.select("doc_id", (fitting.fold(5) == 0).alias("held_out"), "score", "predicted")
