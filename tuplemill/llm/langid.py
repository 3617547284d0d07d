"""Language identification: sparse multinomial regression on TF-IDF of hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplemill.llm import fitting
from tuplemill.llm.arrays import slices

#: Documents that the model is fitted on at most.
SAMPLE = 4_000
SPACE, ORDERS, EPOCHS = 1 << 13, (1, 2, 3), 3
#: Texts whose dense counts stand in memory together.
ROWS = 256
UNKNOWN = "und"

_SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def gram_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of hashed character n-grams, one row of ``SPACE`` for each text, for runs of texts.

    A to Z and their accented forms count as small letters; n-grams don't cross texts.
    """
    for _, _, data, offs in slices(column):
        for at in range(0, len(offs) - 1, ROWS):
            o = offs[at : at + ROWS + 1]
            part = data[o[0] : o[-1]]
            points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
            capital = (points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE) & (points != 0xD7)
            points[capital] += np.uint32(32)
            first = np.searchsorted(np.flatnonzero((part & 0xC0) != 0x80), o - o[0])
            owner = np.repeat(np.arange(len(o) - 1), np.diff(first))
            counts = np.zeros((len(o) - 1) * SPACE, np.float32)
            for n in ORDERS:
                if len(points) < n:
                    continue
                h = np.zeros(len(points) - n + 1, np.uint32)
                for k in range(n):
                    h = (h ^ points[k : len(points) - n + 1 + k]) * _SEEDS[k]
                    h ^= h >> np.uint32(15)
                h *= _SEEDS[n - 1]
                whole = owner[: len(h)] == owner[n - 1 :]
                counts += np.bincount((owner[: len(h)] * SPACE + (h >> np.uint32(19)))[whole], minlength=len(counts))
            yield counts.reshape(-1, SPACE)


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return fitting.softmax((self.vectors(counts) @ self.weights + self.bias).astype(np.float64) / self.temperature)


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def fit_language(docs: DataFrame, bound: int = SAMPLE) -> Model:
    """Document frequencies cover the whole learning fold; weights are fitted on ``bound`` documents of it at most."""
    fold = docs.filter((fitting.fold(3) != 1) & F.col("lang").isNotNull() & has_letter())

    def documents_with(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(SPACE + 64, np.int64)
        for counts in gram_counts(batch.column(0)):
            total[:SPACE] += (counts > 0).sum(axis=0)
            total[SPACE] += len(counts)
        return total

    seen = fitting.corpus_counts(fold.select("text"), documents_with, SPACE + 64)
    idf = np.log((1 + seen[SPACE]) / (1 + seen[:SPACE])).astype(np.float32) + np.float32(1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value = [], []
            for counts in gram_counts(batch.column(0)):
                for row in counts:
                    at = np.flatnonzero(row)
                    index.append(at.astype(np.int16))
                    value.append(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(index, pa.list_(pa.int16())), pa.array(value, pa.list_(pa.float32()))], ["lang", "index", "value"])

    sample = fitting.sample_ids(fold.select("doc_id", F.xxhash64("text").alias("h")), bound, seed=2)
    texts = fold.withColumn("h", F.xxhash64("text")).join(F.broadcast(sample), ["doc_id", "h"], "left_semi")  # ``bound`` small rows
    texts = texts.groupBy("doc_id", "h").agg(F.min(F.struct("lang", "text")).alias("row"))  # rows that repeat count once
    got = texts.select("row.text", "row.lang").mapInArrow(rows, "lang string, index array<smallint>, value array<float>").toPandas()
    langs = sorted(got["lang"].unique())
    label = {x: i for i, x in enumerate(langs)}
    model = _fit(got, label, idf)
    return Model(langs, idf, *model)


def _fit(got, label: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, bias and temperature; a fifth of the rows is held back for the temperature."""
    learner = fitting.Ftrl(SPACE, max(1, len(label)))
    rows = []
    for lang, index, value in zip(got["lang"], got["index"], got["value"]):
        index = np.asarray(index, np.int64)
        x = np.log1p(np.asarray(value, np.float64)) * idf[index]
        rows.append((index, x / max(np.linalg.norm(x), 1e-9), label[lang]))
    rows.sort(key=lambda r: (len(r[0]), r[2], float(r[1].sum())))  # the same fit, however rows arrive
    order = np.random.default_rng(2).permutation(len(rows))
    back, learn = order[: len(order) // 5], order[len(order) // 5 :]
    for _ in range(EPOCHS):
        for i in learn:
            learner.learn(*rows[i])
    w, b = learner.weights()
    logits = np.array([rows[i][1] @ w[rows[i][0]] + b for i in back]).reshape(-1, max(1, len(label)))
    return w, b, fitting.temperature(logits, np.array([rows[i][2] for i in back], np.int64))


def identify(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Predicts the language of every whole text: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Learned from text and ``lang`` where ``lang`` isn't null and the crc32 of the id, modulo 3, isn't 1.
    A null text, or one without a letter, gets ``und`` and score 0, and so does every text if no language
    could be learned. Repeated rows each give a row, and count once in the fit; other columns are neither read nor returned.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit_language(docs, bound)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if not m.langs:
                best, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            else:
                parts = [m.probabilities(c) for c in gram_counts(batch.column(2))]
                p = np.concatenate(parts) if parts else np.zeros((0, len(m.langs)))
                best, score = np.where(letters, p.argmax(axis=1), len(m.langs)), np.where(letters, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (fitting.fold(3) == 1).alias("held_out"), "text", has_letter().alias("letters"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
