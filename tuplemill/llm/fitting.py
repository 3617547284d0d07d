"""What the trained operators share: folds, bounded samples, corpus-wide counts, sparse multinomial regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplemill.llm.arrays import binaries


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


def sample_ids(ids: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` distinct rows, those of the smallest hashes of ``doc_id``; small enough to broadcast for any input."""
    return ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(bound)


def corpus_counts(rows: DataFrame, count, size: int) -> np.ndarray:
    """Sums the int64 vectors of ``size`` that ``count(batch)`` gives over all batches of ``rows``.

    Each task sends one vector, in pieces; pieces are added in a stream, so memory doesn't grow with the tasks.
    """
    width = max(1, size // 64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch)
        yield out((a, total[a : a + width]) for a in range(0, size, width))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[at] = total.get(at, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        if total:
            yield out(total.items())

    def out(parts) -> pa.RecordBatch:
        at, values = zip(*parts)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), binaries(list(values))], ["at", "counts"])

    schema = "at bigint, counts binary"
    result = np.zeros(size, np.int64)
    for r in rows.mapInArrow(each, schema).repartition("at").mapInArrow(add, schema).toLocalIterator():  # ``size`` counters in all
        result[r["at"] : r["at"] + width] = np.frombuffer(r["counts"], np.int64)
    return result


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression on sparse rows by follow-the-regularised-leader with elastic-net penalties."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.bias_z, self.bias_n = np.zeros(classes), np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> None:
        w, b = self._weights(self.z[index], self.n[index], self.l1), self._weights(self.bias_z, self.bias_n, 0.0)
        g = softmax(value @ w + b) * weight
        g[label] -= weight
        for z, n, at, w, g in ((self.z, self.n, index, w, np.outer(value, g)), (self.bias_z, self.bias_n, slice(None), b, g)):
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / self.alpha * w
            n[at] = new

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self._weights(self.z, self.n, self.l1).astype(np.float32), self._weights(self.bias_z, self.bias_n, 0.0).astype(np.float32)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits under which held-back labels are likeliest."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
