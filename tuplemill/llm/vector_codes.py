"""Product codes of vectors with exact integer codebooks, assigned through vantage-point trees.

Components are scaled to integers, so that sums, means and distances are exact and no order of rows
changes a result. Each part position has a tree over its codebook's entries: an entry stands at a node,
the others are split by their distance from it. A search skips a subtree only if its entries are surely
farther than the best one found; radii are rounded outwards to integers, equal bounds are visited, and
whole-number distances decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplemill.llm.storage import settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that are taken at once in a task.
BLOCK = 4_096
#: A label of more than one row in so many is met by broadcast; there are no more labels of that size.
HOT_SHARE = 1_000


class Node(NamedTuple):
    """An entry, and the subtrees of entries near it and far from it with the least and largest distance from it."""

    entry: int
    near: Node | None = None
    far: Node | None = None
    near_range: tuple[int, int] = (0, 0)
    far_range: tuple[int, int] = (0, 0)


def _root(x: np.ndarray) -> np.ndarray:
    """The whole part of the square root, exactly."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    r += (r + 1) * (r + 1) <= x
    return r


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def build(entries: np.ndarray, of: np.ndarray | None = None) -> Node | None:
    """The tree over the rows ``of`` of a codebook; its first row is the vantage point, the median distance splits the rest."""
    of = np.arange(len(entries)) if of is None else of
    if not len(of):
        return None
    top, rest = int(of[0]), of[1:]
    squares = _squares(entries[rest], entries[top])
    order = np.argsort(squares, kind="stable")
    half = (len(rest) + 1) // 2
    sides, ranges = [], []
    for side in (order[:half], order[half:]):
        sides.append(build(entries, np.sort(rest[side])))
        low, high = _root(squares[side[[0, -1]]]) if len(side) else (0, 0)
        ranges.append((int(low), int(high) + 1))  # rounded down and up
    return Node(top, *sides, *ranges)


def nearest(tree: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the nearest entry, of equally near ones that of the smallest index; its squared distance; distances taken."""
    best, square = np.full(len(x), len(entries), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    taken = 0

    def visit(node: Node, rows: np.ndarray) -> None:
        nonlocal taken
        taken += len(rows)
        s = _squares(x[rows], entries[node.entry])
        better = (s < square[rows]) | ((s == square[rows]) & (node.entry < best[rows]))
        best[rows[better]], square[rows[better]] = node.entry, s[better]
        down = _root(s)
        up = down + 1
        near_first = down <= node.near_range[1]
        for first in (True, False):
            own = near_first == first
            sides = ((node.near, node.near_range), (node.far, node.far_range))
            for side, (low, high) in sides if first else sides[::-1]:
                if side is None or not own.any():
                    continue
                bound = np.maximum(np.maximum(down[own] - high, low - up[own]), 0)
                open_ = rows[own][bound * bound <= square[rows[own]]]
                if len(open_):
                    visit(side, open_)

    if len(x):
        visit(tree, np.arange(len(x)))
    return best, square, taken


def _largest(width: int) -> int:
    """Components up to this keep the squared distance of a whole vector within 62 bits."""
    return int(np.sqrt(2.0**62 / max(width, 1)) / 2)


def scaled(batch: pa.RecordBatch, column: str, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch that count, and their vectors as integers."""
    lists = batch.column(batch.schema.get_field_index(column))
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = lists.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(flat * scale)
        good = (np.abs(x) <= _largest(width)).all(axis=1)  # false for what isn't finite
    return rows[good], x[good].astype(np.int64)


def usable(vectors: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """Rows whose vectors count, and their length: the commonest one, of equally common ones the smallest."""
    one = F.col("embedding")
    whole = vectors.filter(one.isNotNull() & (F.size(one) > 0) & ~F.exists(one, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = whole.groupBy(F.size(one).alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = common["width"] if common else 0
    return whole.filter((F.size(one) == width) & ~F.exists(one, lambda x: F.abs(F.floor(x * scale)) > _largest(width))), width


class Codebooks:
    """One table of entries for each part position, and its tree."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.trees = [build(t) for t in tables]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row's parts: rows by parts."""
        parts = x.reshape(len(x), len(self.tables), -1)
        found = [nearest(tree, t, np.ascontiguousarray(parts[:, k])) for k, (tree, t) in enumerate(zip(self.trees, self.tables))]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for t in self.tables for v in t.reshape(-1).tolist()).encode()).hexdigest()


def _sums(vectors: DataFrame, books: Codebooks, width: int, scale: int) -> list[tuple]:
    """(part, entry, count, sum of each component) over all rows; as many rows as there are entries."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    n, m, w = len(books.tables), len(books.tables[0]), width // len(books.tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((n, m), np.int64), np.zeros((n, m, w), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, x = scaled(batch.slice(at, BLOCK), "embedding", width, scale)
                entry, _ = shared.value.assign(x)
                parts = x.reshape(len(x), n, w)
                for k in range(n):
                    count[k] += np.bincount(entry[:, k], minlength=m)
                    np.add.at(total[k], entry[:, k], parts[:, k])
        part, entry = np.nonzero(count)
        values = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(values, ["part", "entry", "n", "total"])

    rows = vectors.select("embedding").mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")
    sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(w)]
    return [(r["part"], r["entry"], r["n"], [r[f"s{i}"] for i in range(w)]) for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()]


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks from all rows of (vec_id, embedding); None if no row counts.

    Entries begin as the vectors of the smallest ids (ties by the vector; rows without an id last), fewer if there are fewer
    rows. In each round every row goes to its nearest entries, and entries move to their rows' mean, rounded down; an entry
    without rows stays. A task sends one sum for each entry, and the driver gets as many as there are entries.
    """
    rows, width = usable(vectors, scale)
    if width % parts:
        raise ValueError(f"{parts} equal parts can't be cut from vectors of {width} components")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not first:
        return None
    start = pa.RecordBatch.from_arrays([pa.array([r["embedding"] for r in first], pa.list_(pa.float64()))], ["embedding"])
    x = scaled(start, "embedding", width, scale)[1]
    books = Codebooks([np.ascontiguousarray(t) for t in x.reshape(len(x), parts, width // parts).transpose(1, 0, 2)])
    for _ in range(rounds):
        tables = [t.copy() for t in books.tables]
        for part, entry, n, total in _sums(vectors, books, width, scale):
            tables[part][entry] = [s // n for s in total]  # Python's whole division rounds down
        books = Codebooks(tables)
    return books


def encode(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of each row that counts: two hex digits a part, and the squared distance from its entries."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    width = sum(t.shape[1] for t in books.tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                rows, x = scaled(piece, "embedding", width, scale)
                entry, square = shared.value.assign(x)
                kept = piece.take(pa.array(rows))
                code = [bytes(e).hex() for e in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(code, pa.string()), pa.array(square.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kind = dict(vectors.dtypes)["label"]
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: ``error`` summed over the rows of a label, nulls together.

    Sums are made before the shuffle. Labels of a large share of the rows, a thousand at most, are met by broadcast; the others
    by a join, in which rows of large labels are dealt out by their id.
    """
    coded = settle(coded, "codes")
    sums = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("label_rows")), "label_sums")
    total = sums.agg(F.sum("label_rows")).first()[0] or 0
    large = sums.filter(F.col("label_rows") * HOT_SHARE > total).select(F.col("label").alias("l"), F.col("label_error").alias("of_large"))
    small = sums.filter(F.col("label_rows") * HOT_SHARE <= total).select(F.col("label").alias("l"), F.col("label_error").alias("of_small"), F.lit(0).alias("place"))
    rows = coded.join(F.broadcast(large), coded["label"].eqNullSafe(large["l"]), "left").drop("l")
    rows = rows.withColumn("place", F.when(F.col("of_large").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("vec_id", "code"), F.lit(4096)).cast("int")))
    rows = rows.join(small, rows["label"].eqNullSafe(small["l"]) & (rows["place"] == small["place"]), "left")
    return rows.select("vec_id", "label", "code", "error", F.coalesce("of_large", "of_small").alias("label_error"))


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Trains codebooks on all vectors and encodes each: vec_id, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty, holds null or non-finite components, has another length than the commonest, or components too
    large for exact distances (over 2**27 after scaling, for vectors of 64) are left out; a length that ``parts`` doesn't divide is
    refused. Rows that repeat, in id or in all, each count and each give a row; null ids and labels stay. Without rows the result is
    empty. Columns beside vec_id, embedding and label are neither read nor returned.
    """
    vectors = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    books = train(vectors, parts, entries, rounds, scale)
    if books is None:
        return vectors.limit(0).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    return with_label_error(encode(vectors, books, scale)).withColumn("codebooks_sha256", F.lit(books.digest()))


def _sql() -> str:
    """Each round as a table of its own: assignments, then means."""
    steps = [
        """WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS MATERIALIZED (SELECT r, k, x[k * len(x) // 8 + 1:(k + 1) * len(x) // 8] AS x FROM v, range(0, 8) t(k))",
        "b0 AS MATERIALIZED (SELECT k, r - 1 AS e, x FROM p WHERE r <= 16)",
    ]
    distance = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    for n in range(ROUNDS + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, k, x, e, s FROM (SELECT p.r, p.k, p.x, b.e, {distance}::BIGINT AS s FROM p JOIN b{n} b USING (k)) QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY s, e) = 1)"
        )
        if n < ROUNDS:
            steps.append(f"u{n} AS (SELECT k, e, i, sum(x)::BIGINT AS s, count(*) AS c FROM (SELECT k, e, unnest(x) AS x, unnest(range(len(x))) AS i FROM a{n}) GROUP BY k, e, i)")
            steps.append(f"m{n} AS (SELECT k, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS x FROM u{n} GROUP BY k, e)")
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT k, e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (k, e))")
    steps.append(f"g AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    steps.append(f"c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY k) AS code, sum(s)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)")
    return ",\n".join(steps) + "\nSELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), g"


SQL = _sql()
