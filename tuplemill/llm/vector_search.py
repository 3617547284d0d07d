"""Exact top-k inner products by vector-approximation files.

Vectors are packed into blocks. A block holds, for each dimension, a few cells with their least and largest
component, each vector's cells as four bits a dimension, and the exact vectors beside them. A search scans
the cells, which bound every score from above and below; it then reads exact vectors in the order of their
upper bounds and stops once the k-th score found is above all bounds that are left. Query blocks meet vector
blocks one pair at a time, and only k results a query and block are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplemill.llm.storage import settle
from tuplemill.llm.vector_codes import scaled, usable

SCALE, K, EVERY = 64, 20, 20
CELLS = 16
#: Vectors of a block, and queries of a block.
BLOCK, QUERY_BLOCK = 8_192, 1_024
#: Exact vectors that are read at first; twice as many each time after that.
FIRST_READ = 32
_PACKED = "block int, n int, width int, ids binary, named binary, low binary, high binary, cells binary, exact binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, low, high): each component's cell in its dimension, and the least and largest component of each cell.

    Cells have about as many vectors each; equal components are in one cell. A cell without vectors has 0 to 0.
    """
    cuts = np.sort(x, axis=0)[(np.arange(1, CELLS) * len(x)) // CELLS] if len(x) else np.zeros((CELLS - 1, x.shape[1]), np.int64)
    cells = np.zeros(x.shape, np.uint8)
    low, high = np.zeros((CELLS, x.shape[1]), np.int64), np.zeros((CELLS, x.shape[1]), np.int64)
    for j in range(x.shape[1]):
        cells[:, j] = np.searchsorted(cuts[:, j], x[:, j], "right")
        order = np.argsort(cells[:, j], kind="stable")
        own, first = np.unique(cells[order, j], return_index=True)
        if len(own):
            low[own, j], high[own, j] = np.minimum.reduceat(x[order, j], first), np.maximum.reduceat(x[order, j], first)
    return cells, low, high


def _float(queries: np.ndarray, largest: int) -> type:
    """A float type in which all sums of products are exact whole numbers, or int64."""
    most = int(np.abs(queries).sum(axis=1).max(initial=0)) * max(largest, 1) * 2
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the least and twice the largest inner product of each query (rows) with any vector in each one's cells (columns)."""
    kind = _float(queries, int(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))))
    at = np.arange(cells.shape[1])
    a, b = low[cells, at], high[cells, at]
    middle, slack = queries.astype(kind) @ (a + b).astype(kind).T, np.abs(queries).astype(kind) @ (b - a).astype(kind).T
    return middle - slack, middle + slack


def search(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, exact: np.ndarray, rank: np.ndarray, k: int, own: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each query the places and scores of its ``k`` best vectors, of equal scores those of the smallest ``rank``; vectors read.

    ``own`` is the place of the query itself among the vectors, which is passed over, or -1. A vector is read unless its bound is
    below the k-th score found so far, so that ties are all seen.
    """
    below, above = bounds(queries, cells, low, high)
    mine = np.flatnonzero(own >= 0)
    below[mine, own[mine]] = -(1 << 62) if below.dtype == np.int64 else -np.inf
    if k < below.shape[1]:
        sure = -np.partition(-below, k - 1, axis=1)[:, k - 1]  # k vectors score so much at least
    else:
        sure = np.full(len(queries), below.min(initial=0))
    places, scores, read = [], [], 0
    for q in range(len(queries)):
        left = np.flatnonzero(above[q] >= sure[q])
        left = left[left != own[q]]
        left = left[np.argsort(-above[q, left], kind="stable")]
        at, got, size, done = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST_READ, 0
        while done < len(left) and not (len(got) == k and 2 * got[-1] > above[q, left[done]]):
            more = left[done : done + size]
            at, got = np.concatenate((at, more)), np.concatenate((got, exact[more] @ queries[q]))
            best = np.lexsort((rank[at], -got))[:k]
            at, got, done, size = at[best], got[best], done + len(more), 2 * size
        read += done
        places.append(at)
        scores.append(got)
    return places, scores, read


def _pack(table: pa.Table, width: int, scale: int, block: int) -> pa.RecordBatch:
    batch = table.combine_chunks().to_batches()[0]
    rows, x = scaled(batch, "embedding", width, scale)
    ids = batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(rows))
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    order = np.lexsort((*x.T[::-1], ids, ~named))  # a block is the same, however its rows arrive
    x, ids, named = x[order], ids[order], named[order]
    cells, low, high = quantise(x)
    four = np.pad(cells, ((0, 0), (0, width % 2)))
    raw = [ids.tobytes(), named.astype(np.uint8).tobytes(), low.tobytes(), high.tobytes(), (four[:, ::2] | four[:, 1::2] << 4).tobytes(), x.astype(np.int32).tobytes()]
    numbers = [pa.array([v], pa.int32()) for v in (block, len(x), width)]
    return pa.RecordBatch.from_arrays([*numbers, *(pa.array([r], pa.binary()) for r in raw)], [f.split()[0] for f in _PACKED.split(", ")])


def _unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, named, low, high, cells, exact) of one packed row."""
    row = table.to_pylist()[0]
    n, width = row["n"], row["width"]
    packed = np.frombuffer(row["cells"], np.uint8).reshape(n, -1)
    cells = np.stack((packed & 15, packed >> 4), axis=2).reshape(n, -1)[:, :width]
    low, high = (np.frombuffer(row[c], np.int64).reshape(CELLS, width) for c in ("low", "high"))
    exact = np.frombuffer(row["exact"], np.int32).reshape(n, width).astype(np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], np.uint8).astype(bool), low, high, cells, exact


def blocks(vectors: DataFrame, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The approximation file of (vec_id, embedding): packed blocks of about ``block`` vectors, written; and how many blocks."""
    rows, width = usable(vectors, scale)
    n = max(1, -(-rows.count() // block))
    dealt = rows.select("vec_id", "embedding", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int").alias("block"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_pack(table, width, scale, key[0].as_py())])

    return settle(dealt.groupBy("block").applyInArrow(run, _PACKED), "cells"), n


def _query_blocks(packed: DataFrame, every: int, size: int) -> DataFrame:
    """Queries are the rows of packed vectors whose id ``every`` divides, with the block and place they have there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                n, width = row["n"], row["width"]
                ids = np.frombuffer(row["ids"], np.int64)
                at = np.flatnonzero((ids % every == 0) & np.frombuffer(row["named"], np.uint8).astype(bool))
                exact = np.frombuffer(row["exact"], np.int32).reshape(n, width)
                columns = [pa.array(np.full(len(at), row["block"], np.int32)), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array([v.tobytes() for v in exact[at]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["own_block", "own_place", "query_id", "vector"])

    rows = packed.select("block", "n", "width", "ids", "named", "exact").mapInArrow(run, "own_block int, own_place int, query_id bigint, vector binary")
    rows = settle(rows, "queries")
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("queries", F.pmod(F.xxhash64("own_block", "own_place"), F.lit(n)).cast("int")), n


def top_products(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the largest inner products with each query, ties to smaller ids.

    Queries are the rows whose id ``every`` divides; a row is no candidate for itself. Of rows that repeat, each is a query and
    each a candidate for the others. Rows without an id are candidates, after others of the same score. Rows whose vector is null,
    empty, holds null or non-finite components, has another length than the commonest, or components too large for exact products
    take no part. With fewer rows than ``k`` all are returned; without rows none. Other columns are neither read nor returned.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed, n_blocks = blocks(vectors, scale, block)
    queries, n_queries = _query_blocks(packed, every, query_block)
    # the rows of a query go to all vector blocks, and a vector block to all query blocks: (vectors * queries / block sizes) rows in all
    left = packed.withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(key: tuple, cells: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["own_block", "own_place", "query_id", "vec_id", "score"]
        if not cells.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), *(pa.array([], pa.int64()) for _ in range(3))], names)
        ids, named, low, high, codes, exact = _unpack(cells)
        asked = asked.combine_chunks()
        at = {c: asked.column(c).to_numpy() for c in ("own_block", "own_place", "query_id")}
        vectors = np.frombuffer(b"".join(asked.column("vector").to_pylist()), np.int32).reshape(asked.num_rows, -1).astype(np.int64)
        own = np.where(at["own_block"] == key[0].as_py(), at["own_place"], -1)
        places, scores, _ = search(vectors, codes, low, high, exact, np.arange(len(ids)), k, own)  # places go by id, nulls last
        sizes = [len(p) for p in places]
        flat = np.concatenate(places)
        found = pa.array(ids[flat], mask=~named[flat])
        return pa.table([*(pa.array(np.repeat(at[c], sizes)) for c in names[:3]), found, pa.array(np.concatenate(scores))], names)

    grid = left.groupBy("block", "queries").cogroup(right.groupBy("block", "queries"))
    found = grid.applyInArrow(run, "own_block int, own_place int, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("own_block", "own_place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.r <> v.r)
SELECT query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) <= 20
"""
