"""Vectorised text primitives for Arrow batches: bytes, words, rolling hashes, sliding minima.

Everything works on numpy views of the Arrow buffers, a few megabytes at a time, so that
a Python worker's memory is bounded by one slice (or by one document, if that is larger).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 2**64, 256, dtype=U64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (xor-shift-multiply), in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        for k, b in enumerate((_BASE, _INVERSE)):
            row = np.full(size, b, U64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each ``data[start:end]``.

    Eight bytes at a time are scrambled with a salt of their place and summed. The scrambler isn't linear, so that
    texts of a regular build (as Thue-Morse words, which no polynomial modulo 2**64 tells apart) don't collide.
    """
    size = ends - starts
    n_blocks = (size + 7) >> 3
    eight = unaligned(data)
    out = np.zeros(len(starts), U64)
    if n_blocks.sum():
        some = np.flatnonzero(n_blocks)
        one = n_blocks[some] == 1
        if one.all():
            at, left, block, first = starts[some], size[some], np.zeros(len(some), np.int64), None
        else:
            first = np.cumsum(n_blocks[some]) - n_blocks[some]
            block = ranges(np.zeros(len(some), np.int64), n_blocks[some])
            at = np.repeat(starts[some], n_blocks[some]) + 8 * block
            left = np.repeat(ends[some], n_blocks[some]) - at
        v = eight[at] & _MASKS[np.minimum(left, 8)]
        v ^= _salts(int(block.max()) + 1)[block]
        v = mix(v)
        out[some] = v if first is None else np.add.reduceat(v, first)
    out += size.astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)


def unaligned(data: np.ndarray) -> np.ndarray:
    """For each byte the eight bytes from it on as an integer; zeros follow the last byte."""
    raw = np.frombuffer(data.tobytes() + b"\0" * (16 - len(data) % 8), U64)
    return np.lib.stride_tricks.as_strided(raw, (len(data),), (1,))


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``data[a:a + size]`` equals ``data[b:b + size]``, byte by byte."""
    out = np.ones(len(a), bool)
    eight = unaligned(data)
    rows, k = np.flatnonzero(size > 0), 0
    while len(rows):
        differ = (eight[a[rows] + k] ^ eight[b[rows] + k]) & _MASKS[np.minimum(size[rows] - k, 8)]
        out[rows[differ != 0]] = False
        k += 8
        rows = rows[(differ == 0) & (size[rows] > k)]
    return out


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``, independent of its place; for runs of a few hundred values at most."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    out += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)


def grams_hash(values: np.ndarray, m: int) -> np.ndarray:
    """The hash of every run of ``m`` values, a few hundred at most; ``len(values) - m + 1`` of them."""
    n = len(values) - m + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    out = total[m:] - total[:n]
    out *= down[:n]
    return mix(out)


def sliding(values: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """``op`` over every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1]) if have < width else out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes, one row at least."""
    data, offs = text_buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and each text's first word (n + 1 values)."""
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        np.logical_not(solid[:-1], out=before[1:])
        np.logical_not(solid[1:], out=after[:-1])
    before |= edge[:-1]
    after |= edge[1:]
    starts = np.flatnonzero(solid & before)
    return starts, np.flatnonzero(solid & after) + 1, np.searchsorted(starts, offs)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit code of each word."""
    return spans_hash(LOWER[data] if lower else data, starts, ends)


class Shingles(NamedTuple):
    """The distinct shingles of many texts, by text and hash."""

    owner: np.ndarray
    h: np.ndarray
    begin: np.ndarray  # first byte
    end: np.ndarray


def shingles(data: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> Shingles:
    """A text of fewer than ``k`` words has its whole sequence as one shingle; a text without words has none."""
    starts, ends, woff = words(data, offs)
    codes, n = word_codes(data, starts, ends, lower), np.diff(woff)
    many = np.maximum(n - k + 1, 0)
    at, owner = ranges(woff[:-1], many), np.repeat(np.arange(len(n)), many)
    h, last = grams_hash(codes, k)[at], at + k - 1
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        owner, h = np.concatenate((owner, short)), np.concatenate((h, runs_hash(codes, woff[short], woff[short + 1])))
        at, last = np.concatenate((at, woff[short])), np.concatenate((last, woff[short + 1] - 1))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    order = order[new]
    return Shingles(owner[new], h[new], starts[at[order]], ends[last[order]])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of all [start, start + size), one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return shift + np.arange(total)


def binaries(rows: list[bytes] | list[np.ndarray]) -> pa.Array:
    return pa.array([r if isinstance(r, bytes) else r.tobytes() for r in rows], pa.binary())


def binary_column(blob: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of consecutive parts of ``blob``."""
    offs = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offs[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(blob, np.uint8))])


def list_column(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list<int64> column of consecutive parts of ``flat``."""
    offs = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.view(np.int64)))
