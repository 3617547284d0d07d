"""Finding every window of W units (bytes or words) that occurs more than once, without shuffling the texts' windows.

1. Anchors. A window's anchors are its grams of m units whose hash falls below a threshold;
   in a bare window, which has none, it is the smallest gram. They depend on the window's own
   content only, so equal windows have equal anchors. Anchors are counted over the whole corpus.
2. A window can repeat only if each of its anchors does. The repeated anchors go into a bit
   table of at most ``MAX_BITS`` bits, the one thing that is broadcast. Its false positives
   cost work, never results.
3. Consecutive windows that pass and share their smallest anchor travel as one packed string
   (a super-k-mer) to that anchor's bucket. Equal strings are combined before and after the
   shuffle, so a passage with thousands of copies is a few rows.
4. A bucket of more than ``BUCKET_BYTES`` is dealt anew by a longer anchor, and again while it is too large.
   The windows of a bucket hold its gram at some place ``a`` from 0 to W - m. At level j those places
   are parted into 2**j classes, and the longer anchor is what all windows of a class hold around the gram:
   W less the class's width, plus 1. A level cuts a string in two at most, by its content, so rows at
   most double for large buckets and stay as they are for others. At the last level the anchor is the
   window itself, and a bucket is one string with its number of copies.
5. A bucket resolver says which windows of a string stay. All other windows that passed go.

``Scheme`` has the units and sizes; the resolver belongs to the operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplemill.llm.arrays import BYTE_CODES, U64, grams_hash, ranges, runs_hash, slices, sliding, word_codes, words
from tuplemill.llm.storage import settle, small_batches

#: The bit table's size is 16 bits for each repeated anchor, within these bounds.
MIN_BITS, MAX_BITS = 20, 29
SEGMENT = 19
#: Bytes of packed strings of a bucket that isn't dealt anew.
BUCKET_BYTES = 1 << 16
#: Bytes of packed strings that a task resolves together.
CHUNK = 1 << 20
FIRST_ID = -(2**63)


class Scheme(NamedTuple):
    unit: str  # "byte" or "word"
    window: int
    gram: int
    rate: int  # one gram in so many is an anchor


class Units(NamedTuple):
    codes: np.ndarray
    offs: np.ndarray  # first unit of each text, n + 1
    data: np.ndarray  # bytes of the units, words with one blank behind each
    place: np.ndarray | None  # first byte of each word in ``data``, with one more at the end


def units(scheme: Scheme, data: np.ndarray, offs: np.ndarray) -> Units:
    if scheme.unit == "byte":
        return Units(BYTE_CODES[data], offs, data, None)
    starts, ends, woff = words(data, offs)
    sizes = ends - starts + 1
    place = np.concatenate(([0], np.cumsum(sizes)))
    out = np.append(data, np.uint8(0x20))[ranges(starts, sizes)]
    out[place[1:] - 1] = 0x20
    return Units(word_codes(data, starts, ends, lower=False), woff, out, place)


class Anchors(NamedTuple):
    h: np.ndarray  # hash of each gram
    low: np.ndarray  # which grams lie below the threshold, in a text that has windows
    valid: np.ndarray  # which windows lie in one text
    least: np.ndarray  # smallest gram of each window
    bare: np.ndarray  # which of the valid windows have no low gram


def anchors(scheme: Scheme, u: Units) -> Anchors | None:
    n, w, m = len(u.codes), scheme.window, scheme.gram
    long = np.diff(u.offs) >= w
    if not long.any():
        return None

    def inside(width: int) -> np.ndarray:
        step = np.zeros(n + 2, np.int32)
        np.add.at(step, u.offs[:-1][long], 1)
        np.add.at(step, u.offs[1:][long] - width + 1, -1)
        return np.cumsum(step[: n - width + 1]) > 0

    h, valid = grams_hash(u.codes, m), inside(w)
    limit = U64(2**64 // scheme.rate)
    least = sliding(h, w - m + 1)
    return Anchors(h, (h < limit) & inside(m), valid, least, valid & (least >= limit))


def counted(scheme: Scheme, a: Anchors) -> np.ndarray:
    """The grams that are an anchor of some window: low ones, and the smallest of bare windows."""
    if not a.bare.any():
        return a.low
    width = scheme.window - scheme.gram + 1
    pad = np.zeros(width - 1, U64)
    most = sliding(np.concatenate((pad, np.where(a.bare, a.least, U64(0)), pad)), width, np.maximum)  # over the windows around each gram
    return a.low | (most == a.h)


def anchor_counts(docs: DataFrame, scheme: Scheme) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                a = anchors(scheme, units(scheme, data, offs))
                values, n = np.unique(a.h[counted(scheme, a)] if a else np.zeros(0, U64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


class BitTable:
    """Membership by the low bits of a hash."""

    def __init__(self, bits: int, raw: bytes):
        self.bits, self.raw = bits, raw

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & U64((1 << self.bits) - 1)
        return (np.frombuffer(self.raw, np.uint8)[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 > 0


def bit_table(repeated: DataFrame) -> BitTable:
    """The bit table of column ``h``; its segments are filled on the executors."""
    n = repeated.count()
    bits = min(MAX_BITS, max(MIN_BITS, (16 * max(n, 1)).bit_length()))

    def fill(key: tuple, part: pa.Table) -> pa.Table:
        flags = np.zeros(1 << SEGMENT, bool)
        flags[part.column("at").to_numpy()] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "raw": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = repeated.select(F.shiftright(low, SEGMENT).alias("segment"), low.bitwiseAND(F.lit((1 << SEGMENT) - 1)).alias("at")).distinct()
    raw = bytearray(1 << (bits - 3))
    size = 1 << (SEGMENT - 3)
    for r in rows.groupBy("segment").applyInArrow(fill, "segment bigint, raw binary").toLocalIterator():
        raw[r["segment"] * size : (r["segment"] + 1) * size] = r["raw"]
    return BitTable(bits, bytes(raw))


def passing(scheme: Scheme, u: Units, table: BitTable) -> tuple[np.ndarray, np.ndarray]:
    """The windows whose anchors all repeat, and each one's smallest anchor."""
    a = anchors(scheme, u)
    if a is None:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(a.low)
    dead = np.zeros(len(a.h) + 1, np.int32)
    dead[at[~table.has(a.h[at])] + 1] = 1
    np.cumsum(dead, out=dead)
    width = scheme.window - scheme.gram + 1
    good = a.valid & ~a.bare & (dead[width:] == dead[:-width])
    bare = np.flatnonzero(a.bare)
    good[bare[table.has(a.least[bare])]] = True
    keep = np.flatnonzero(good)
    return keep, a.least[keep]


def super_kmers(scheme: Scheme, keep: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one key, of one window length at most: (first window, windows, key)."""
    if not len(keep):
        return keep, keep, key
    new = np.ones(len(keep), bool)
    new[1:] = (keep[1:] != keep[:-1] + 1) | (key[1:] != key[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(keep)), 0))
    new |= (np.arange(len(keep)) - first) % scheme.window == 0
    at = np.flatnonzero(new)
    return keep[at], np.diff(np.append(at, len(keep))), key[at]


def pack(u: Units, start: int, n_units: int) -> bytes:
    if u.place is None:
        return u.data[start : start + n_units].tobytes()
    return u.data[u.place[start] : u.place[start + n_units] - 1].tobytes()


#: Name a row; rows equal in id and text are one document.
DOCUMENT = ["doc_id", "text_key"]


def named(docs: DataFrame, *carry: str) -> DataFrame:
    """``given`` (the id), ``doc_id`` (``FIRST_ID`` for null), ``text_key``, ``text`` and what is carried along."""
    return docs.select(F.col("doc_id").alias("given"), F.coalesce("doc_id", F.lit(FIRST_ID)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", *carry)


def travelling(docs: DataFrame, scheme: Scheme, table) -> DataFrame:
    """The packed strings of all documents: ``key``, ``windows``, ``packed``, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, data, offs in slices(batch.column(2)):
                u = units(scheme, data, offs)
                start, n, key = super_kmers(scheme, *passing(scheme, u, table.value))
                if not len(start):
                    continue
                d = np.searchsorted(u.offs, start, "right") - 1
                packed = [pack(u, a, k + scheme.window - 1) for a, k in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(ids[first + d]), pa.array(start - u.offs[d]), pa.array(keys[first + d])],
                    ["key", "windows", "packed", "doc_id", "start", "text_key"],
                )

    return named(docs).drop("given").mapInArrow(run, "key bigint, windows int, packed binary, doc_id bigint, start bigint, text_key bigint")


class Strings(NamedTuple):
    """Distinct packed strings of whole buckets, in key order."""

    key: np.ndarray
    windows: np.ndarray
    packed: list[bytes]
    doc_id: np.ndarray
    start: np.ndarray
    copies: np.ndarray


#: Gives for each string one boolean for each of its windows, true if the window goes; or None if all go.
Resolver = Callable[[Scheme, Strings], list[np.ndarray | None]]


def combined(strings: DataFrame, copies: Column) -> DataFrame:
    place = F.min(F.struct("doc_id", "start", "text_key")).alias("first")
    return strings.groupBy("key", "windows", "packed").agg(place, F.sum(copies).alias("copies")).select("key", "windows", "packed", "first.*", "copies")


def dealt_anew(strings: DataFrame, scheme: Scheme, level: int) -> DataFrame:
    """Strings cut and keyed by the longer anchors of ``level``."""
    places = scheme.window - scheme.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                many = part.column(1).to_numpy().astype(np.int64)
                for first, end, data, offs in slices(part.column(2)):
                    u = units(scheme, data, offs)
                    k = many[first:end]
                    start = ranges(u.offs[:-1], k)
                    h = grams_hash(u.codes, scheme.gram)
                    least = np.repeat(sliding(h, places)[u.offs[:-1]], np.diff(u.offs))  # a string's windows share it
                    hits = np.flatnonzero(h == least[: len(h)])
                    place = hits[np.searchsorted(hits, start)] - start
                    kind = place * (1 << level) // places
                    low, high = (-(-c * places >> level) for c in (kind, kind + 1))
                    begin = start + place - low
                    key = runs_hash(u.codes, begin, begin + scheme.window - (high - low) + 1)
                    cut, n, key = super_kmers(scheme, start, key)
                    d = np.searchsorted(u.offs, cut, "right") - 1
                    row = first + d
                    packed = [pack(u, a, w + scheme.window - 1) for a, w in zip(cut.tolist(), n.tolist())]
                    columns = {
                        "key": pa.array(key.view(np.int64)),
                        "windows": pa.array(n.astype(np.int32)),
                        "packed": pa.array(packed, pa.binary()),
                        "doc_id": part.column(3).take(pa.array(row)),
                        "start": pa.array(part.column(4).to_numpy()[row] + cut - u.offs[d]),
                        "text_key": part.column(5).take(pa.array(row)),
                        "copies": part.column(6).take(pa.array(row)),
                    }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return strings.mapInArrow(run, strings.schema)


def resolved(strings: DataFrame, scheme: Scheme, resolver: Resolver) -> DataFrame:
    """(doc_id, text_key, start, windows, goes): strings of which some window stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle_chunk(part: pa.Table) -> pa.RecordBatch:
            col = {c: part.column(c).combine_chunks() for c in part.column_names}
            s = Strings(col["key"].to_numpy(), col["windows"].to_numpy(), col["packed"].to_pylist(), col["doc_id"].to_numpy(), col["start"].to_numpy(), col["copies"].to_numpy())
            goes = resolver(scheme, s)
            at = [i for i, g in enumerate(goes) if g is not None and not g.all()]
            pick = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([col["doc_id"].take(pick), col["text_key"].take(pick), col["start"].take(pick), col["windows"].take(pick), pa.array([np.packbits(goes[i]).tobytes() for i in at], pa.binary())], ["doc_id", "text_key", "start", "windows", "goes"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < len(batch):
                step = batch.slice(at, 500)
                at += 500
                held.append(step)
                size += step.column(2).nbytes
                if size >= CHUNK:
                    part = pa.Table.from_batches(held)
                    keys = part.column("key").to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                    if cut:
                        yield settle_chunk(part.slice(0, cut))
                        rest = part.slice(cut)
                        held = rest.combine_chunks().to_batches()
                        size = sum(b.column(2).nbytes for b in held)
        if held:
            yield settle_chunk(pa.Table.from_batches(held))

    return strings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id bigint, text_key bigint, start bigint, windows int, goes binary")


def staying(docs: DataFrame, scheme: Scheme, table, resolver: Resolver) -> DataFrame:
    """For each document with windows that pass and yet stay, their list."""
    left = settle(combined(travelling(docs, scheme, table), F.lit(1)), "strings")
    parts, level = [], 0
    while 1 << level < scheme.window - scheme.gram + 1:
        sizes = left.groupBy("key").agg(F.sum(F.length("packed") + 8).alias("size"), F.count("*").alias("n"))
        large = settle(sizes.filter((F.col("size") > BUCKET_BYTES) & (F.col("n") > 1)).select("key"), "large")
        if large.isEmpty():
            break
        parts.append(left.join(large, "key", "left_anti"))
        level += 1
        left = settle(combined(dealt_anew(left.join(large, "key", "left_semi"), scheme, level), F.col("copies")), "strings")
    for part in parts:
        left = left.unionByName(part)
    found = resolved(left, scheme, resolver)
    return found.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("start", "windows", "goes")).alias("stays"))


def covered(docs: DataFrame, scheme: Scheme, resolver: Resolver, finish: Callable, schema: str, names: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Applies ``finish(units, gone, doc)`` to every document; ``gone`` says of each unit whether it goes.

    ``finish`` gives a tuple for ``names``. Columns of ``docs`` other than ``doc_id``, ``text`` and those of
    ``carry``, which come behind the others, are dropped.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    repeated = settle(anchor_counts(docs, scheme).filter("n > 1").select("h"), "anchors")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(repeated))
    stays = staying(docs, scheme, table, resolver)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for first, end, data, offs in slices(batch.column(1)):
                u = units(scheme, data, offs)
                keep, _ = passing(scheme, u, table.value)
                goes = np.zeros(len(u.codes) + 1, bool)
                goes[keep] = True
                for d in range(end - first):
                    for s in lists[first + d].as_py() or ():
                        at = int(u.offs[d]) + s["start"]
                        goes[at : at + s["windows"]] = np.unpackbits(np.frombuffer(s["goes"], np.uint8), count=s["windows"])
                step = np.zeros(len(u.codes) + scheme.window + 1, np.int32)
                at = np.flatnonzero(goes)
                step[at] += 1
                step[at + scheme.window] -= 1
                gone = np.cumsum(step[: len(u.codes)]) > 0
                rows = [finish(u, gone, d) for d in range(end - first)]
                carried = [batch.column(3 + k).slice(first, end - first) for k in range(len(carry))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(c) for c in zip(*rows)), *carried], ["doc_id", *names, *carry])

    joined = named(docs, *carry).join(stays, DOCUMENT, "left").select(F.col("given").alias("doc_id"), "text", "stays", *carry)
    kinds = "".join(f", `{c}` {joined.schema[c].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(run, f"doc_id bigint, {schema}{kinds}")
