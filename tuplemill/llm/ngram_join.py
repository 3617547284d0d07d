"""Exact Jaccard self-join on word n-gram sets: links between sets, or the groups that they connect.

Documents with equal sets are one node (told apart by 128 bits of the set). Two sets whose Jaccard
similarity reaches the threshold share one of their first ``n - ceil(t * n) + 1`` elements in any common
order; elements are ordered by how often their hash bucket occurs in the corpus, so that common passages
come last.

Candidates meet in tiles: one prefix element and one size band. In a tile, bitmap signatures (a parity
bit for each hashed element, as many bits as the band's sizes) bound the overlap from above: each bit in
which two signatures differ stands for an element that the sets do not share. Pairs that the bound lets
through are verified by intersecting the sorted arrays of their shingles; shingles of one hash are compared
byte by byte.

For groups, each node first meets a hub of each of its tiles (one of ``HUBS`` for a group whose tiles have
the same nodes). Then nodes that share a tile and are still in different components meet: a tile gives
all its pairs that pass, or, where these are many, each node's nearest one. This joins groups of near copies
without drawing up their pairs. Last, all nodes of those crowded tiles that are still in different components
meet. Every pair that could link two components is tested, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplemill.llm.arrays import LOWER, U64, Shingles, binaries, binary_column, equal_spans, list_column, mix, ranges, shingles, slices, words
from tuplemill.llm.components import components
from tuplemill.llm.repeats import bit_table
from tuplemill.llm.storage import forget, settle, small_batches

#: Buckets of the corpus-wide count that orders elements, and counters in one of its rows.
BUCKETS, ROW = 1 << 18, 1 << 12
#: Nodes of a block of a tile, and bytes of their signatures, at most; larger tiles are compared block against block.
BLOCK, BLOCK_BYTES = 1 << 11, 1 << 24
LEAST_BAND = 6
HUBS = 3
#: A tile of more nodes gives its nodes' nearest pairs first if more pairs than nodes pass.
SMALL = 16
#: Words of signatures that are compared at once.
WORDS = 1 << 20


def set_names(s: Shingles, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set; sets of equal names are equal."""
    out = []
    for salt in (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)):
        total = np.zeros(len(n), U64)
        some = np.flatnonzero(n)
        if len(some):
            first = (np.cumsum(n) - n)[some]
            total[some] = np.add.reduceat(mix((s.h ^ salt) * U64(0x8EBC6AF09C88C6E3)), first)
        out.append(mix(total ^ n.astype(U64)).view(np.int64))
    return out[0], out[1]


def bands(n: np.ndarray) -> np.ndarray:
    """The size band ``e`` has the sets of at most 2**e elements that the band below hasn't."""
    return np.maximum(LEAST_BAND, np.ceil(np.log2(np.maximum(n, 1) - 0.5)).astype(np.int64))


def signatures(s: Shingles, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity bits of all sets, packed, and the bytes of each; an empty set has none."""
    bits = np.where(n > 0, np.left_shift(np.int64(1), bands(n)), 0)
    first = np.cumsum(bits) - bits
    at = first[s.owner] + ((s.h >> U64(20)) & (bits[s.owner] - 1).astype(U64)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=int(bits.sum())) & 1 > 0, bitorder="little"), bits // 8


def element_counts(docs: DataFrame, k: int) -> np.ndarray:
    """In how many documents the elements of each hash bucket occur, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0)):
                total += np.bincount((shingles(data, offs, k).h & U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        yield rows(enumerate(total.reshape(-1, ROW)))

    def rows(parts) -> pa.RecordBatch:
        at, values = zip(*parts)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), binaries(list(values))], ["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[at] = total.get(at, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        if total:
            yield rows(total.items())

    parts = docs.select("text").mapInArrow(count, "at bigint, counts binary").repartition("at").mapInArrow(add, "at bigint, counts binary")
    out = np.zeros((BUCKETS // ROW, ROW), np.int64)
    for r in parts.toLocalIterator():  # BUCKETS counters, whatever the input
        out[r["at"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n (set size), the set's names, the text's hash, prefix and signature of every document."""
    order = docs.sparkSession.sparkContext.broadcast(element_counts(docs, k))
    names = ["doc_id", "n", "name_a", "name_b", "text_key", "prefix", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in slices(batch.column(2)):
                s = shingles(data, offs, k)
                n = np.bincount(s.owner, minlength=end - first)
                often = order.value[(s.h & U64(BUCKETS - 1)).astype(np.int64)]
                by = np.lexsort((s.h, often, s.owner))
                place = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n)
                keep = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                prefix = s.h[by[place < np.repeat(keep, n)]]
                a, b = set_names(s, n)
                rows = [c.slice(first, end - first) for c in (batch.column(0), batch.column(1))]
                yield pa.RecordBatch.from_arrays([rows[0], pa.array(n), pa.array(a), pa.array(b), rows[1], list_column(prefix, keep), binary_column(*signatures(s, n))], names)

    schema = "doc_id bigint, n bigint, name_a bigint, name_b bigint, text_key bigint, prefix array<bigint>, bits binary"
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def nodes_of(sketched: DataFrame) -> DataFrame:
    """One row for each distinct set: a short id, its smallest document, and what its documents have in common."""
    first = [F.first(c).alias(c) for c in ("n", "text_key", "prefix", "bits")]
    grouped = sketched.filter("n > 0").groupBy("name_a", "name_b").agg(F.min("doc_id").alias("doc"), *first)
    return settle(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")


def meetings(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, hub, hub_n): the nodes of each prefix element that several nodes have, and the element's hub."""
    keyed = nodes.select("node", "n", F.explode("prefix").alias("key"))
    turn = F.xxhash64("node", F.pmod("key", F.lit(HUBS)))
    hubs = keyed.groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "node", "n")).alias("hub"), F.min("node").alias("x"), F.max("node").alias("y"))
    hubs = hubs.filter("x <> y").select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    return settle(keyed.join(hubs, "key").select("key", "node", "n", "hub", "hub_n"), "members")


def bound_holds(percent: int, na: np.ndarray, nb: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sizes and differing bits leave room for the threshold: overlap <= (na + nb - differ) / 2."""
    overlap = (na + nb - differ) // 2
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (100 * overlap >= percent * (na + nb - overlap))


def folded(raw: pa.Array, size: np.ndarray) -> np.ndarray:
    """The signatures of ``raw`` as rows of 64-bit words, all folded to ``size`` bytes; they have that many or twice as many."""
    blob, offs = np.frombuffer(raw.buffers()[2], U64), np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    wide = np.diff(offs) > size
    at = (offs[:-1] // 8)[:, None] + np.arange(int(size) // 8)
    out = blob[at]
    out[wide] ^= blob[at[wide] + int(size) // 8]
    return out


def star_candidates(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a node and a hub of one of its tiles that the bound lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            size = np.left_shift(np.int64(1), np.minimum(bands(na), bands(nb))) // 8
            near = np.abs(bands(na) - bands(nb)) <= 1
            keep = [np.zeros(0, np.int64)]
            for z in np.unique(size):
                rows = np.flatnonzero((size == z) & near)
                for part in np.array_split(rows, 1 + len(rows) * int(z) // (8 * WORDS)):
                    if not len(part):
                        continue
                    pick = pa.array(part)
                    differ = np.bitwise_count(folded(batch.column(4).take(pick), z) ^ folded(batch.column(5).take(pick), z)).sum(axis=1, dtype=np.int64)
                    keep.append(part[bound_holds(percent, na[part], nb[part], differ)])
            yield batch.take(pa.array(np.concatenate(keep))).select(["a", "b"])

    sized = members.filter(f"node <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    pairs = sized.select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("n").alias("na"), F.col("hub_n").alias("nb")).distinct()
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("bits").alias(f"r{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a bigint, b bigint")


def open_tiles(members: DataFrame, labels: DataFrame | None, nodes: DataFrame, percent: int, only: DataFrame | None = None) -> DataFrame:
    """The rows of tiles that hold more than one component, by key, band and pair of blocks; signatures are fetched last.

    A node is at home in its own size band, and a guest in the next lower one if it can link to a smaller set there.
    Without labels every node is its own component; with labels, hubs are left out, as they have met their tiles' nodes.
    ``only``: the tiles (key, band) that are wanted.
    """
    if labels is None:
        placed = members.select("key", "node", "n", F.col("node").alias("comp"))
    else:
        placed = members.filter("node <> hub").join(labels, "node", "left").select("key", "node", "n", F.coalesce("comp", "node").alias("comp"))
    own = F.greatest(F.lit(LEAST_BAND), F.length(F.bin(F.col("n") - 1)))
    guest = F.when((own > LEAST_BAND) & (F.ceil(F.col("n") * percent / 100) <= F.pow(F.lit(2), own - 1)), F.struct((own - 1).alias("band"), F.lit(False).alias("home")))
    both = F.array_compact(F.array(F.struct(own.alias("band"), F.lit(True).alias("home")), guest))
    placed = settle(placed.select("key", "node", "n", "comp", F.explode(both).alias("b")).select("key", "node", "n", "comp", "b.*"), "placed")
    if only is not None:
        placed = placed.join(only, ["key", "band"], "left_semi")
    open_ = placed.groupBy("key", "band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), F.max("home").alias("any")).filter("x <> y and any")
    rows = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.lit(8 * BLOCK_BYTES) / F.pow(F.lit(2), F.col("band"))))
    tiles = placed.join(open_.select("key", "band", "m"), ["key", "band"]).withColumn("blocks", F.ceil(F.col("m") / rows).cast("int"))
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("node", "key"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiles = tiles.select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n", "home")
    return tiles.join(nodes.select("node", "bits"), "node").select("key", "band", "i", "j", "block", "node", "comp", "n", "home", "bits")


def tile_candidates(tiles: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """(a, b): pairs of nodes of one tile, in different components, that the bound lets through.

    Unless ``all_pairs``, a crowded tile gives each node's nearest such pair only, and a row (key, band) that says so.
    """
    names = ["a", "b", "key", "band"]

    def passing(t: dict, sign: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, comp, home = t["n"], t["comp"], t["home"]
        ok = (comp[x] != comp[y]) & (home[x] | home[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        if not len(x):
            return x, y, x
        differ = np.bitwise_count(sign[x] ^ sign[y]).sum(axis=1, dtype=np.int64)
        ok = bound_holds(percent, n[x], n[y], differ)
        return x[ok], y[ok], differ[ok]

    def compare(t: dict, sign: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple | None]]:
        """Pairs of rows, tile by tile or of many small tiles at once; and the name of a tile that has more."""
        m = len(t["n"])
        name = [t[c] for c in ("key", "i", "j")]
        cut = np.flatnonzero(np.concatenate(([True], np.any([v[1:] != v[:-1] for v in name], axis=0), [True])))
        size = np.diff(cut)
        start, stop = np.repeat(cut[:-1], size), np.repeat(cut[1:], size)
        first = t["block"] == t["i"]
        apart = t["i"] != t["j"]
        second = np.repeat(np.add.reduceat(first.astype(np.int64), cut[:-1]), size) + start  # rows of the first block come first
        low = np.where(apart, np.where(first, second, stop), np.arange(m) + 1)
        count = stop - low
        step = max(1, WORDS // sign.shape[1])
        small = np.repeat(size <= SMALL, size) | all_pairs
        for rows in split(np.flatnonzero(small & (count > 0)), count, step):
            x = np.repeat(rows, count[rows])
            a, b, _ = passing(t, sign, x, ranges(low[rows], count[rows]))
            yield a, b, None
        if all_pairs:
            return
        for c in np.flatnonzero(size > SMALL):
            lo, hi = int(cut[c]), int(cut[c + 1])
            found = [passing(t, sign, np.repeat(rows, count[rows]), ranges(low[rows], count[rows])) for rows in split(np.arange(lo, hi)[count[lo:hi] > 0], count, step)]
            a, b, d = (np.concatenate(v) if found else np.zeros(0, np.int64) for v in (zip(*found) if found else ((), (), ())))
            if len(a) <= hi - lo:
                yield a, b, None
                continue
            both, mate, d = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((d, d))
            order = np.lexsort((mate, d, both))
            pick = order[np.concatenate(([True], both[order][1:] != both[order][:-1]))]
            yield both[pick], mate[pick], (t["key"][lo], t["band"][lo])

    def done(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        every = {c: part.column(c).to_numpy() for c in part.column_names if c != "bits"}
        pairs, more = [np.zeros((2, 0), np.int64)], []
        for band in np.unique(every["band"]):
            rows = np.flatnonzero(every["band"] == band)
            t = {c: v[rows] for c, v in every.items()}
            bits = part.column("bits").take(pa.array(rows)).combine_chunks()
            sign = folded(bits.chunk(0) if isinstance(bits, pa.ChunkedArray) else bits, np.int64(1 << int(band)) // 8)
            for x, y, crowded in compare(t, sign):
                a, b = t["node"][x], t["node"][y]
                pairs.append(np.stack((np.minimum(a, b), np.maximum(a, b))))
                if crowded:
                    more.append(crowded)
        found = np.unique(np.concatenate(pairs, axis=1), axis=1)
        none = pa.nulls(len(more), pa.int64())
        a, b = (pa.concat_arrays([pa.array(v), none]) for v in found)
        key = pa.concat_arrays([pa.nulls(found.shape[1], pa.int64()), pa.array([k for k, _ in more], pa.int64())])
        band = pa.concat_arrays([pa.nulls(found.shape[1], pa.int32()), pa.array([e for _, e in more], pa.int32())])
        return pa.RecordBatch.from_arrays([a, b, key, band], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.column(9).nbytes
            if rows >= 4 * BLOCK or size >= 2 * BLOCK_BYTES:
                part = pa.Table.from_batches(held)
                name = [part.column(c).to_numpy() for c in ("key", "band", "i", "j")]
                change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in name], axis=0))
                if len(change):
                    at = int(change[-1]) + 1  # the last tile may go on
                    yield done(part.slice(0, at))
                    held = part.slice(at).combine_chunks().to_batches()
                    rows, size = len(part) - at, sum(b.column(9).nbytes for b in held)
        if held:
            yield done(pa.Table.from_batches(held))

    name = ["key", "band", "i", "j"]
    return tiles.repartition(*name).sortWithinPartitions(*name, "block").mapInArrow(run, "a bigint, b bigint, key bigint, band int")


def split(rows: np.ndarray, count: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """``rows`` in runs with about ``most`` pairs each, one row at least."""
    total = np.cumsum(count[rows])
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield rows[at:end]
        at = end


def texts_of(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(node, words): the words of each wanted node, in small letters, joined by one blank.

    ``wanted``: node, name_a, name_b, text_key. Texts are picked by a bit table of their hashes, and told by their sets' names.
    """
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.col("text_key").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, at = np.unique(batch.column(0).to_numpy(), return_index=True)
            at = at[table.value.has(key.view(U64))]
            if not len(at):
                continue
            for first, end, data, offs in slices(batch.column(1).take(pa.array(at))):
                s = shingles(data, offs, k)
                a, b = set_names(s, np.bincount(s.owner, minlength=end - first))
                starts, ends, woff = words(data, offs)
                size = ends - starts + 1
                place = np.concatenate(([0], np.cumsum(size)))
                blob = np.append(LOWER[data], np.uint8(0x20))[ranges(starts, size)]
                blob[place[1:] - 1] = 0x20
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), binary_column(blob, np.diff(place[woff]))], ["name_a", "name_b", "words"])

    found = docs.select(F.xxhash64("text").alias("text_key"), "text").filter("text is not null").mapInArrow(run, "name_a bigint, name_b bigint, words binary")
    return found.join(wanted.select("node", "name_a", "name_b"), ["name_a", "name_b"]).groupBy("node").agg(F.first("words").alias("words"))


def overlaps(x: pa.Array, y: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shared shingles of each pair of texts, and each side's number; shingles of one hash are compared byte by byte."""
    m = len(x)
    both = pa.concat_arrays([x, y])
    shared, sizes = np.zeros(m, np.int64), []
    for _, _, data, offs in slices(both, limit=1 << 40):
        s = shingles(data, offs, k, lower=False)
        sizes = np.bincount(s.owner, minlength=2 * m)
        pair, side = s.owner % m, s.owner >= m
        order = np.lexsort((side, s.h, pair))
        one, two = order[:-1], order[1:]
        hit = np.flatnonzero((pair[one] == pair[two]) & (s.h[one] == s.h[two]))
        one, two = one[hit], two[hit]
        size = s.end[one] - s.begin[one]
        same = size == s.end[two] - s.begin[two]
        same[same] = equal_spans(data, s.begin[one[same]], s.begin[two[same]], size[same])
        shared = np.bincount(pair[one[same]], minlength=m)
    return shared, sizes[:m], sizes[m:]


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose sorted arrays intersect enough."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = settle(nodes.join(ends, "node", "left_semi").select("node", "name_a", "name_b", "text_key"), "wanted")
    texts = settle(texts_of(docs, k, wanted), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.asarray(pc.binary_length(batch.column(2))) + np.asarray(pc.binary_length(batch.column(3))))
            cuts = np.unique(np.append(np.searchsorted(size, np.arange(1 << 20, int(size[-1]) if len(size) else 0, 1 << 20)), [0, len(batch)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(lo, hi - lo)
                shared, na, nb = overlaps(part.column(2), part.column(3), k)
                good = pa.array(100 * shared >= percent * (na + nb - shared))
                yield part.select(["a", "b"]).filter(good)

    of = lambda c: texts.select(F.col("node").alias(c), F.col("words").alias(f"w{c}"))
    links = settle(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "wa", "wb").mapInArrow(run, "a bigint, b bigint"), "links")
    forget(wanted, texts)
    return links


def _prepared(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = settle(sketches(docs, k, percent), "sketches")
    nodes = nodes_of(sketched)
    thin = settle(sketched.select("doc_id", "n", "name_a", "name_b"), "documents")
    forget(sketched)
    return docs, thin, nodes, meetings(nodes, percent)


def jaccard_links(docs: DataFrame, k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """All links between unlike sets, and which documents have which set.

    Gives (a, b) with a < b, the names of two sets that link, and (doc_id, node, n_links): each document's set
    and the number of sets that it links to; an empty set has a null name and no links. Documents of one set are
    linked with one another by having it. Input as for ``jaccard_groups``.
    """
    docs, thin, nodes, members = _prepared(docs, k, percent)
    pairs = settle(tile_candidates(open_tiles(members, None, nodes, percent), percent, all_pairs=True).select("a", "b").distinct(), "pairs")
    links = verified(pairs, docs, nodes, k, percent)
    each = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.select("node", "name_a", "name_b").join(each, "node", "left")
    rows = thin.withColumn("full", F.col("n") > 0).join(named.withColumn("full", F.lit(True)), ["full", "name_a", "name_b"], "left")
    return links, rows.select("doc_id", "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Links documents whose sets of distinct ``k``-word shingles have 100 * |both| >= percent * |either|.

    Texts are lower-cased in A-Z; words are ``[^\\x20\\x09-\\x0D]+``; with fewer than ``k`` words the whole
    sequence is one shingle. A null text or one without words has an empty set and no links. Gives one row
    for each input row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest ``doc_id`` reachable by links;
    its own if it has none). Rows that repeat give equal rows; a null ``doc_id`` counts for no minimum, and a
    group of nulls has a null ``component_id``. Other columns are dropped.
    """
    docs, thin, nodes, members = _prepared(docs, k, percent)
    near = settle(star_candidates(members, nodes, percent), "stars")
    links = verified(near, docs, nodes, k, percent)
    labels = components(links)

    only = None
    for all_pairs in (False, True):
        found = settle(tile_candidates(open_tiles(members, labels, nodes, percent, only), percent, all_pairs), "found")
        rest = settle(found.filter("a is not null").select("a", "b").distinct(), "rest")
        only = settle(found.filter("key is not null").select("key", "band").distinct(), "crowded")
        forget(found)
        if not rest.isEmpty():
            links = links.union(verified(rest, docs, nodes, k, percent))
            labels = components(links)
        if only.isEmpty():
            break

    least = nodes.select("node", "name_a", "name_b", "doc").join(labels, "node", "left")
    least = settle(least.select("name_a", "name_b", "doc", F.coalesce("comp", "node").alias("comp")), "least")
    forget(members, nodes)
    roots = least.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = thin.filter("n > 0").join(least.join(roots, "comp").select("name_a", "name_b", "component_id"), ["name_a", "name_b"])
    bare = thin.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(bare.select("doc_id", "n", "component_id"))
