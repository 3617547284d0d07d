"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The state of a piece is, for each of its byte prefixes, the one token that can end that
prefix's encoding. A prefix's encoding is then read backwards from its last token. The
table makes two edits cheap and exact: appending bytes goes on from the stored states,
and an edit re-encodes only from its place on.

A token may follow another if the merges would leave the boundary between them alone;
exactly one last token of each prefix passes that test, as the encoding of a byte string
is unique and every prefix of an encoding is the encoding of its own bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplemill.llm.arrays import equal_spans, ranges, slices, spans_hash

#: Pieces in each of the two generations of a worker's memo; the older one goes when the younger is full.
MEMO_PIECES = 150_000
#: Pairs of tokens of which a worker keeps whether they fit.
MEMO_PAIRS = 300_000
#: Longer pieces aren't kept.
MEMO_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """For each merged token its rank and the ranks of the two tokens that it is merged from; the second is -1 if no merge makes it."""
    rows = [(rank, *_last_merge(ranks, token, rank)) for token, rank in ranks.items() if len(token) > 1]
    return np.array(rows, np.int32).reshape(-1, 3)


def _last_merge(ranks: dict[bytes, int], token: bytes, rank: int) -> tuple[int, int]:
    """The two tokens left when only merges below ``rank`` are done on ``token``."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks[t], i) for i in range(len(parts) - 1) if (t := parts[i] + parts[i + 1]) in ranks and ranks[t] < rank]
        if not options:
            break
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) != 2:
        return ranks[token[:1]], -1  # can't be reached by merges; never fits after another half
    return ranks[parts[0]], ranks[parts[1]]


class Vocabulary:
    """Ranks, the two tokens that each merged token comes from, and an automaton that finds the tokens ending at each byte."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray | None = None):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.shift = max(ranks.values()).bit_length() + 1
        merges = merge_table(ranks) if merges is None else merges
        self.halves = {r: (a, b) for r, a, b in merges.tolist()}
        self.pairs = {a << self.shift | b: r for r, a, b in merges.tolist()}
        self.fitting: dict[int, bool] = {}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    def fits(self, left: int, right: int) -> bool:
        """True if the encoding of ``left``'s and ``right``'s bytes together is these two tokens.

        Both tokens are undone merge by merge, the latest merge first. A merge across the
        boundary that comes before the merge which closes either side would win against it.
        """
        key = left << self.shift | right
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) >= MEMO_PAIRS:
                self.fitting.clear()
            known = self.fitting[key] = self._fits_slow(left, right)
        return known

    def _fits_slow(self, a: int, b: int) -> bool:
        limit = 1 << 62
        while True:
            across = self.pairs.get(a << self.shift | b)
            if across is not None and across < limit:
                return False
            if a > b:  # the later merge is undone first
                limit = a
                if a not in self.halves:
                    return True
                a = self.halves[a][1]
                if a < 0 or a == limit:
                    return True
            else:
                limit = b + 1  # at equal ranks the left merge is done first
                if b not in self.halves:
                    if a not in self.halves:
                        return True
                    limit = a
                    a = self.halves[a][1]
                else:
                    b = self.halves[b][0]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """``last`` holds the last token of each prefix of ``piece`` that is known, in order; the rest is added."""
        known, slow, shift, have = self.fitting, self.fits, self.shift, len(last)
        back = max(0, have - self.longest)  # a token that ends after ``have`` starts here at the earliest
        done = have - 1
        for end, (n, token) in self.automaton.iter(piece[back:].decode("latin-1")):  # longest first at each end
            end += back
            if end <= done:
                continue
            start = end - n
            if start >= 0:
                fit = known.get(last[start] << shift | token)
                if not (slow(last[start], token) if fit is None else fit):
                    continue
            last.append(token)
            done = end
        return last

    def read(self, last: list[int]) -> list[int]:
        """The encoding of the whole piece, from its prefix states."""
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.tokens[token])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read(self.extend(piece, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PieceState:
    """An editable piece: bytes with their prefix states."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece = vocabulary, piece
        self.last = vocabulary.extend(piece, [])

    def append(self, more: bytes) -> None:
        self.piece += more
        self.vocabulary.extend(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Prefixes up to ``start`` keep their states."""
        self.piece = self.piece[:start] + new + self.piece[end:]
        del self.last[start:]
        self.vocabulary.extend(self.piece, self.last)

    def ids(self) -> list[int]:
        return self.vocabulary.read(self.last)


class Splitter:
    """The cut of many texts at once into the pieces that a tokenizer's pattern matches.

    ``DEFAULT`` is the pattern whose rules are laid out here over arrays of character
    classes; any other pattern is matched text by text.
    """

    DEFAULT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    SPACE, LETTER, NUMBER, OTHER = range(4)
    _classes: np.ndarray | None = None

    def __init__(self, pattern: str):
        self.find = None if pattern == self.DEFAULT else regex.compile(pattern).finditer

    @classmethod
    def classes(cls) -> np.ndarray:
        """The class of every code point."""
        if cls._classes is None:
            table = np.full(0x110000, cls.OTHER, np.uint8)
            every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
            for kind, one in ((cls.SPACE, r"\s+"), (cls.LETTER, r"\p{L}+"), (cls.NUMBER, r"\p{N}+")):
                for m in regex.finditer(one, every):
                    a, b = (x + (x >= 0xD800) * 0x800 for x in m.span())
                    table[a:b] = kind
            cls._classes = table
        return cls._classes

    def starts(self, points: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where pieces start in ``points``, the code points of texts that start at ``offs[:-1]``."""
        if self.find is not None:
            whole = points.tobytes().decode("utf-32-le")
            return np.array([m.start() + a for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()) for m in self.find(whole[a:b])], np.int64)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes()[points]
        first = np.zeros(n + 3, bool)
        first[offs] = True
        first[n:] = True
        run = first[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        space, blank = kind == self.SPACE, points == 0x20
        start = run.copy()
        start[1:] &= ~(blank[:-1] & ~first[1:n] & ~space[1:])  # a blank goes with what follows it
        inner = space[:-1] & ~space[1:] & ~first[1:n]  # the last white space before a word stands apart
        start[:-1] |= inner
        quote = np.flatnonzero(start & run & (points == 0x27))
        quote = quote[~first[quote + 1]]
        if len(quote):
            ahead = np.concatenate((points, np.zeros(3, points.dtype)))
            one, two = ahead[quote + 1], np.where(first[quote + 2], 0, ahead[quote + 2])
            is_one = np.isin(one, [ord(x) for x in "stmd"])
            is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for ends, k in ((quote[is_one], 1), (quote[is_two & ~is_one], 2)):
                start[ends + 1] = False
                after = ends + 1 + k
                after = after[~first[after]]
                start[after[~space[after] & ~run[after]]] = True
        return np.flatnonzero(start)


def distinct_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, name: Callable = spans_hash) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct ``data[begin:end]``, and for each span which of those it equals. Names group, bytes decide."""
    _, at, which = np.unique(name(data, begin, end), return_index=True, return_inverse=True)
    size = end - begin
    same = size == size[at][which]
    same[same] = equal_spans(data, begin[same], begin[at][which[same]], size[same])
    if not same.all():
        odd = np.flatnonzero(~same)
        spans = [data[begin[i] : end[i]].tobytes() for i in odd.tolist()]
        first = {x: i for i, x in reversed(list(enumerate(spans)))}
        slot = {x: len(at) + k for k, x in enumerate(first)}
        at = np.concatenate((at, odd[list(first.values())]))
        which = which.copy()
        which[odd] = [slot[x] for x in spans]
    return at, which


class Encoder:
    """Texts to ids and back, with a bounded memo of short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: np.ndarray | None = None):
        self.vocabulary = Vocabulary(ranks, merges)
        self.splitter = Splitter(pattern)
        self.young: dict[bytes, tuple[bytes, int, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, int, bytes]] = {}

    def piece(self, raw: bytes) -> tuple[bytes, int, bytes]:
        """The ids as decimals that each have a blank behind, their number, and the bytes that the ids decode to."""
        known = self.young.get(raw)
        if known is None:
            known = self.old.pop(raw, None)
            if known is None:
                ids = self.vocabulary.encode_piece(raw)
                known = (" ".join(map(str, ids)) + " ").encode(), len(ids), self.vocabulary.decode(ids)
            if len(raw) <= MEMO_BYTES:
                if len(self.young) >= MEMO_PIECES:
                    self.old, self.young = self.young, {}
                self.young[raw] = known
        return known

    def encode_batch(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, decimal ids joined by one blank, decoded bytes) of each text."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        where = np.searchsorted(lead, offs)
        starts = self.splitter.starts(points, where)
        begin = lead[starts] if len(starts) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(data))
        at, which = distinct_spans(data, begin, end)
        raw = data.tobytes()
        got = [self.piece(raw[a:b]) for a, b in zip(begin[at].tolist(), end[at].tolist())]
        counts = np.array([x[1] for x in got], np.int64)
        first = np.searchsorted(begin, offs)  # the first piece of each text
        sums = np.concatenate(([0], np.cumsum(counts[which])))
        texts = []
        for field in (0, 2):
            sizes = np.array([len(x[field]) for x in got], np.int64)
            blob = np.frombuffer(b"".join([x[field] for x in got]), np.uint8)
            place = np.cumsum(sizes) - sizes
            joined = blob[ranges(place[which], sizes[which])].tobytes()
            texts.append((joined, np.concatenate(([0], np.cumsum(sizes[which])))[first].tolist()))
        (ids, a), (back, b) = texts
        total = sums[first].tolist()
        for d in range(len(offs) - 1):
            yield total[d + 1] - total[d], ids[a[d] : a[d + 1]][:-1], back[b[d] : b[d + 1]]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return [int(x) for _, ids, _ in self.encode_batch(raw, np.array([0, len(raw)])) for x in ids.split()]

    def decode(self, ids: list[int]) -> bytes:
        return self.vocabulary.decode(ids)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encodes ``text`` of every document and decodes the ids again.

    Gives ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space),
    ``decoded_sha256`` (of the decoded bytes) and, if asked, ``ids`` (array<int>). A null or
    empty text has no tokens and the digests of an empty string; a null ``doc_id`` stays
    null; a row that repeats gives a result each time. Other columns are dropped, whatever
    their names. ``ranks_path`` is read on the driver; the vocabulary (some megabytes, whatever the
    input) is broadcast. Memory: a slice of about a megabyte of text, or one text if that is longer.
    """
    ranks = load_ranks(ranks_path)
    vocabulary = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, merges = vocabulary.value
        encoder = Encoder(ranks, pattern, merges)  # for one task: a worker that goes on to other work keeps nothing of it
        for batch in batches:
            for first, end, data, offs in slices(batch.column(1)):
                rows = list(encoder.encode_batch(data, offs))
                columns = [
                    batch.column(0).slice(first, end - first),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for _, ids, _ in rows]),
                    pa.array([hashlib.sha256(back).hexdigest() for _, _, back in rows]),
                ]
                if with_ids:
                    columns.append(pa.array([np.array(ids.split(), dtype=np.int32) for _, ids, _ in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
