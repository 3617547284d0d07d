"""Substring dedup on bytes with suffix arrays built by linear grouping.

``suffix_order`` sorts the suffixes of many strings at once. First, suffixes are grouped by
their Lyndon prefixes: the groups of a string are taken in descending order; each member's
previous-smaller pointer names the suffix whose Lyndon prefix the member's extends, and the
suffixes so named move, by the number of members that name them, to new groups right above
their old ones. Then each group's order is emitted from the sorted suffixes before it: no
renaming, no recursion. The strings of a batch take these steps side by side, so that one
numpy operation serves a step of all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tuplemill.llm import repeats
from tuplemill.llm.arrays import BYTE_CODES, grams_hash, ranges, text_buffers

#: Symbols that are sorted together.
BATCH = 1 << 20


def suffix_order(sym: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix arrays of the strings ``sym[bounds[k]:bounds[k + 1]]``, one after another.

    Each string's last symbol must be smaller than all its others. Symbols are below 512.
    """
    n = len(sym)
    lo, end = bounds[:-1], bounds[1:]
    owner = np.repeat(np.arange(len(lo)), end - lo)
    value = owner * 512 + sym
    sa = np.argsort(value, kind="stable")
    value = value[sa]
    new = np.ones(n, bool)
    new[1:] = value[1:] != value[:-1]
    heads = np.flatnonzero(new)
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    rank, group = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    group[sa] = np.repeat(heads, size[heads])
    smaller = np.arange(n) - 1
    named = np.zeros(n, bool)

    top, active = end.copy(), np.arange(len(lo))
    while len(active):
        first = group[sa[top[active] - 1]]
        many = top[active] - first
        single = len(active) == many.sum()
        s = sa[first] if single else sa[ranges(first, many)]
        low, cut = (lo[active], first) if single else (np.repeat(lo[active], many), np.repeat(first, many))
        p = smaller[s]
        todo = np.flatnonzero(p >= low)
        while len(todo := todo[group[p[todo]] >= cut[todo]]):
            p[todo] = smaller[p[todo]]
            smaller[s] = p
            todo = todo[p[todo] >= low[todo]]
        p = p[p >= low]
        if len(p):
            if single:
                count = np.ones(len(p), np.int64)
            else:
                p, count = np.unique(p, return_counts=True)
            g = group[p]
            if not single:
                order = np.lexsort((count, g))
                p, count, g = p[order], count[order], g[order]
            head = np.ones(len(p), bool)
            head[1:] = g[1:] != g[:-1]
            at = np.flatnonzero(head)
            moved = np.diff(np.append(at, len(p)))
            begin = g + size[g] - np.repeat(moved, moved)
            slot = begin + np.arange(len(p)) - np.repeat(at, moved)
            named[p] = True
            out = sa[slot]
            out = out[~named[out]]
            named[p] = False
            free = rank[p]
            free = np.sort(free[free < begin])
            sa[free], rank[out] = out, free
            sa[slot], rank[p] = p, slot
            size[g[at]] -= moved
            head[1:] |= count[1:] != count[:-1]
            at = np.flatnonzero(head)
            new_size = np.diff(np.append(at, len(p)))
            group[p] = np.repeat(slot[at], new_size)
            size[slot[at]] = new_size
        top[active] = first
        active = active[first > lo[active]]

    order, fill, done = np.empty(n, np.int64), np.arange(n), np.zeros(n, bool)
    order[lo], done[end - 1] = end - 1, True
    at, p, active = lo.copy(), end - 2, np.flatnonzero(end - lo > 1)
    while len(active):
        q = p[active]
        can = (q >= lo[active]) & ~done[q]
        q, who = q[can], active[can]
        g = group[q]
        order[fill[g]] = q
        fill[g] += 1
        done[q] = True
        p[who] = smaller[q]
        who = active[~can]
        at[who] += 1
        over = at[who] >= end[who]
        live = who[~over]
        p[live] = order[at[live]] - 1
        if over.any():
            active = active[at[active] < end[active]]
    return order


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether ``data[a:a + width]`` equals ``data[b:b + width]``, eight bytes at a time."""
    raw = np.frombuffer(data.tobytes() + b"\0" * (16 - len(data) % 8), np.uint64)
    eight = np.lib.stride_tricks.as_strided(raw, (len(data),), (1,))
    rows = np.arange(len(a))
    for k in (*range(0, width - 7, 8), *([width - 8] if width % 8 else [])):
        rows = rows[eight[a[rows] + k] == eight[b[rows] + k]]
        if not len(rows):
            break
    out = np.zeros(len(a), bool)
    out[rows] = True
    return out


def unrepeated_windows(scheme: repeats.Scheme, s: repeats.Strings) -> list[np.ndarray | None]:
    """Which windows of each string start anywhere else.

    All windows of a string with several copies do, and none of one that is alone in its bucket and holds its gram once;
    suffix arrays decide the others.
    """
    goes: list[np.ndarray | None] = [None] * len(s.key)
    edges = np.flatnonzero(np.concatenate(([True], s.key[1:] != s.key[:-1], [True])))
    open_ = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if (s.copies[a:b] == 1).any()]
    alone = [a for a, b in open_ if b - a == 1]
    for a, once in zip(alone, _gram_stands_once(scheme, [s.packed[a] for a in alone])):
        if once:
            goes[a] = np.zeros(s.windows[a], bool)
    work = sorted((sum(len(s.packed[i]) + 1 for i in range(a, b)), a, b) for a, b in open_ if goes[a] is None)
    at = 0
    while at < len(work):
        take, total = at, 0
        while take < len(work) and (take == at or total + work[take][0] <= BATCH):
            total += work[take][0]
            take += 1
        _search(scheme, s, [(a, b) for _, a, b in work[at:take]], goes)
        at = take
    return goes


def _gram_stands_once(scheme: repeats.Scheme, strings: list[bytes]) -> np.ndarray:
    """Whether the smallest gram, which all windows of a string share, stands in it once: then none of its windows equals another."""
    if not strings:
        return np.zeros(0, bool)
    data, offs = text_buffers(pa.array(strings, pa.binary()))
    h = grams_hash(BYTE_CODES[data], scheme.gram)
    first = np.stack((offs[:-1], offs[:-1] + scheme.window - scheme.gram + 1), axis=1).ravel()
    least = np.minimum.reduceat(np.append(h, np.uint64(2**64 - 1)), first)[::2]
    owner = np.repeat(np.arange(len(strings)), np.diff(offs))[: len(h)]
    hits = np.flatnonzero(h == least[owner])
    hits = hits[hits + scheme.gram <= offs[owner[hits] + 1]]
    return np.bincount(owner[hits], minlength=len(strings)) == 1


def _search(scheme: repeats.Scheme, s: repeats.Strings, buckets: list[tuple[int, int]], goes: list) -> None:
    parts, bounds, starts, sizes, which = [], [0], [], [], []
    at = 0
    for a, b in buckets:
        for i in range(a, b):
            row = np.frombuffer(s.packed[i], np.uint8)
            parts += [row.astype(np.int16) + 2, np.ones(1, np.int16)]  # 1 ends a string, 0 a bucket
            starts.append(at)
            sizes.append(int(s.windows[i]))
            which.append(i)
            at += len(row) + 1
        parts[-1] = np.zeros(1, np.int16)
        bounds.append(at)
    sym, begin, n = np.concatenate(parts), np.array(starts, np.int64), np.array(sizes, np.int64)
    whole = np.zeros(len(sym), bool)
    whole[ranges(begin, n)] = True
    order = suffix_order(sym, np.array(bounds, np.int64))
    order = order[whole[order]]
    # suffixes whose windows are equal are neighbours now
    owner = np.searchsorted(np.array(bounds), order, "right")
    same = np.flatnonzero(owner[1:] == owner[:-1])
    same = same[_equal((sym - 2).astype(np.uint8), order[same], order[same + 1], scheme.window)]
    found = np.zeros(len(sym), bool)
    found[order[same]] = True
    found[order[same + 1]] = True
    for i, a, k in zip(which, starts, sizes):
        if s.copies[i] == 1:
            goes[i] = found[a : a + k]


def _utf8_whole(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` widened so that a character of which one byte goes goes as a whole."""
    lead = (data & 0xC0) != 0x80
    if not len(data):
        return gone
    char = np.cumsum(lead) - lead[0]
    hit = np.zeros(int(char[-1]) + 1, bool)
    hit[char[gone]] = True
    return hit[char]


def dedup_bytes(docs: DataFrame, window: int = 200, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each byte covered by a ``window``-byte string that also starts anywhere else.

    Texts are taken as UTF-8 bytes; a null text is empty. Elsewhere: in another row or at another
    place of the same text; overlaps count; strings never cross rows and are judged on the input.
    Gives ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``
    (of the remaining bytes) and, if asked, ``kept``: the remaining text, without characters of which
    a byte was removed. Rows that repeat remove one another; a null ``doc_id`` stays null; columns
    named in ``carry`` come along, others are dropped.
    """
    gram = min(32, max(1, window // 4))
    scheme = repeats.Scheme("byte", window, gram, max(2, (window - gram) // 5))

    def finish(u: repeats.Units, gone: np.ndarray, d: int) -> tuple:
        a, b = int(u.offs[d]), int(u.offs[d + 1])
        data, out = u.data[a:b], gone[a:b]
        edge = np.diff(out.astype(np.int8), prepend=0)
        row = (b - a, int(out.sum()), int((edge == 1).sum()), hashlib.sha256(data[~out].tobytes()).hexdigest())
        return (*row, data[~_utf8_whole(data, out)].tobytes().decode()) if with_text else row

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    schema = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text
    return repeats.covered(docs, scheme, unrepeated_windows, finish, schema, names, carry)
