"""Substring dedup on words by super-k-mer partitioning.

Consecutive windows of words that share a minimiser travel as one packed string to the
minimiser's bucket, where the windows are sorted and equal ones counted exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tuplemill.llm import repeats
from tuplemill.llm.arrays import equal_spans, grams_hash, ranges, text_buffers


def later_windows(scheme: repeats.Scheme, s: repeats.Strings) -> list[np.ndarray]:
    """Which windows of each string's first place also start earlier, in this or in another string."""
    data, offs = text_buffers(pa.array(s.packed, pa.binary()))
    u = repeats.units(scheme, data, offs)
    n = s.windows.astype(np.int64)
    owner, at = np.repeat(np.arange(len(n)), n), ranges(u.offs[:-1], n)
    h = grams_hash(u.codes, scheme.window)[at]
    doc, place = s.doc_id[owner], s.start[owner] + at - u.offs[owner]
    order = np.lexsort((place, doc, h))
    o, at = order, at[order]
    same = h[o][1:] == h[o][:-1]
    begin, size = u.place[at], u.place[at + scheme.window] - u.place[at]
    rows = np.flatnonzero(same)
    equal = size[rows] == size[rows + 1]
    equal[equal] = equal_spans(u.data, begin[rows[equal]], begin[rows[equal] + 1], size[rows[equal]])  # bytes decide
    if not equal.all():
        return _by_bytes(u.data, begin, size, doc[o], place[o], o, n)
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(o)), 0))
    later = (doc[o] != doc[o][head]) | (place[o] != place[o][head])
    goes = np.zeros(len(o), bool)
    goes[o] = later
    return np.split(goes, np.cumsum(n)[:-1])


def _by_bytes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, place: np.ndarray, order: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """``later_windows`` of strings in which unlike windows have one hash: windows in order of hash and place, told apart by their bytes."""
    first: dict[bytes, tuple[int, int]] = {}
    goes = np.zeros(len(order), bool)
    for i in np.lexsort((place, doc)).tolist():
        here = (int(doc[i]), int(place[i]))
        goes[order[i]] = first.setdefault(data[begin[i] : begin[i] + size[i]].tobytes(), here) != here
    return np.split(goes, np.cumsum(n)[:-1])


def dedup_words(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that also starts earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Earlier: in a document of smaller ``doc_id``, or
    in the same document before. Windows are judged on the input. Gives ``doc_id``, ``n_words``,
    ``n_removed``, ``kept_sha256`` (of the kept words joined by one blank) and, if asked,
    ``kept`` (that text). A null text has no words. A null ``doc_id`` comes before all others.
    Rows equal in ``doc_id`` and text are one document, and each gives a row. Texts of one id
    that differ count as one document whose places may coincide; none of two equal places is
    the earlier. Other columns are dropped.
    """
    scheme = repeats.Scheme("word", window, max(1, window // 5), 5)

    def finish(u: repeats.Units, gone: np.ndarray, d: int) -> tuple:
        a, b = int(u.offs[d]), int(u.offs[d + 1])
        stay = np.flatnonzero(~gone[a:b]) + a
        if len(stay) == b - a:
            kept = u.data[u.place[a] : u.place[b]].tobytes()[:-1]
        else:
            kept = u.data[ranges(u.place[stay], np.diff(u.place)[stay])].tobytes()[:-1]
        return (b - a, b - a - len(stay), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else []))

    names = ["n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    schema = "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return repeats.covered(docs, scheme, later_windows, finish, schema, names)
