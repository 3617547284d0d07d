"""Mentions of documents by a resolver, and a resolver of plain rules.

A resolver is a function of a document's text that gives (cluster, text, offset) for each mention, or None if
it gives up. It runs on Arrow batches of documents; what it does to one document is that document's alone.
"""

from __future__ import annotations

import re
import signal
import threading
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Resolver = Callable[[str], "list[tuple[int, str, int]] | None"]
MENTION = "struct<cluster:int,text:string,offset:int>"
_MENTION = pa.struct([("cluster", pa.int32()), ("text", pa.string()), ("offset", pa.int32())])

# Pronouns by what they can stand for.
PRONOUNS = {"he": "m", "him": "m", "his": "m", "she": "f", "her": "f", "hers": "f", "it": "n", "its": "n", "they": "p", "them": "p", "their": "p"}
_NAME = re.compile(r"[A-Z][\w'’-]*(?: (?:of |the |de |von )?[A-Z][\w'’-]*)*")
_PRONOUN = re.compile(r"\b(?:" + "|".join(PRONOUNS) + r")\b", re.IGNORECASE)
#: Sentences back in which a pronoun looks for its name.
REACH = 2


@contextmanager
def _at_most(seconds: float) -> Iterator[None]:
    """Ends the block with TimeoutError after so many seconds; only a process's main thread can be ended so."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_) -> None:
        raise TimeoutError(f"took over {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def resolved(texts: DataFrame, resolver: Resolver, timeout: float = 30.0) -> DataFrame:
    """(docid, error, mentions) for each row of ``texts`` (docid, text).

    ``error`` says why a document has no mentions: the resolver raised, took over ``timeout`` seconds, gave None, or gave what isn't a
    mention; then ``mentions`` is null. A null or empty text has none and isn't shown to the resolver.
    """

    def one(text: str | None) -> tuple[str | None, list | None]:
        if not text:
            return None, []
        try:
            with _at_most(timeout):
                found = resolver(text)
                return ("gave up", None) if found is None else (None, [{"cluster": int(c), "text": str(t), "offset": int(o)} for c, t, o in found])
        except Exception as failure:  # whatever a resolver does to a document, the others go on
            return f"{type(failure).__name__}: {failure}"[:500], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [one(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([e for e, _ in results], pa.string()), pa.array([m for _, m in results], pa.list_(_MENTION))]
            yield pa.RecordBatch.from_arrays(columns, ["docid", "error", "mentions"])

    return texts.select("docid", "text").mapInArrow(run, f"docid string, error string, mentions array<{MENTION}>")


def mention_rows(results: DataFrame) -> DataFrame:
    """(docid, cluster_id, text, offset) of resolved documents."""
    return results.select("docid", F.explode("mentions").alias("m")).select("docid", F.col("m.cluster").alias("cluster_id"), "m.text", "m.offset")


def _names(text: str) -> list[tuple[int, str]]:
    """Runs of words in capitals; a sentence's first word counts only if the text never has it in small letters."""
    small = set(re.findall(r"\b[a-z][\w'’-]*", text))
    out = []
    for m in _NAME.finditer(text):
        name, at = m.group(), m.start()
        if at == 0 or text[at - 1] == "\n":
            first = name.split(" ", 1)
            if first[0].lower() in small or first[0].lower() in PRONOUNS or len(first[0]) == 1:
                if len(first) == 1:
                    continue
                at, name = at + len(first[0]) + 1, first[1]
                if not name[0].isupper():
                    continue
        if name.lower() not in PRONOUNS:
            out.append((at, name))
    return out


def sieve(text: str) -> list[tuple[int, str, int]]:
    """Clusters of two mentions or more, by three rules in turn; sentences are lines.

    Names that are equal but for case are one. A name that begins or ends exactly one longer name is that one. A pronoun
    is the nearest name before it, up to ``REACH`` lines back, that no pronoun of another kind stands for.
    """
    names = _names(text)
    cluster_of: dict[str, int] = {}
    for _, name in names:
        cluster_of.setdefault(name.lower(), len(cluster_of))
    long = [n for n in cluster_of if " " in n]
    for name in [n for n in cluster_of if " " not in n]:
        whole = [n for n in long if name in (n.split(" ")[0], n.split(" ")[-1])]
        if len(whole) == 1:
            cluster_of[name] = cluster_of[whole[0]]
    found = [(cluster_of[name.lower()], name, at) for at, name in names]
    lines = [m.start() for m in re.finditer("\n", text)]
    kind: dict[int, str] = {}
    for m in _PRONOUN.finditer(text):
        wanted, line = PRONOUNS[m.group().lower()], bisect_right(lines, m.start())
        for at, name in reversed(names):
            cluster = cluster_of[name.lower()]
            if at < m.start() and bisect_right(lines, at) >= line - REACH and kind.get(cluster, wanted) == wanted:
                kind[cluster] = wanted
                found.append((cluster, m.group(), m.start()))
                break
    size: dict[int, int] = {}
    for cluster, *_ in found:
        size[cluster] = size.get(cluster, 0) + 1
    return sorted((f for f in found if size[f[0]] > 1), key=lambda f: f[2])
