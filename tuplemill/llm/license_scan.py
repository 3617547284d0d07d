"""Licence scan: a trained paragraph classifier proposes families, templates confirm them.

Lines, paragraphs, overlapping windows of the words of each text, and the runs of words that hold most of a template's
grams wherever they stand, are scored by sparse multinomial regression on hashed one- and two-word grams. It is
trained on titles and perturbed forms of the statements in ``licences``, one class for each family, against an unknown
class of passages drawn from the corpus and of sentences that only sound alike. A temperature is fitted on templates that
training hasn't seen; a passage is a hit if its likeliest class is a family and the calibrated probability of the unknown
class is small. The families that the classifier holds likeliest are proposed in turn. A proposal is confirmed if the
passage names the family and is close to one of its templates, closer by a margin than to one of any other family that
it names, or holds most of a template's grams, or is the family's title. Without a hit nothing is confirmed.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplemill.llm import fitting
from tuplemill.llm.arrays import LOWER, U64, grams_hash, runs_hash, slices, spans_hash
from tuplemill.llm.licences import LOOKALIKES, TEMPLATES, TITLES, named, tokens

#: Corpus documents of which paragraphs teach the unknown class, at most; and paragraphs.
SAMPLE, PARAGRAPHS = 400, 3_000
SPACE, FORMS, EPOCHS = 1 << 16, 12, 4
UNKNOWN_AT_MOST, CONFIRMED_AT_LEAST = 0.5, 0.6
UNIT = 1 << 20
#: Families that are proposed of a passage at most, and the least probability of one.
PROPOSED, LEAST = 3, 0.02
#: By how much a passage must be closer to its family than to any other family that it names.
MARGIN = 0.02
#: Words of a scored window, from one to the next, and of a passage that is given with the whole of its lines.
WINDOW, STEP, WHOLE = 32, 16, 64
UNKNOWN = "unknown"
#: Passages for the unknown class: lines, cut between words into about a window's length.
PIECE = r"[^\n]{1,200}(?=\s|$)|[^\n]{1,200}"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def similarity(a: list[str], b: list[str]) -> float:
    """Shared over all two-word grams, doubled (words where a side has only one)."""
    pairs = [set(zip(x, x[1:])) if min(len(a), len(b)) > 1 else set(x) for x in (a, b)]
    return 2 * len(pairs[0] & pairs[1]) / max(1, len(pairs[0]) + len(pairs[1]))


_TEMPLATE_TOKENS = {k: [tokens(t) for t in v] for k, v in TEMPLATES.items()}


class Words(NamedTuple):
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray
    codes: np.ndarray  # hash of each word
    two: np.ndarray  # hash of each word and the next
    same: np.ndarray  # whether the next word is in the same text
    text: np.ndarray  # the text of each word
    line: np.ndarray  # the line of each word, counted over all texts
    edges: np.ndarray  # the first byte of each of those lines, and the end


def words_of(data: np.ndarray, offs: np.ndarray) -> Words:
    """The words of all texts and their grams."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    edge[1:] |= np.append(data == 0x0A, False)[:-1]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _WORD[data]
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    codes = spans_hash(LOWER[data], starts, ends)
    text = np.searchsorted(offs, starts, "right") - 1
    edges = np.append(np.flatnonzero(edge[:-1]), len(data))
    return Words(starts, ends, codes, grams_hash(codes, 2), text[1:] == text[:-1], text, (np.cumsum(edge) - 1)[starts], edges)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of equal values."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(key))


def units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of every line, of paragraphs of several lines, and of windows over texts of several lines or more words than a window has.

    Paragraphs are parted by lines without a word; those of more than ``WHOLE`` words are left to the windows.
    """
    first, end = runs(w.line)
    at, to = runs(np.cumsum(np.append(False, (np.diff(w.line) > 1) | ~w.same[: len(w.line) - 1]))[: len(w.line)])
    wrapped = (w.line[to - 1] > w.line[at]) & (to - at <= WHOLE) if len(at) else np.zeros(0, bool)
    first, end = np.concatenate((first, at[wrapped])), np.concatenate((end, to[wrapped]))
    at, to = runs(w.text)
    more = (w.line[to - 1] > w.line[at]) | (to - at > WINDOW) if len(at) else np.zeros(0, bool)
    at, to = at[more], to[more]
    n = np.maximum(1, -(-(to - at - WINDOW) // STEP) + 1)
    start = np.repeat(at, n) + STEP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return np.concatenate((first, start)), np.concatenate((end, np.minimum(start + WINDOW, np.repeat(to, n))))


def _template_grams() -> tuple[np.ndarray, list[tuple[str, np.ndarray, int]]]:
    """All grams of templates in order, and for each template its family, which of them it has, and its words."""
    names = [(k, t) for k, v in TEMPLATES.items() for t in v]
    grams = []
    for _, t in names:
        w = words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        grams.append(w.two)
    every = np.unique(np.concatenate(grams))
    return every, [(k, np.isin(every, g), len(g) + 1) for (k, _), g in zip(names, grams)]


def _title_hashes() -> dict[int, str]:
    found = {}
    for k, v in TITLES.items():
        for t in v:
            w = words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
            found[int(runs_hash(w.codes, np.array([0]), np.array([len(w.codes)]))[0])] = k
    return found


_GRAMS, _MEMBERS = _template_grams()
_TITLES = _title_hashes()
_TITLE_HASHES = np.array(sorted(_TITLES), U64)


class Passage(NamedTuple):
    first: int  # first word
    end: int
    family: str
    close: float


def statements(data: np.ndarray, w: Words) -> list[Passage]:
    """Titles, and the runs of words that hold ``CONFIRMED_AT_LEAST`` of a template's grams; they may overlap.

    A run may be longer than the template by a quarter and two words.
    """
    first, end = runs(w.line)
    hashes = runs_hash(w.codes, first, end)
    found = [Passage(int(first[i]), int(end[i]), _TITLES[int(hashes[i])], 1.0) for i in np.flatnonzero(np.isin(hashes, _TITLE_HASHES))]
    slot = np.searchsorted(_GRAMS, w.two)
    pos = np.flatnonzero((_GRAMS[np.minimum(slot, len(_GRAMS) - 1)] == w.two) & w.same)
    gram = slot[pos]
    for family, member, size in _MEMBERS:
        total, span = int(member.sum()), size + size // 4 + 2
        need = int(np.ceil(CONFIRMED_AT_LEAST * total - 1e-9))
        mine = member[gram]
        p, g = pos[mine], gram[mine].tolist()
        apart = p + w.text[p] * (2 * span)  # runs don't cross texts
        to = np.searchsorted(apart, apart + span - 2, "right")
        for a in np.flatnonzero(to - np.arange(len(p)) >= need).tolist():
            seen, last = set(), a
            for b in range(a, int(to[a])):
                if g[b] not in seen:
                    seen.add(g[b])
                    last = b
            if len(seen) >= need and family in named(tokens(data[w.starts[p[a]] : w.ends[p[last] + 1]].tobytes().decode())):
                found.append(Passage(int(p[a]), int(p[last]) + 2, family, len(seen) / total))
    return found


def apart(rows: list[tuple]) -> list[tuple]:
    """The best of rows (rank, first, end, ...) that don't overlap, in the order of the text."""
    kept: list[tuple] = []
    firsts: list[int] = []
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2]), reverse=True):
        at = bisect(firsts, row[1])
        if (at == 0 or kept[at - 1][2] <= row[1]) and (at == len(kept) or kept[at][1] >= row[2]):
            firsts.insert(at, row[1])
            kept.insert(at, row)
    return kept


class Model(NamedTuple):
    names: list[str]
    row_of: np.ndarray  # bucket to row of ``weights``; row 0 is all zero
    weights: np.ndarray  # by class and row, in parts of 1 / ``UNIT``, so that sums don't depend on their order
    bias: np.ndarray
    temperature: float

    def probabilities(self, w: Words, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each run of words."""
        z = np.zeros((len(first), len(self.names)))
        for values, last, allowed in ((w.codes, end, True), (w.two, end - 1, w.same)):
            row = self.row_of[(values & U64(SPACE - 1)).astype(np.int64)]
            at = np.flatnonzero((row != 0) & allowed)
            lo, hi = np.searchsorted(at, first), np.searchsorted(at, last)
            row, sums = row[at], np.zeros(len(at) + 1, np.int64)
            for k, weights in enumerate(self.weights):
                np.cumsum(weights[row], out=sums[1:])
                z[:, k] += sums[hi] - sums[lo]
        n = np.sqrt(np.maximum(2 * (end - first) - 1, 1))[:, None] * UNIT
        return fitting.softmax((z / n + self.bias) / self.temperature)


def training_rows(corpus: list[str], seed: int = 8) -> tuple[list[str], list[int], np.ndarray]:
    """Texts, class numbers, and which rows are held back: of families with several templates one template and all its forms, and every fifth unknown.

    Forms of a template have words dropped or stand in other text, and still name the family, so near families are told apart by their names.
    """
    rng = np.random.default_rng(seed)
    stated = set()
    for first, _, data, offs in slices(pa.array(corpus, pa.string())):
        w = words_of(data, offs)
        stated.update(first + int(w.text[x.first]) for x in statements(data, w))
    lines = [x for i, x in enumerate(corpus) if x.strip() and i not in stated]
    filler = [w for x in (lines or LOOKALIKES) for w in x.split()][:5000]
    texts, labels, back = [], [], []
    for k, (family, templates) in enumerate(TEMPLATES.items()):
        for j, template in enumerate(templates):
            for form in range(FORMS):
                words = template.split()
                if form:
                    dropped = [w for w in words if rng.random() > 0.05]
                    words = dropped if family in named(tokens(" ".join(dropped))) else words
                if form % 4 == 3:
                    extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(1, 6))]
                    words = extra + words if form % 8 == 3 else words + extra
                texts.append(" ".join(words))
                labels.append(k)
                back.append(len(templates) > 1 and j == k % len(templates))
        for title in TITLES.get(family, ()):
            texts.append(title)
            labels.append(k)
            back.append(False)
    for i, text in enumerate(LOOKALIKES * 10 + lines):
        texts.append(text)
        labels.append(len(TEMPLATES))
        back.append(i % 5 == 0)
    return texts, labels, np.array(back)


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text, taken as one line."""
    rows: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
    for first, _, data, offs in slices(pa.array([t.replace("\n", " ") for t in texts])):
        w = words_of(data, offs)
        for a, b in zip(*(x.tolist() for x in runs(w.text))):
            bucket = (np.concatenate((w.codes[a:b], w.two[a : b - 1])) & U64(SPACE - 1)).astype(np.int64)
            index, n = np.unique(bucket, return_counts=True)
            rows[first + int(w.text[a])] = index, n / np.sqrt(len(bucket))
    return rows


def fit_licences(docs: DataFrame, bound: int = SAMPLE) -> Model:
    """The classifier; its labelled rows are the forms of the templates, and ``bound`` documents teach the unknown class.

    The temperature comes from a first fit that hasn't seen the templates held back; the weights from a fit on all rows.
    """
    ids = fitting.sample_ids(docs.select("doc_id", F.length("text").alias("n")).filter("n > 0"), bound, seed=8).select("doc_id").distinct()
    lines = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.explode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("line"))  # ``bound`` ids
    corpus = sorted(r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(PARAGRAPHS).collect())
    texts, labels, back = training_rows(corpus)
    rows = _features(texts)

    def fitted(use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        learner = fitting.Ftrl(SPACE, len(TEMPLATES) + 1, l1=0.02, l2=0.01)
        order = np.random.default_rng(8).permutation(use)
        for _ in range(EPOCHS):
            for i in order:
                learner.learn(*rows[i], labels[i])
        return learner.weights()

    w, b = fitted(np.flatnonzero(~back))
    held = np.flatnonzero(back)
    logits = np.array([rows[i][1] @ w[rows[i][0]] + b for i in held])
    temperature = max(0.2, fitting.temperature(logits, np.array(labels)[held]))
    w, b = fitted(np.arange(len(rows)))
    used = np.flatnonzero(np.any(w != 0, axis=1))
    row_of = np.zeros(SPACE, np.int32)
    row_of[used] = np.arange(1, len(used) + 1)
    weights = np.ascontiguousarray(np.rint(np.concatenate((np.zeros((1, w.shape[1])), w[used])) * UNIT).T.astype(np.int32))
    return Model([*TEMPLATES, UNKNOWN], row_of, weights, b, temperature)


def scan(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """The licence passages of every whole text.

    One row for each passage that is a hit or confirmed; where such overlap, the closest to a template counts. ``doc_id``,
    ``line`` (that of its first word, from 0), ``family``, ``score`` (probability of the family), ``unknown``
    (probability of no licence), ``template`` (likeness to the family's nearest template), ``confirmed``, ``paragraph`` (the
    passage's lines if they are short, else its words). Texts that are null, empty or without a hit give no
    row; repeated rows give theirs again; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit_licences(docs, bound))
    schema = "doc_id bigint, line bigint, family string, score double, unknown double, template double, confirmed boolean, paragraph string"

    def passages(m: Model, data: np.ndarray, w: Words) -> list[tuple]:
        """Rows (rank, first word, end word, family, score, unknown, likeness, confirmed)."""
        held: dict[tuple[int, int], dict[str, float]] = {}
        for x in statements(data, w):
            close = held.setdefault((x.first, x.end), {})
            close[x.family] = max(x.close, close.get(x.family, 0.0))
        first, end = units(w)
        more = sorted(set(held) - set(zip(first.tolist(), end.tolist())))
        first, end = (np.concatenate((u, np.array([x[k] for x in more], np.int64))) for k, u in enumerate((first, end)))
        prob = m.probabilities(w, first, end)
        rows = []
        for i in np.flatnonzero((prob.argmax(axis=1) < len(m.names) - 1) & (prob[:, -1] <= UNKNOWN_AT_MOST)).tolist():
            a, b = int(first[i]), int(end[i])
            words, own = tokens(data[w.starts[a] : w.ends[b - 1]].tobytes().decode()), held.get((a, b), {})
            said = named(words) | set(own)
            order = np.argsort(-prob[i, :-1], kind="stable")[:PROPOSED]
            proposed = [m.names[j] for k, j in enumerate(order) if k == 0 or prob[i, j] >= LEAST]
            close = {k: max(own.get(k, 0.0), *(similarity(words, t) for t in _TEMPLATE_TOKENS[k])) for k in said | {*proposed}}

            def confirmed(k: str) -> bool:
                rival = max((close[o] for o in said if o != k), default=0.0)
                return k in said and close[k] >= CONFIRMED_AT_LEAST and (k in own or close[k] > rival + MARGIN)

            family = next(filter(confirmed, proposed), proposed[0])
            score, sure = float(prob[i, m.names.index(family)]), confirmed(family)
            rows.append(((sure, close[family], b - a, score), a, b, family, score, float(prob[i, -1]), close[family], sure))
        return apart(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for first, _, data, offs in slices(batch.column(1)):
                w = words_of(data, offs)
                if not len(w.starts):
                    continue
                rows = []
                for _, a, b, family, score, unknown, close, sure in passages(m, data, w):
                    t, lines = int(w.text[a]), (w.line[a], w.line[b - 1])
                    lo, hi = w.starts[a], w.ends[b - 1]
                    if np.searchsorted(w.line, lines[1], "right") - np.searchsorted(w.line, lines[0]) <= WHOLE:
                        lo, hi = w.edges[lines[0]], w.edges[lines[1] + 1]
                    line = int(w.line[a] - np.searchsorted(w.edges, offs[t]))
                    rows.append((batch.column(0)[first + t].as_py(), line, family, score, unknown, close, sure, data[lo:hi].tobytes().decode().rstrip("\n")))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "line", "family", "score", "unknown", "template", "confirmed", "paragraph"])

    return docs.mapInArrow(run, schema)
