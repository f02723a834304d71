"""Held-out passages inside corpus documents, found by winnowing and extended to stretches.

Both sides are reduced to winnowed shingle fingerprints: of words in scripts with spaces, of characters in others. Any
shared run of ``k + w - 1`` tokens has a fingerprint in common. The passages are indexed in blocks of fixed size, each
broadcast. The corpus is read once: a batch's fingerprints are computed once and joined with one block after another,
so that no fingerprint of the corpus is shuffled and one block is in a task's memory at a time. A document
and a passage are a candidate if ``HITS`` of the passage's fingerprints are hit in two bands of diagonals, each wide
enough for all that a stretch may drift: two fifths of a passage have that many unless one letter in about twelve is
changed. Candidates are extended over the whole texts to stretches that may hold a few changed letters, unless the
equal runs of letters that stretches are made of can't cover enough of the passage (``_Index.covered``).

Defined results: NULL, blank and symbol-only texts hold nothing and a passage without letters is never found; a
document is reported once per passage; repeated rows don't add rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import Tokens, _kinds, fingerprints, slices, tokenize

#: (k, w) for scripts written without spaces and for words.
CHARACTERS, WORDS = (10, 5), (5, 3)
#: Characters of the passages of one block.
BLOCK = 1_000_000
#: Least part of a stretch that equal runs of letters cover, and letters of such a run in scripts without spaces and in others.
IDENTITY, SEED_CHARACTERS, SEED_WORDS = 0.6, 6, 12
#: Least part of a passage's fingerprints that candidates hit, and tokens that a stretch may drift.
HITS, DRIFT = 0.06, 64
#: Most characters whose arrays are held at once, but for single longer texts.
BATCH_CHARS = 400_000


def passage_prints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tokens]:
    """Fingerprints by the script of their first token, their documents and their places in the document's tokens."""
    tokens = tokenize(texts)
    bounds = tokens.bounds()
    parts = []
    dense = (tokens.end - tokens.start) == 1
    for (k, w), own in ((CHARACTERS, True), (WORDS, False)):
        fps, first = fingerprints(tokens, k, w)
        # A single letter is a word where it stands among words.
        ahead = np.minimum(first + 1, len(dense) - 1)
        kept = (dense[first] & dense[ahead]) == own
        parts.append((fps[kept], first[kept]))
    fps, first = (np.concatenate([p[i] for p in parts]) for i in range(2))
    doc = tokens.doc[first]
    return fps, doc, first - bounds[doc], tokens


def _fold(text: str) -> np.ndarray:
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return points[_kinds()[points] > 0]


def _runs(x: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` letters."""
    n = len(x) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size if n > 0 else 0):
            h = h * np.uint64(0x100000001B3) + x[i : i + n].astype(np.uint64)
    return h


def _seed_size(passage: np.ndarray) -> int:
    return SEED_CHARACTERS if len(passage) and (_kinds()[passage] == 2).mean() > 0.5 else SEED_WORDS


class _Text:
    """A text's letters and digits, and the hashes of its runs, each made once."""

    def __init__(self, text: str):
        self.letters, self._hashes, self._sorted = _fold(text), {}, {}

    def hashes(self, size: int) -> np.ndarray:
        if size not in self._hashes:
            self._hashes[size] = _runs(self.letters, size)
        return self._hashes[size]

    def ordered(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes in order, and the places that they have in the text."""
        if size not in self._sorted:
            order = np.argsort(self.hashes(size), kind="stable")
            self._sorted[size] = self.hashes(size)[order], order
        return self._sorted[size]


def _seeds(passage: _Text, text: _Text, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All equal runs of ``size`` characters: places in the passage and in the text."""
    runs, (there, order) = passage.hashes(size), text.ordered(size)
    low, high = np.searchsorted(there, runs, "left"), np.searchsorted(there, runs, "right")
    counts = high - low
    at = np.repeat(np.arange(len(runs)), counts)
    within = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return at, order[np.repeat(low, counts) + within]


def stretches(passage: str | _Text, text: str | _Text, shortest: float = 0, needed: float = 0, gap: int = 30, drift: int = 6, identity: float = IDENTITY) -> list[tuple[int, int, int]]:
    """Shared stretches as (start in the passage, end, place in the text), over letters and digits only.

    Runs of letters that can't be part of a stretch as long as ``shortest`` may be left out, and all of them if no two
    stretches can have ``needed`` letters.
    """
    p, t = (x if isinstance(x, _Text) else _Text(x) for x in (passage, text))
    size = _seed_size(p.letters)
    at_p, at_t = _seeds(p, t, size)
    if not len(at_p):
        return []
    order = np.lexsort((at_p, (at_t - at_p)))
    at_p, at_t = at_p[order], at_t[order]
    # Runs on one diagonal first, then runs whose diagonals and places are close are chained.
    new = np.ones(len(at_p), bool)
    new[1:] = (np.diff(at_t - at_p) != 0) | (np.diff(at_p) > 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at_p)) - 1
    begin, end, diagonal = at_p[starts], at_p[ends] + size, (at_t - at_p)[starts]
    # A stretch lies in one of the bands of diagonals that are twice as wide as it drifts.
    band = diagonal // DRIFT - int(diagonal.min()) // DRIFT + 1
    letters = np.bincount(band, weights=end - begin, minlength=int(band.max()) + 2)
    if np.sort(letters[:-1] + letters[1:])[-2:].sum() < identity * needed:
        return []
    kept = np.maximum(letters[band] + letters[band + 1], letters[band] + letters[band - 1]) >= identity * shortest
    runs = sorted(zip(begin[kept].tolist(), end[kept].tolist(), diagonal[kept].tolist(), strict=True))
    chains: list[list[int]] = []  # start, end, first diagonal, last diagonal, matched
    # Open chains by their last diagonal; a chain is open until a run starts more than ``gap`` behind its end.
    diagonals: list[int] = []
    by_diagonal: dict[int, list[int]] = {}
    ends_first: list[tuple[int, int, int]] = []  # heap of (end, diagonal, number of the chain)

    def put(number: int) -> None:
        c = chains[number]
        if c[3] not in by_diagonal:
            insort(diagonals, c[3])
            by_diagonal[c[3]] = []
        by_diagonal[c[3]].append(number)
        heappush(ends_first, (c[1], c[3], number))

    def take(diagonal: int, number: int) -> None:
        by_diagonal[diagonal].remove(number)
        if not by_diagonal[diagonal]:
            del by_diagonal[diagonal]
            del diagonals[bisect_left(diagonals, diagonal)]

    for s, e, d in runs:
        while ends_first and s - ends_first[0][0] > gap:
            end, diagonal, number = heappop(ends_first)
            if chains[number][1] == end and chains[number][3] == diagonal:  # else it was extended since
                take(diagonal, number)
        best = None
        for diagonal in diagonals[bisect_left(diagonals, d - drift) : bisect_right(diagonals, d + drift)]:
            for number in by_diagonal[diagonal]:
                c = chains[number]
                if e > c[1] and (best is None or (-c[4], number) < (-chains[best][4], best)):
                    best = number
        if best is not None:
            c = chains[best]
            take(c[3], best)
            c[4] += e - max(s, c[1])
            c[1], c[3] = e, d
            put(best)
        else:
            chains.append([s, e, d, d, e - s])
            put(len(chains) - 1)
    return [(c[0], c[1], c[0] + c[2]) for c in chains if c[4] >= identity * (c[1] - c[0])]


def held(passage: str | _Text, text: str | _Text, least: float = 0.12, share: float = 0) -> float:
    """The largest fraction of the passage that the text holds in its own order in one or two stretches.

    A stretch shorter than ``least`` of the passage is a turn of phrase. A fraction below ``share`` may come out as 0.
    """
    passage = passage if isinstance(passage, _Text) else _Text(passage)
    total = len(passage.letters)
    shortest = max(20, least * total)
    found = [s for s in stretches(passage, text, shortest, share * total) if s[1] - s[0] >= shortest]
    if not total or not found:
        return 0.0
    best = max(b - a for a, b, _ in found)
    for a, b, at in found:
        for c, d, to in found:
            if at < to and c > a and d > b:
                best = max(best, d - a - max(0, c - b))
    return best / total


def find_leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, share: float = 0.4, block: int = BLOCK) -> DataFrame:
    """(doc_key, item_key, share) of documents that hold at least ``share`` of a passage in one or two stretches.

    ``block`` is the number of characters of the passages that are indexed together.
    """
    kind = docs.schema[doc_key].dataType.simpleString()
    spark = docs.sparkSession
    columns = [(doc_key, kind), (item_key, "bigint"), ("share", "double")]
    schema = ", ".join(f"`{c}` {t}" for c, t in columns)
    blocks = [spark.sparkContext.broadcast(_Index(rows)) for rows in _blocks(items.select(item_key, passage).filter(F.col(passage).isNotNull()).distinct(), block)]
    if not blocks:
        return spark.createDataFrame([], schema)
    found = docs.select(doc_key, text).filter(F.col(text).isNotNull()).mapInArrow(_search(blocks, share, [c for c, _ in columns]), schema)
    return found.groupBy(doc_key, item_key).agg(F.max("share").alias("share"))


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple]]:
    """Passages in blocks of about ``block`` characters; one block is on the driver at a time."""
    rows, size = [], 0
    for row in items.toLocalIterator():
        rows.append(tuple(row))
        size += len(row[1])
        if size >= block:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


class _Index:
    """Fingerprints of a block of passages, sorted, and the runs of letters that their stretches are made of."""

    def __init__(self, rows: list[tuple]):
        self.keys, self.passages = [r[0] for r in rows], [_Text(r[1]) for r in rows]
        fps, item, place, _ = passage_prints([r[1] for r in rows])
        order = np.argsort(fps, kind="stable")
        self.fps, self.item, self.place = fps[order], item[order].astype(np.int32), place[order].astype(np.int32)
        self.least = np.maximum(1, np.ceil(HITS * np.bincount(item, minlength=len(rows)))).astype(np.int64)
        self.letters = np.array([len(x.letters) for x in self.passages])
        self.size = np.array([_seed_size(x.letters) for x in self.passages])
        runs = [x.hashes(size) for x, size in zip(self.passages, self.size.tolist(), strict=True)]
        self.start = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
        self.runs = np.concatenate(runs)

    def meeting(self, fps: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Each text and the passages of which it hits enough fingerprints in two bands of diagonals."""
        low, high = np.searchsorted(self.fps, fps, "left"), np.searchsorted(self.fps, fps, "right")
        counts = high - low
        src = np.repeat(np.arange(len(fps)), counts)
        dst = np.repeat(low, counts) + np.arange(len(src)) - np.repeat(np.cumsum(counts) - counts, counts)
        item = self.item[dst]
        pair = doc[src].astype(np.int64) * len(self.keys) + item
        # Few hits in all can't be enough: most pairs end here.
        names, inverse, total = np.unique(pair, return_inverse=True, return_counts=True)
        least = self.least[names % len(self.keys)] if len(names) else total
        some = (total >= least)[inverse] if len(names) else np.zeros(0, bool)
        pair, at = inverse[some], self.place[dst][some]
        band = (place[src][some] - at) // DRIFT + (1 << 20)
        # A stretch is whole in one of the bands that are twice as wide as it drifts; a place counts once in each.
        cells = np.concatenate([(pair << 42) | (b << 21) | at for b in (band, band - 1)])
        cells = np.unique(cells) >> 21
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, int)
        hits, owner = np.diff(np.append(starts, len(cells))), cells[starts] >> 21
        order = np.lexsort((-hits, owner))
        hits, owner = hits[order], owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = np.bincount(owner[rank < 2], weights=hits[rank < 2], minlength=len(names))
        pairs = names[best >= least] if len(names) else names
        if not len(pairs):
            return []
        texts, items = pairs // len(self.keys), pairs % len(self.keys)
        starts = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1])))
        return [(int(texts[a]), items[a:b]) for a, b in zip(starts, np.append(starts[1:], len(pairs)), strict=True)]

    def covered(self, items: np.ndarray, text: _Text) -> np.ndarray:
        """The letters of each passage that equal runs of letters in the text cover, wherever they are."""
        out = np.zeros(len(items))
        for size in (SEED_CHARACTERS, SEED_WORDS):
            own = np.flatnonzero(self.size[items] == size)
            lengths = self.start[items[own] + 1] - self.start[items[own]]
            if not lengths.sum():
                continue
            there, _ = text.ordered(size)
            at = np.arange(lengths.sum()) + np.repeat(self.start[items[own]] - (np.cumsum(lengths) - lengths), lengths)
            runs = self.runs[at]
            place = np.searchsorted(there, runs)
            hit = np.flatnonzero(there[np.minimum(place, len(there) - 1)] == runs) if len(there) else np.zeros(0, int)
            owner = np.repeat(own, lengths)[hit]
            ahead = np.minimum(np.append(np.diff(hit), size), size)
            ahead[np.flatnonzero(np.diff(owner))] = size
            out += np.bincount(owner, weights=ahead, minlength=len(items))
        return out


def _search(blocks: list, share: float, names: list[str]):
    def search(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at, item, held_share = [], [], []
            for a, b in slices(texts, BATCH_CHARS):
                fps, doc, place, _ = passage_prints(texts[a:b])
                for shared in blocks:
                    index = shared.value
                    for d, items in index.meeting(fps, doc, place):
                        text = _Text(texts[a + d])
                        for i in items[index.covered(items, text) >= IDENTITY * share * index.letters[items]]:
                            part = held(index.passages[i], text, share=share)
                            if part >= share:
                                at.append(a + d)
                                item.append(index.keys[i])
                                held_share.append(part)
                    if len(blocks) > 1:
                        shared.__dict__.pop("_value", None)  # read again from the executor's disk when it is needed
            found = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(item, pa.int64()), pa.array(held_share, pa.float64())]
            yield pa.RecordBatch.from_arrays(found, names)

    return search
