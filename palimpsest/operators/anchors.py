"""Where quoted evidence stands in its text: exact, around an ellipsis, fuzzy by n-grams, or in several fragments.

Each step is tried in turn; the first that finds a place decides. Offsets are code points. Defined results: NULL or
blank evidence or text, and evidence that no step finds, has no place and the strategy NONE.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Marks of an ellipsis, lengths of the beginnings that are tried, and the windows of the fuzzy step.
_ELLIPSES = ("……", "...", "…", "..")
_BEGINNINGS = (20, 16, 12, 10, 8)
_STEP, _WIDTH, _LEAST = 30, 200, 0.65


def _all(text: str, part: str) -> list[int]:
    out, i = [], text.find(part) if part else -1
    while i >= 0:
        out.append(i)
        i = text.find(part, i + 1)
    return out


def _grams(text: str, n: int = 3) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)} or {text}


@lru_cache(maxsize=8)
def _places(text: str, n: int = 3) -> dict[str, list[int]]:
    """Places of each n-gram; facts of one chunk follow each other, so that a text is indexed once."""
    found: dict[str, list[int]] = {}
    for i in range(len(text) - n + 1):
        found.setdefault(text[i : i + n], []).append(i)
    return found


def _best_window(quote: str, text: str) -> tuple[float, int]:
    """The largest part of the quote's 3-grams that a window holds, and the first window that does."""
    own, windows = _grams(quote), range(0, max(1, len(text)), _STEP)
    if len(quote) < 3:
        scores = [len(own & _grams(text[i : i + _WIDTH])) for i in windows]
    else:
        scores, places = [0] * len(windows), _places(text)
        for gram in own:
            last = -1
            for p in places.get(gram, ()):
                first = max(0, -(-(p - _WIDTH + 3) // _STEP), last + 1)
                last = max(last, p // _STEP)
                for w in range(first, last + 1):
                    scores[w] += 1
    best = max(scores)
    return best / len(own), scores.index(best) * _STEP if best else -1


def anchor(evidence: str | None, text: str | None, center: int | None = None) -> tuple[int, int, str]:
    """(start, end, strategy) of the evidence in the text; (-1, -1, NONE) if it isn't found."""
    quote = (evidence or "").strip()
    if not quote or not text:
        return -1, -1, "NONE"
    middle = len(text) // 2 if center is None else center
    tight = re.sub(r"\s+", "", quote)
    for part in dict.fromkeys([quote, *(tight[:n] for n in _BEGINNINGS if len(tight) >= n)]):
        hits = _all(text, part)
        if hits:
            at = min(hits, key=lambda h: (abs(h + len(part) // 2 - middle), h))
            return at, at + len(part), "EXACT"
    for mark in _ELLIPSES:
        if mark in quote:
            parts = [p.strip() for p in quote.split(mark)]
            left, right = parts[0][-24:], parts[-1][:24]
            lefts, rights = _all(text, left), _all(text, right)
            pairs = [(r - (h + len(left)), h, r) for h in lefts for r in rights if 0 <= r - (h + len(left)) <= 1200]
            if pairs:
                _, h, r = min(pairs)
                return h, r + len(right), "ELLIPSIS_BOTH"
            if len(lefts) == 1:
                return lefts[0], lefts[0] + len(left), "ELLIPSIS_LEFT_ONLY"
            if len(rights) == 1:
                return rights[0], rights[0] + len(right), "ELLIPSIS_RIGHT_ONLY"
            break
    best, at = _best_window(quote, text)
    if best >= _LEAST:
        return at, min(len(text), at + _WIDTH), "FUZZY_ALIGN"
    fragments = [f for f in re.split(r"[，,、；;。！？!?…]+", quote) if len(f) >= 8]
    hits = sorted((h, h + len(f)) for f in fragments for h in _all(text, f))
    clusters: list[list[tuple[int, int]]] = []
    for h in hits:
        if clusters and h[0] - clusters[-1][-1][1] <= 800:
            clusters[-1].append(h)
        else:
            clusters.append([h])
    scored = [(sum(b - a for a, b in c), -c[0][0], c) for c in clusters]
    if scored and max(scored)[0] >= 15:
        c = max(scored)[2]
        return c[0][0], c[-1][1], "MULTI_FRAGMENT"
    return -1, -1, "NONE"


def anchor_evidence(facts: DataFrame, key: str, evidence: str, texts: DataFrame, on: list[str], text: str) -> DataFrame:
    """(key, start, end, strategy) of each fact's evidence in the text of its chunk."""
    joined = facts.select(key, *on, evidence).join(texts.select(*on, text), on).select(key, evidence, text)
    kind = dict(facts.dtypes)[key]

    def find(batches):
        for batch in batches:
            rows = [anchor(e, t) for e, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            found = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], [key, "start", "end", "strategy"])

    return joined.mapInArrow(find, f"`{key}` {kind}, start int, end int, strategy string")
