"""Word tokens, shingle hashes and winnowed fingerprints of whole batches of texts, by array operations.

A token is a run of letters and digits, or one character of a script written without spaces (Han, kana). Case,
punctuation, spaces and line breaks make no difference. All functions work on the concatenated code points of a batch,
so that no Python loop runs per character or token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 0 no part of a token, 1 letter or digit of a word, 2 a token of its own."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x2E80):
        kinds[c] = chr(c).isalnum()
    for a, b in ((0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x323AF)):
        for c in range(a, b + 1) if b < 0x10000 else ():
            kinds[c] = 2 * chr(c).isalnum()
        if b >= 0x10000:
            kinds[a : b + 1] = 2
    kinds[0x3001:0x3004] = 0
    for c in range(0xA4D0, 0xAC00):
        kinds[c] = chr(c).isalnum()
    return kinds


@lru_cache(1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(256, _MIX | np.uint64(1), np.uint64))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads close values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX2
        x = (x ^ (x >> np.uint64(27))) * _MIX
        return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """Tokens of a batch: hash, document number, first character and end in the document, and the documents' starts."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    docs: int

    def bounds(self) -> np.ndarray:
        """Token number at which each document begins, and the number of tokens at the end."""
        return np.searchsorted(self.doc, np.arange(self.docs + 1))


def tokenize(texts: list[str | None]) -> Tokens:
    """Tokens of all texts; NULL and empty texts have none."""
    # Lower case must not move offsets: the few texts where it would are left as they are.
    folded = [low if len(low := (t or "").lower()) == len(t or "") else t for t in texts]
    folded = [t.replace("\x00", " ") for t in folded]
    lengths = np.fromiter((len(t) for t in folded), np.int64, len(folded))
    points = np.frombuffer("\x00".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), np.uint32) if folded else np.zeros(0, np.uint32)
    kind = _kinds()[points]
    before = np.concatenate(([0], kind[:-1])) if len(kind) else kind
    first = np.flatnonzero((kind == 2) | ((kind == 1) & (before != 1)))
    if not len(first):
        empty = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, np.uint64), empty, empty, empty, len(folded))
    inside = kind > 0
    number = np.zeros(len(points), np.int64)
    number[first] = 1
    number = np.cumsum(number)[inside] - 1
    at = np.flatnonzero(inside)
    offset = at - first[number]
    with np.errstate(over="ignore"):
        values = scramble(points[at].astype(np.uint64) + np.uint64(1)) * _powers()[np.minimum(offset, 255)]
        sums = np.add.reduceat(values, np.searchsorted(number, np.arange(len(first))))
    size = np.bincount(number, minlength=len(first))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    doc = np.searchsorted(begins, first, side="right") - 1
    start = first - begins[doc]
    return Tokens(scramble(sums), doc, start, start + size, len(folded))


def shingles(tokens: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` tokens inside a document, and the number of its first token."""
    h, doc = tokens.hash, tokens.doc
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _MIX + h[i : i + n]
    whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return scramble(out[whole]), whole


def winnow(hashes: np.ndarray, owner: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest hash in each window of ``w`` consecutive hashes of one owner.

    A document with fewer than ``w`` hashes keeps its smallest. Any ``w`` consecutive hashes that two documents share
    therefore have a kept one in common.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    bounds = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    sizes = np.diff(np.append(bounds, n))
    least = hashes.copy()
    reach = 1
    # Doubling: least[i] covers the next `reach` hashes; windows over a document's end are left out below.
    pad = np.uint64(0xFFFFFFFFFFFFFFFF)
    while reach < w:
        step = min(reach, w - reach)
        least = np.minimum(least, np.append(least[step:], np.full(min(step, n), pad))[:n])
        reach += step
    left = np.repeat(bounds + sizes, sizes) - np.arange(n)
    full = left >= w
    # The kept places are those that are the smallest of some full window around them.
    keep = np.zeros(n, bool)
    for i in range(w):
        window = np.flatnonzero(full[: n - i] if i else full)
        keep[window + i] |= hashes[window + i] == least[window]
    short = sizes < w
    if short.any():
        smallest = np.minimum.reduceat(hashes, bounds)
        rows = np.repeat(short, sizes)
        keep |= rows & (hashes == np.repeat(smallest, sizes))
    return np.flatnonzero(keep)


def fingerprints(tokens: Tokens, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed shingle hashes as signed numbers, and the number of each one's first token.

    A document with fewer than ``k`` tokens but at least one has a single fingerprint over all its tokens.
    """
    hashes, first = shingles(tokens, k)
    kept = winnow(hashes, tokens.doc[first], w)
    hashes, first = hashes[kept], first[kept]
    bounds = tokens.bounds()
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        with np.errstate(over="ignore"):
            extra = np.array([np.bitwise_xor.reduce(tokens.hash[bounds[d] : bounds[d + 1]] * np.arange(1, counts[d] + 1, dtype=np.uint64)) for d in short], np.uint64)
        hashes, first = np.append(hashes, scramble(extra)), np.append(first, bounds[short])
        order = np.argsort(first, kind="stable")
        hashes, first = hashes[order], first[order]
    return hashes.view(np.int64), first


def slices(texts: list[str | None], most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` texts with at most ``most`` characters, or of one longer text."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if (total + n > most or i - start >= rows) and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
