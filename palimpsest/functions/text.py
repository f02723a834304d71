"""Scalar text functions as JVM-side columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(words: Iterable[str]) -> str:
    """One alternation that matches any of the literal words, longest first."""
    return "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize_spaces(text: Column, quotes: str = "\"'“”‘’「」") -> Column:
    """Outer quotes and spaces off, inner runs of white space to one space."""
    bare = F.regexp_replace(text, f"^[\\s{quotes}]+|[\\s{quotes}]+$", "")
    return F.regexp_replace(bare, r"\s+", " ")


def strip(text: Column) -> Column:
    """Spaces, tabs and wide spaces off both ends."""
    return F.btrim(text, F.lit(" \t\u3000"))


def without_quotes(text: Column, quotes: str = "\"'“”‘’「」") -> Column:
    return F.translate(text, quotes, "")


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal word."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def total_occurrences(text: Column, words: Iterable[str]) -> Column:
    """Sum over the words, each counted on its own, so that overlapping words all count."""
    return reduce(add, (occurrences(text, w) for w in words), F.lit(0))


def terms_present(text: Column, words: Iterable[str]) -> Column:
    """The words that occur, in the order given."""
    return F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def count_present(text: Column, words: Iterable[str]) -> Column:
    return reduce(add, (F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def unnegated_occurrences(text: Column, word: str, negations: Iterable[str], reach: int = 8) -> Column:
    """Occurrences of a word without a negation in the ``reach`` characters before it, on the same line."""
    return F.regexp_count(text, F.lit(f"(?<!(?:{any_of(negations)}).{{0,{reach}}}){re.escape(word)}"))


def text_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the text without outer white space."""
    return F.substring(F.sha1(F.regexp_replace(text, r"^\s+|\s+$", "")), 1, 16)


def normalize_person(name: Column) -> Column:
    """Person name as typed by people: wide separators narrowed, spaces collapsed, NULL to the empty text."""
    narrow = F.translate(F.coalesce(name, F.lit("")), "，；：　\"'“”‘’", ",;: ")
    return F.trim(F.regexp_replace(narrow, r"\s+", " "))


def core_name(name: Column) -> Column:
    """Name without quotes, white space and anything in parentheses, at most 80 characters."""
    bare = F.regexp_replace(F.regexp_replace(name, r"[\s\"'“”‘’]+", ""), r"[（(][^）)]*[）)]", "")
    return F.substring(bare, 1, 80)


def capped_levenshtein(a: Column, b: Column, most: int = 2) -> Column:
    """Edit distance, ``most + 1`` beyond the cap, but the other side's whole length where one side is empty."""
    near = F.levenshtein(a, b, most)
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).when(near < 0, most + 1).otherwise(near)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def ngrams(text: Column, n: int) -> Column:
    """All character n-grams in order; none for a shorter text."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, n))


def ngram_set(text: Column, n: int = 3) -> Column:
    """Distinct n-grams; a text shorter than ``n`` is its own only member."""
    return F.when(F.length(text) >= n, F.array_distinct(ngrams(text, n))).otherwise(F.array(text))


def bounded_score(value: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.round(F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(value.try_cast("double"), F.lit(low)))), 1)


def keep_last(values: Column, n: int) -> Column:
    """The last ``n`` distinct elements, each at the place of its first occurrence."""
    distinct = F.array_distinct(values)
    return F.slice(distinct, F.greatest(F.lit(1), F.size(distinct) - n + 1), n)


def clip(text: Column, n: int, suffix: str = "…") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - len(suffix)), F.lit(suffix))).otherwise(text)


def ellipsis_ends(text: Column) -> Column:
    """(head, tail) around the first kind of ellipsis that occurs: ……, ..., …, then .. ."""
    cases = F
    for mark in ("……", "...", "…", ".."):
        parts = F.split(text, re.escape(mark))
        both = F.struct(F.trim(F.get(parts, F.lit(0))).alias("head"), F.trim(F.element_at(parts, -1)).alias("tail"))
        cases = cases.when(F.contains(text, F.lit(mark)), both)
    return cases


def sample_budget(n_chunks: Column, base: int) -> Column:
    """How many of a document's chunks are read: a ladder over the document's size, unlimited for a base of 0."""
    if base <= 0:
        return n_chunks
    step = F.when(n_chunks <= 200, 80).when(n_chunks <= 500, 120).when(n_chunks <= 1000, 160).when(n_chunks <= 2000, 300).otherwise(400)
    return F.least(n_chunks, F.greatest(F.lit(base), step))


def token_estimate(text: Column, output: int = 0) -> Column:
    return (F.floor(F.length(text) / 3) + output).cast("int")


def saturation_score(n: Column, density: Column, mean: Column) -> Column:
    """0.55 (1 - e^(-n/20)) + 0.35 tanh(0.8 density) + 0.10 mean/10."""
    return 0.55 * (1 - F.exp(-n / 20)) + 0.35 * F.tanh(0.8 * density) + 0.10 * mean / 10
