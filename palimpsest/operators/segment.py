"""Documents to spans: lines, sentences, chapters and overlapping chunks, with exact code-point offsets.

The simple generators are JVM-side expressions. Greedy packing is sequential within a document and runs as one Arrow
function per batch of documents. Defined results for all: NULL and empty texts have no spans; line breaks are ``\\n``
after ``normalize_newlines``; spans are half-open and count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.packs import NOVEL, LanguagePack
from palimpsest.functions.text import normalize_newlines


def line_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, para_no, start, end): the non-blank lines, numbered by line. One pass over each text, no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def expand(batches):
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                start = 0
                for n, line in enumerate((value or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1):
                    if line.strip(" \t\x0b\x0c"):
                        at.append(i)
                        rows.append((n, start, start + len(line)))
                    start += len(line) + 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            taken = batch.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([taken, *(pa.array(list(c), pa.int32()) for c in columns)], [key, "para_no", "start", "end"])

    return df.select(key, text).mapInArrow(expand, f"`{key}` {kind}, para_no int, start int, end int")


def sentences(text: Column, pack: LanguagePack = NOVEL) -> Column:
    """Array of sentences: cut after each terminator and at line breaks, blank ones dropped, untrimmed."""
    marks = pack.terminators
    return F.filter(F.regexp_extract_all(normalize_newlines(text), F.lit(f"[^{marks}\n]*[{marks}]+|[^{marks}\n]+"), F.lit(0)), lambda s: s.rlike(r"\S"))


def chapter_starts(text: str, heading: re.Pattern) -> list[tuple[int, str]]:
    """(offset, title) of the lines that begin with a heading."""
    found = []
    for m in re.finditer(r"[^\n]+", text):
        line = m.group().strip(" \t　")
        if heading.match(line):
            found.append((m.start(), line))
    return found


def _lines(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [(m.start() + start, m.end() + start) for m in re.finditer(r"[^\n]+", text[start:end]) if m.group().strip()]


def pack_lines(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Greedy runs of whole lines, as (first, last + 1): a line that would exceed the size starts the next run."""
    runs, i = [], 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and spans[j - 1][1] - spans[i][0] < size and spans[j][1] - spans[i][0] <= size:
            j += 1
        runs.append((i, j))
        i = j
    return runs


def fixed_chunks_of(text: str, size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(core_start, core_end, window_start, window_end); windows grow by whole lines to at least the overlap."""
    return _fixed(_lines(text, 0, len(text)), size, overlap)


def _fixed(spans: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    out = []
    for i, j in pack_lines(spans, size):
        core_start, core_end = spans[i][0], spans[j - 1][1]
        a, b = i, j
        while overlap and a > 0 and core_start - spans[a][0] < overlap:
            a -= 1
        while overlap and b < len(spans) and spans[b - 1][1] - core_end < overlap:
            b += 1
        out.append((core_start, core_end, spans[a][0], spans[b - 1][1]))
    return out


def semantic_chunks_of(text: str, size: int, overlap: int, heading: re.Pattern) -> list[tuple[int, int, int, int]]:
    """As fixed chunks, but never across a chapter; windows stay inside it and below the overlap.

    A text with fewer than three chapters falls back to fixed chunks.
    """
    chapters = [s for s, _ in chapter_starts(text, heading)]
    if len(chapters) < 3:
        return fixed_chunks_of(text, size, overlap)
    bounds = [*([0] if text[: chapters[0]].strip() else []), *chapters, len(text)]
    out = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        out += _within(_lines(text, lo, hi), hi - lo, size, overlap)
    return out


def _within(spans: list[tuple[int, int]], length: int, size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Chunks of one chapter of this length, from its lines."""
    out, starts = [], [s for s, _ in spans]
    if not spans:
        return out
    for i, j in pack_lines(spans, size) if length > size else [(0, len(spans))]:
        core_start, core_end = spans[i][0], spans[j - 1][1]
        a = max(bisect_left(starts, core_start - overlap + 1), 0)
        b = j
        while b < len(spans) and spans[b][1] - core_end < overlap:
            b += 1
        out.append((core_start, core_end, spans[min(a, i)][0], spans[b - 1][1]))
    return out


def length_chunks_of(text: str, size: int, look: int = 500) -> list[tuple[int, int]]:
    """Pieces of about ``size``, each extended to the next sentence mark within ``look`` characters."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            m = re.search("[。！？]", text[end : end + look])
            end = end + m.end() if m else end
        out.append((start, end))
        start = end
    return out


def halves_of(text: str) -> list[tuple[int, int]]:
    """Two parts, cut before the line break or full stop nearest to the middle; of equal ones a line break, then the first."""
    middle = len(text) // 2
    marks = ((abs(m.start() - middle), m.group() != "\n", m.start()) for m in re.finditer("[\n。]", text))
    cut = min((m for m in marks if 0 < m[2] < len(text) - 1), default=(0, False, middle))[2]
    return [(0, cut), (cut, len(text))] if 0 < cut < len(text) else [(0, len(text))]


def stripped_span(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without the white space at its ends; an empty one if there is nothing else."""
    part = text[start:end]
    start += len(part) - len(part.lstrip())
    return start, start + len(part.strip())


def chunk_table(df: DataFrame, key: str, text: str, mode: str = "fixed", size: int = 6000, overlap: int = 500, pack: LanguagePack = NOVEL) -> DataFrame:
    """(key, chunk_index from 1, core_start, core_end, window_start, window_end) of each document.

    The cores of halves are stripped of white space.
    """
    heading = re.compile(pack.heading)
    kind = df.schema[key].dataType.simpleString()

    def cut(value: str) -> list[tuple[int, int, int, int]]:
        value = value.replace("\r\n", "\n").replace("\r", "\n")
        if mode == "fixed":
            return fixed_chunks_of(value, size, overlap)
        if mode == "semantic":
            return semantic_chunks_of(value, size, overlap, heading)
        if mode == "halves":
            return [(*stripped_span(value, a, b), a, b) for a, b in halves_of(value)]
        return [(a, b, a, b) for a, b in length_chunks_of(value, size)]

    if mode not in ("fixed", "semantic", "length", "halves"):
        raise ValueError(f"no such mode: {mode}")

    def expand(batches):
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                new = [(n, *c) for n, c in enumerate(cut(value), 1)] if value else []
                at += [i] * len(new)
                rows += new
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            names = [key, "chunk_index", "core_start", "core_end", "window_start", "window_end"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(list(c), pa.int32()) for c in columns)], names)

    return df.select(key, text).mapInArrow(expand, f"`{key}` {kind}, chunk_index int, core_start int, core_end int, window_start int, window_end int")


def book_chunk_table(df: DataFrame, book: str, order: str, text: str, size: int = 6000, overlap: int = 500, pack: LanguagePack = NOVEL) -> DataFrame:
    """(book, chunk_index from 1, core_start, core_end, window_start, window_end): semantic chunks of whole books.

    A book is its texts in order, joined by line breaks, with line breaks normalised in each. Texts are read where they
    are: only the places of lines and headings move, and a task packs the lines of one chapter (of the whole book where
    it has fewer than three).
    """
    heading = re.compile(pack.heading)

    def measure(batches):
        for batch in batches:
            n, heads, starts, ends = [], [], [], []
            for value in batch.column(2).to_pylist():
                value = value.replace("\r\n", "\n").replace("\r", "\n")
                spans = _lines(value, 0, len(value))
                n.append(len(value))
                heads.append([s for s, _ in chapter_starts(value, heading)])
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (heads, starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *lists], ["book", "no", "n", "heads", "starts", "ends"])

    texts = df.filter(F.col(text).isNotNull() & F.col(book).isNotNull()).select(F.col(book).cast("bigint").alias("book"), F.col(order).cast("bigint").alias("no"), F.col(text).alias("text"))
    parts = texts.mapInArrow(measure, "book bigint, no bigint, n bigint, heads array<bigint>, starts array<bigint>, ends array<bigint>")
    ahead = Window.partitionBy("book").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    marks = parts.select("book", "no", "n", "heads").withColumn("offset", F.coalesce(F.sum(F.col("n") + 1).over(ahead), F.lit(0)))
    marks = marks.withColumn("heads", F.transform("heads", lambda h: h + F.col("offset")))
    marks = marks.withColumn("open", F.coalesce(F.max(F.array_max("heads")).over(ahead), F.lit(-1)))
    books = marks.groupBy("book").agg(F.max(F.col("offset") + F.col("n")).alias("length"), F.sum(F.size("heads")).alias("chapters"))
    where = marks.select("book", "no", "offset", "open", "heads").join(books.select("book", (F.col("chapters") >= 3).alias("cut")), "book")
    # A chapter is named by its first character, text before the first chapter and uncut books by -1.
    begun = marks.select("book", F.explode("heads").alias("chapter")).unionByName(books.select("book", F.lit(-1).cast("bigint").alias("chapter"))).join(books, "book")
    begun = begun.filter("chapter = -1 or chapters >= 3")
    end = F.when(F.col("chapters") < 3, F.col("length")).otherwise(F.coalesce(F.lead("chapter").over(Window.partitionBy("book").orderBy("chapter")), "length"))
    begun = begun.select("book", "chapter", (end - F.greatest("chapter", F.lit(0))).alias("length"), (F.col("chapters") >= 3).alias("cut"))

    def assign(batches):
        for batch in batches:
            book_of, rows = [], []
            for i, (offset, before, heads, cut, starts, ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 7)), strict=True)):
                groups: dict[int, tuple[list[int], list[int]]] = {}
                for s, e in zip(starts, ends, strict=True):
                    at = bisect_right(heads, s + offset)
                    chapter = (heads[at - 1] if at else before) if cut else -1
                    a, b = groups.setdefault(chapter, ([], []))
                    a.append(s + offset)
                    b.append(e + offset)
                book_of += [i] * len(groups)
                rows += [(c, *g) for c, g in groups.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            lists = [pa.array(list(c), pa.list_(pa.int64())) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(book_of, pa.int32())), pa.array(list(columns[0]), pa.int64()), *lists], ["book", "chapter", "starts", "ends"])

    placed = parts.select("book", "no", "starts", "ends").join(where, ["book", "no"]).select("book", "offset", "open", "heads", "cut", "starts", "ends")
    lines = placed.mapInArrow(assign, "book bigint, chapter bigint, starts array<bigint>, ends array<bigint>").join(begun, ["book", "chapter"])

    def cut_chapter(rows: pa.Table) -> pa.Table:
        spans = sorted((s, e) for a, b in zip(rows["starts"].to_pylist(), rows["ends"].to_pylist(), strict=True) for s, e in zip(a, b, strict=True))
        found = _within(spans, rows["length"][0].as_py(), size, overlap) if rows["cut"][0].as_py() else _fixed(spans, size, overlap)
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        book_ids = pa.array([rows["book"][0].as_py()] * len(found), pa.int64())
        return pa.table([book_ids, *(pa.array(list(c), pa.int64()) for c in columns)], ["book", "core_start", "core_end", "window_start", "window_end"])

    chunks = lines.groupBy("book", "chapter").applyInArrow(cut_chapter, "book bigint, core_start bigint, core_end bigint, window_start bigint, window_end bigint")
    number = F.row_number().over(Window.partitionBy("book").orderBy("core_start"))
    return chunks.select(F.col("book").alias(book), number.alias("chunk_index"), "core_start", "core_end", "window_start", "window_end")
