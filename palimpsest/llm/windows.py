"""Oversized windows cut into overlapping pieces that end at natural boundaries.

Only the positions of the boundaries travel, never the text: each chunk is reduced, where it is read, to the lengths
of its sentences, and these are joined with the windows.

Two plans share the rest. ``last_boundary`` cuts after the last boundary in reach; TESTDATA fixes this rule for
``p4_found``. ``balanced`` computes the least number of pieces, places equal-length targets, snaps each to the
strongest boundary nearby (line end over sentence end, then the nearest) and adds a piece whenever a limit fails.

Defined results: swapped bounds are exchanged, bounds outside the text are clipped, a window with a missing bound,
without text or not longer than the limit has no rows; a text without boundaries is cut at the limit.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUNDARIES = "。！？\n"

PIECES = "piece_no int, piece_start int, piece_end int"


def last_boundary(start: int, end: int, ends: list[int], strong: list[bool], limit: int, overlap: int) -> list[tuple[int, int]]:
    least = limit // 2 + 1
    pieces = []
    while end - start > limit:
        i = bisect_right(ends, start + limit) - 1
        cut = ends[i] if i >= 0 and ends[i] >= start + least else start + limit
        pieces.append((start, cut))
        start = cut - overlap
    return [*pieces, (start, end)]


def balanced(start: int, end: int, ends: list[int], strong: list[bool], limit: int, overlap: int) -> list[tuple[int, int]]:
    length = end - start
    count = max(1, -(-(length - overlap) // (limit - overlap)))
    while True:
        step, pieces, at = (length - overlap) / count, [], start
        reach = max(1, int(limit - overlap - step) if limit - overlap > step else 1, limit // 8)
        for k in range(1, count):
            target = round(start + k * step) + overlap
            near = [(not strong[i], abs(ends[i] - target), ends[i]) for i in range(bisect_right(ends, target - reach - 1), bisect_right(ends, target + reach)) if at + overlap < ends[i] < end]
            cut = min(near)[2] if near else target
            pieces.append((at, cut))
            at = cut - overlap
        pieces.append((at, end))
        if all(overlap < b - a <= limit for a, b in pieces) or count >= length:
            return pieces
        count += 1
        if count > 2 * (length // max(1, limit - overlap)) + 4:  # boundaries keep it from fitting: equal cuts fit
            return last_boundary(start, end, [], [], limit, overlap)


PLANS = {"last_boundary": last_boundary, "balanced": balanced}


def split_windows(windows: DataFrame, texts: DataFrame, on: list[str], key: str, limit: int = 1000, overlap: int = 100, plan: str = "last_boundary", marks: str = BOUNDARIES) -> DataFrame:
    """Pieces of every window of ``windows`` (``key``, ``on``, window_start, window_end) longer than ``limit``.

    ``texts`` has the columns ``on`` and ``text``. Texts not longer than the limit can hold no oversized window and
    are dropped where they are read, windows that are too short before clipping likewise.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    cut = PLANS[plan]
    low, high = F.least("window_start", "window_end"), F.greatest("window_start", "window_end")
    spans = windows.filter("window_start is not null and window_end is not null")
    spans = spans.select(key, *on, F.greatest(low, F.lit(0)).cast("int").alias("s"), high.cast("int").alias("e"))
    spans = spans.filter(F.col("e") - F.col("s") > limit).distinct()
    stretches = F.regexp_extract_all(F.col("text"), F.lit(f"[^{marks}]*[{marks}]|[^{marks}]+$"), F.lit(0))
    lengths = texts.filter(F.length("text") > limit).select(
        *on,
        F.length("text").alias("size"),
        F.transform(stretches, F.length).alias("lengths"),
        F.transform(stretches, lambda x: x.endswith("\n")).alias("strong"),
    )
    joined = spans.join(lengths, on).select(key, "s", F.least("e", "size").alias("e"), "lengths", "strong").filter(F.col("e") - F.col("s") > limit)
    kind = windows.schema[key].dataType.simpleString()

    def expand(batches):
        for batch in batches:
            at, rows = [], []
            cols = [batch.column(i).to_pylist() for i in range(1, 5)]
            for i, (s, e, sizes, strong) in enumerate(zip(*cols, strict=True)):
                ends, total = [], 0
                for n in sizes:
                    total += n
                    ends.append(total)
                pieces = cut(s, e, ends, strong, limit, overlap)
                at += [i] * len(pieces)
                rows += [(no, a, b) for no, (a, b) in enumerate(pieces, 1)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(list(c), pa.int32()) for c in cols)], [key, "piece_no", "piece_start", "piece_end"])

    return joined.mapInArrow(expand, f"{key} {kind}, {PIECES}")


def cluster_windows(clusters: DataFrame, hits: DataFrame) -> DataFrame:
    """Windows with the chunk that their hits name; hits without a chunk say nothing."""
    chunks = hits.filter("chunk_idx is not null").groupBy("cluster_id").agg(F.min("chunk_idx").alias("chunk_idx"))
    return clusters.select("cluster_id", "book_id", "window_start", "window_end").join(chunks, "cluster_id")
