"""Postings of whole batches in few rows: packed, compressed, and gathered by buckets of keys.

A posting list of many small rows costs the JVM more than the join itself. Here a batch's postings are cut into
buckets by the upper bits of their 48-bit keys, and each bucket travels as one row of compressed arrays. Keys that
alone would overfill a bucket are found beforehand (``often`` in each batch, ``frequent_keys`` over all) and spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a key.
BITS = (1 << 48) - 1
#: Postings of a bucket on average, and buckets over which frequent keys are spread.
BUCKET, SPREAD = 200_000, 64
#: A key with more than one in so many postings is frequent.
RARE = 100_000


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Numbers by planes of their bytes, compressed; rising ones as differences."""
    if rising and len(values):
        values = np.concatenate((values[:1], np.diff(values)))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def restored(packed: bytes, dtype, rising: bool = False) -> np.ndarray:
    n, dtype = int.from_bytes(packed[:8], "little"), np.dtype(dtype)
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[8:], n * dtype.itemsize, asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if rising else values


def column(parts: list[pa.RecordBatch], name: str, dtype, rising: bool = False) -> list[np.ndarray]:
    return [restored(v, dtype, rising) for p in parts for v in p.column(name).to_pylist()]


def grouped(batches) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows with the same value in the first column, which the input is sorted by."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            if held and keys[a] != key:
                yield key, held
                held = []
            key = int(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def often(keys: np.ndarray) -> bytes:
    """Keys with more than one in RARE postings of a batch, and their counts."""
    unique, count = np.unique(keys, return_counts=True)
    chosen = count >= max(4, len(keys) / RARE)
    return np.stack([unique[chosen], count[chosen].astype(np.uint64)], 1).tobytes()


def heavy_keys(batches: DataFrame, postings: int, hot: int) -> np.ndarray:
    """The frequent keys of all batches, whose column ``heavy`` holds what ``often`` gives."""

    def spread(rows):
        for batch in rows:
            for value in batch.column(0).to_pylist():
                both = np.frombuffer(value, np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, i].astype(np.int64)) for i in range(2)], ["fp", "n"])

    return frequent_keys(batches.select("heavy").mapInArrow(spread, "fp bigint, n bigint"), postings, hot)


def frequent_keys(rows: DataFrame, postings: int, hot: int) -> np.ndarray:
    """The keys of (fp, n) whose sum reaches ``hot`` and one in RARE postings: at most RARE of them, sorted."""
    found = rows.groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(postings / RARE, hot))
    return np.sort(found.toArrow()["fp"].to_numpy()).astype(np.uint64)


def bits_for(postings: int) -> int:
    return max(3, int(np.ceil(np.log2(max(1, postings) / BUCKET)))) if postings > BUCKET else 3


def by_bucket(fps: np.ndarray, heavy: np.ndarray, bits: int, salt: int) -> np.ndarray:
    """Bucket of each posting; those of frequent shingles are spread."""
    bucket = (fps >> np.uint64(48 - bits)).astype(np.int32)
    return np.where(heavy, (1 << bits) + (fps + np.uint64(salt)).astype(np.int64) % SPREAD, bucket).astype(np.int32)
