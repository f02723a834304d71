import numpy as np
import pyarrow as pa

from palimpsest.llm.packed import BITS, SPREAD, bits_for, by_bucket, frequent_keys, grouped, heavy_keys, often, restored, squeeze


def test_round_trip():
    rng = np.random.default_rng(1)
    for dtype in (np.uint16, np.int32, np.int64, np.uint64):
        for n in (0, 1, 7, 5000):
            values = rng.integers(0, 60_000, n).astype(dtype)
            assert np.array_equal(restored(squeeze(values), dtype), values)
            assert np.array_equal(restored(squeeze(np.sort(values), True), dtype, True), np.sort(values))
    far = np.array([0, 1, BITS, 2**64 - 1], np.uint64)
    assert np.array_equal(restored(squeeze(far, True), np.uint64, True), far)


def test_groups_run_over_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], ["k", "v"]) for k, v in (([1, 1, 2], [0, 1, 2]), ([2], [3]), ([2, 5], [4, 5]), ([], []))]
    batches[3] = batches[0].slice(0, 0)
    got = {k: [x for p in parts for x in p.column("v").to_pylist()] for k, parts in grouped(batches)}
    assert got == {1: [0, 1], 2: [2, 3, 4], 5: [5]}


def test_frequent_keys_leave_their_bucket(spark):
    keys = np.concatenate([np.full(600, 5), np.arange(1000)]).astype(np.uint64)
    df = spark.createDataFrame([(bytearray(often(keys)),), (bytearray(often(keys[:10])),)], "heavy binary")
    heavy = heavy_keys(df, len(keys), hot=500)
    assert heavy.tolist() == [5]
    assert len(frequent_keys(df.limit(0).selectExpr("0L as fp", "0L as n"), 0, 500)) == 0
    bits = bits_for(len(keys))
    bucket = by_bucket(keys, np.isin(keys, heavy), bits, 3)
    assert ((bucket >= 1 << bits) == (keys == 5)).all() and bucket.max() < (1 << bits) + SPREAD
