"""Groups of near-duplicate texts by a grouped prefix join.

1. Every text becomes the set of its winnowed shingles (``tokens.fingerprints``), batch by batch.
2. Shingles are counted exactly, in buckets of packed postings; one that only one text has can't be shared and is
   dropped. The others are ordered from rare to frequent. Two texts that share the fraction ``share`` of the larger set
   also share ``SHARED`` of the first ``m - ceil(share * n) + SHARED`` of the ``m`` shingles left of ``n``, so only
   these prefixes are joined, and a text with ``m`` below ``share * n`` has no partner at all.
3. Texts with identical prefix and size collapse into one group. Copies, and members that verify against the group's
   leader, are represented by it; the others stay on their own.
4. Prefixes are joined bucket by bucket. A posting carries what follows it in its prefix, so that sizes and the number
   of common shingles are known before a pair leaves the task. Postings of shingles of more than ``OFTEN`` texts also
   carry a sketch of the text's token pairs, which bounds the overlap of two texts from above: of the many texts with
   one clause, whose pairs grow as the square of the input, only those that can be similar leave the task. Pairs are
   verified on their whole texts: the overlap of their token pairs, as multisets, must reach ``similarity`` of the
   longer text.
5. Group pairs whose leaders fail are expanded to their members, where the members' overlap with their leaders leaves
   a link possible (``_expanded``). Leaders of members that aren't copies have no sketch, so that these pairs are kept.
6. Verified links are closed to groups by star rewrites (``components``).

A run of more than ``hot`` texts with the same shingle isn't expanded to pairs. Its texts are joined on two such
shingles at once. Where even a pair of shingles is hot, each text is first verified against the smallest and the next
one, which settles copies of one text; then all pairs of its texts that no link has joined yet are compared, block by
block (``_rest``). Shingles of more than one in 50 000 postings are known before postings are shuffled, those of all
texts before they are counted and those of all prefixes before they are joined (there are at most 100 000 of either);
their postings are spread over many buckets.

Defined results: NULL and blank texts and texts without any letter or digit belong to no group; a repeated id counts
once; exact copies are always one group; long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components
from palimpsest.llm.packed import BITS, bits_for, by_bucket, column, frequent_keys, grouped, heavy_keys, often, restored, squeeze
from palimpsest.llm.tokens import fingerprints, scramble, shingles, slices, tokenize
from palimpsest.plans.shared import join_by_degree, materialize, release

#: Tokens of a shingle, and shingles of a window of which the least is kept.
K, W = 8, 4
#: Least overlap of the shingle sets that candidates have, and of the token pairs of verified texts.
SHARE, SIMILARITY = 0.25, 0.62
#: Common shingles that a candidate pair has in its prefixes, but for sets too small to have them.
SHARED = 3
HOT = 5000
#: Counts are kept up to this; a shingle with it is frequent, and frequent ones are ordered by their hash.
MOST = 0xFFFF
#: Shingles of more texts than this have the texts' sketches with them. Bits of a sketch.
OFTEN, SKETCH = 32, 512
#: Pairs of postings that are compared at once.
PAIRS = 1_000_000


def _prepared(values: list, prepare: Callable | None) -> list:
    return values if prepare is None else [v if v is None else prepare(v) for v in values]


def _same(tokens, rows: np.ndarray) -> np.ndarray:
    """128 bits for each of the documents ``rows`` that are equal for the same tokens, as two columns."""
    bounds = tokens.bounds()
    place = (np.arange(len(tokens.hash)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = [scramble(tokens.hash + scramble(place + np.uint64(salt))) for salt in (1, 1 << 40)]
        sums = [np.add.reduceat(m, bounds[:-1][rows]).astype(np.uint64) if len(rows) else m for m in mixed]
    return np.stack(sums, 1)


def _sketches(tokens, rows: np.ndarray) -> np.ndarray:
    """A row of ``SKETCH`` bits, in bytes, for each of the documents ``rows``: those that its token pairs hash to."""
    h, first = shingles(tokens, 2)
    owner = tokens.doc[first]
    bounds = tokens.bounds()
    single = np.flatnonzero(np.diff(bounds) == 1)
    h, owner = np.append(h, tokens.hash[bounds[single]]), np.append(owner, single)
    number = np.full(tokens.docs, -1)
    number[rows] = np.arange(len(rows))
    wanted = number[owner] >= 0
    bits = np.zeros((len(rows), SKETCH), bool)
    bits[number[owner[wanted]], (h[wanted] % np.uint64(SKETCH)).astype(np.int64)] = True
    return np.packbits(bits, 1)


def packed_sets(df: DataFrame, k: int, w: int, prepare: Callable | None) -> DataFrame:
    """One row per batch of texts with tokens: ids, token keys, numbers of token pairs and of shingles, distinct shingles.

    ``heavy`` holds the shingles with more than one in ``RARE`` postings of the batch, and their counts.
    """
    names = ["batch", "postings", "ids", "same", "sizes", "counts", "fps", "heavy", "sketches"]

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, values = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices(values, 2_000_000, MOST // 2):
                tokens = tokenize(_prepared(values[a:b], prepare))
                fps, first = fingerprints(tokens, k, w)
                fps = (fps & BITS).view(np.uint64)
                doc = tokens.doc[first]
                order = np.lexsort((fps, doc))
                fps, doc = fps[order], doc[order]
                new = np.ones(len(fps), bool)
                new[1:] = (fps[1:] != fps[:-1]) | (doc[1:] != doc[:-1])
                fps, doc = fps[new], doc[new]
                n = np.bincount(doc, minlength=tokens.docs).astype(np.int32)
                rows = np.flatnonzero(n)
                if not len(rows):
                    continue
                pairs = np.maximum(1, np.diff(tokens.bounds())[rows] - 1).astype(np.int32)
                row = [[number], [len(fps)], *([x.tobytes()] for x in (ids[a:b][rows].astype(np.int64), _same(tokens, rows), pairs, n[rows])), [squeeze(fps)], [often(fps)], [squeeze(_sketches(tokens, rows).ravel())]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int64()] * 2 + [pa.binary()] * 7, strict=True)], names)
                number += 1

    return df.select("id", "text").mapInArrow(cut, "batch bigint, postings bigint, ids binary, same binary, sizes binary, counts binary, fps binary, heavy binary, sketches binary")


def _heavy_prefixes(prefixed: DataFrame, postings: int, hot: int) -> np.ndarray:
    """The frequent shingles of all prefixes; only shingles of so many texts are counted again."""

    def count(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            fps, n = np.unique(keys[keys >> np.uint64(48) >= min(hot, MOST)] & np.uint64(BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(fps.astype(np.int64)), pa.array(n)], ["fp", "n"])

    return frequent_keys(prefixed.select("keys").mapInArrow(count, "fp bigint, n bigint"), postings, hot)


def _counted(docs: DataFrame, frequent: np.ndarray, postings: int) -> DataFrame:
    """(batch, kind 1, a, b, c): for each batch the texts, their shingles that other texts have too, and the counts of these."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(frequent), bits_for(postings)

    def pack(batches):
        for batch in batches:
            for number, counts, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fps, n = restored(packed, np.uint64), np.frombuffer(counts, np.int32)
                local = np.repeat(np.arange(len(n), dtype=np.uint16), n)
                bucket = by_bucket(fps, np.isin(fps, shared.value), bits, number)
                order = np.lexsort((fps, bucket))
                fps, local, bucket = fps[order], local[order], bucket[order]
                starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                ends = np.append(starts[1:], len(fps))
                rows = [bucket[starts], np.full(len(starts), number), *([squeeze(x[a:b], rising) for a, b in zip(starts, ends, strict=True)] for x, rising in ((local, False), (fps, True)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "batch", "a", "b"])

    def count(batches):
        for bucket, parts in grouped(batches):
            numbers = np.concatenate([p.column("batch").to_numpy() for p in parts])
            local, fps = column(parts, "a", np.uint16), column(parts, "b", np.uint64, True)
            ends = np.cumsum([len(x) for x in fps])
            every = np.concatenate(fps)
            if bucket >> bits:
                df = np.full(len(every), MOST, np.uint16)
            else:
                _, inverse, n = np.unique(every, return_inverse=True, return_counts=True)
                df = np.minimum(n, MOST).astype(np.uint16)[inverse]
            out = [[], [], []]
            for texts, own, times in zip(local, fps, np.split(df, ends[:-1]), strict=True):
                kept = times > 1
                for target, x, rising in zip(out, (texts, own, times), (False, True, False), strict=True):
                    target.append(squeeze(x[kept], rising))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([1] * len(fps), pa.int32()), *(pa.array(x, pa.binary()) for x in out)], ["batch", "kind", "a", "b", "c"])

    sent = docs.select("batch", "counts", "fps").mapInArrow(pack, "bucket int, batch bigint, a binary, b binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "batch bigint, kind int, a binary, b binary, c binary")


def _prefixes(docs: DataFrame, counted: DataFrame, share: float) -> DataFrame:
    """(id, same, size, n, m, alike, keys, sketch) of the texts that can have a partner.

    ``n`` and ``m`` are the numbers of a text's shingles and of those that others have, ``keys`` its prefix, and
    ``alike`` is equal for equal prefix and size. ``sketch`` is empty where no shingle of the prefix needs it.
    """
    names = ["id", "same", "size", "n", "m", "alike", "keys", "sketch"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def cut(batches):
        for _, parts in grouped(batches):
            info, rest = parts[0].slice(0, 1), [parts[0].slice(1), *parts[1:]]  # the texts of the batch come first
            ids, numbers = np.frombuffer(info.column("a")[0].as_py(), np.int64), info.column("b")[0].as_py()
            size, n = (np.frombuffer(numbers[4 * len(ids) * i : 4 * len(ids) * (i + 1)], np.int32) for i in range(2))
            same = numbers[8 * len(ids) :]
            sketches = restored(info.column("c")[0].as_py(), np.uint8).reshape(len(ids), -1)
            local = np.concatenate([np.zeros(0, np.int64), *column(rest, "a", np.uint16)]).astype(np.int64)
            # An order key is the count of a shingle and, below it, the shingle.
            keys = np.concatenate([np.zeros(0, np.uint64), *((df.astype(np.uint64) << np.uint64(48)) | fps for fps, df in zip(column(rest, "b", np.uint64, True), column(rest, "c", np.uint16), strict=True))])
            order = np.lexsort((keys, local))
            local, keys = local[order], keys[order]
            m = np.bincount(local, minlength=len(ids))
            wanted = np.ceil(share * n - 1e-9).astype(np.int64)
            rank = np.arange(len(local)) - np.repeat(np.cumsum(m) - m, m)
            length = np.where(m >= wanted, np.minimum(m, m - wanted + SHARED), 0)
            kept = rank < length[local]
            with np.errstate(over="ignore"):
                mixed = np.where(kept, scramble(keys + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 0).astype(np.uint64)
                total = np.concatenate(([0], np.cumsum(mixed))).astype(np.uint64)
                ends = np.cumsum(m)
                alike = scramble(total[ends] - total[ends - m] + n.astype(np.uint64) + (size.astype(np.uint64) << np.uint64(32))).view(np.int64)
            many = np.bincount(local[kept], keys[kept] >> np.uint64(48) > OFTEN, len(ids)) > 0
            keys, ends = keys[kept], np.cumsum(length)
            rows = np.flatnonzero(length)
            columns = [ids[rows], [same[16 * i : 16 * i + 16] for i in rows], size[rows], n[rows], m[rows].astype(np.int32), alike[rows], [keys[ends[i] - length[i] : ends[i]].tobytes() for i in rows], [sketches[i].tobytes() if many[i] else b"" for i in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    texts = docs.select("batch", F.lit(0).alias("kind"), F.col("ids").alias("a"), F.concat("sizes", "counts", "same").alias("b"), F.col("sketches").alias("c"))
    both = texts.unionByName(counted).repartition("batch").sortWithinPartitions("batch", "kind")
    return both.mapInArrow(cut, "id bigint, same binary, size int, n int, m int, alike bigint, keys binary, sketch binary")


def overlap(left: list[str], right: list[str], of_left: bool = False) -> np.ndarray:
    """Shared token pairs of two texts as a fraction of the longer one's, by multisets; 1 for equal single tokens.

    With ``of_left`` the fraction is of the left text's.
    """
    n = len(left)
    number = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}  # each text is read once
    tokens = tokenize(list(number))
    h, first = shingles(tokens, 2)
    owner = tokens.doc[first]
    bounds = tokens.bounds()
    single = np.flatnonzero(np.diff(bounds) == 1)
    h, owner = np.append(h, tokens.hash[bounds[single]]), np.append(owner, single)
    # The i-th occurrence of a token pair gets a hash of its own, so that multisets become sets of 32-bit numbers.
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    size = np.bincount(owner, minlength=len(number))
    place = np.arange(len(h))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    again = place - np.maximum.accumulate(np.where(new, place, 0))
    with np.errstate(over="ignore"):
        h = scramble(h + again.astype(np.uint64)) >> np.uint64(32)
    h = np.sort((owner.astype(np.uint64) << np.uint64(32)) | h) & np.uint64(0xFFFFFFFF)
    start = np.cumsum(size) - size

    def elements(side: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = np.array([number[t] for t in side], np.int64)
        counts = size[text] if n else np.zeros(0, np.int64)
        at = np.arange(counts.sum()) + np.repeat((start[text] if n else counts) - (np.cumsum(counts) - counts), counts)
        return counts, (np.repeat(np.arange(n, dtype=np.uint64), counts) << np.uint64(32)) | h[at]

    (sizes, a), (others, b) = elements(left), elements(right)
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # two sorted runs
    equal = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
    common = np.bincount(equal.astype(np.int64), minlength=n)[:n] if n else np.zeros(0)
    return common / np.maximum(1, sizes if of_left else np.maximum(sizes, others))


def _overlaps(pairs: DataFrame, texts: DataFrame, prepare: Callable | None) -> DataFrame:
    """(a, b, part): the overlap of the whole texts of each pair."""

    def check(batches):
        for batch in batches:
            part = overlap(*(_prepared(batch.column(i).to_pylist(), prepare) for i in (2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part, pa.float64())], ["a", "b", "part"])

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint, part double")


def _texts_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of the ids in the pairs, once per id."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    return materialize(rows.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "texts")


def _verified(pairs: DataFrame, rows: DataFrame, prepare: Callable | None) -> DataFrame:
    texts = _texts_of(pairs, rows)
    found = materialize(_overlaps(pairs, texts, prepare), "overlaps")
    release(texts)
    return found


def _common(fp, ids, n, m, size, length, start, place, after, sketches, share: float, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of postings of one shingle each that pass the size and count filters, as numbers of the postings.

    Postings are sorted by shingle; ``after`` holds what follows each posting in its prefix, from ``start`` on, and the
    row ``place`` of ``sketches``, unless negative, its text's sketch. The overlap of two texts is at most the number
    of bits that both sketches have and the lesser number of token pairs without a bit of their own.
    """
    words = np.ascontiguousarray(sketches.view(np.uint64).T)
    plus = np.where(place < 0, 0, size - np.append(np.bitwise_count(words).sum(0, dtype=np.int64), 0)[place])
    begin = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
    runs = np.diff(np.append(begin, len(fp)))
    later = np.repeat(runs, runs) - (np.arange(len(fp)) - np.repeat(begin, runs)) - 1
    done = np.cumsum(later)
    lo = 0
    while lo < len(fp):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
        part = later[lo:hi]
        left = np.repeat(np.arange(lo, hi), part)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part)
        lo = hi
        wanted = np.ceil(share * np.maximum(n[left], n[right]) - 1e-9).astype(np.int64)
        fit = (np.minimum(m[left], m[right]) >= wanted) & (np.minimum(size[left], size[right]) >= similarity * np.maximum(size[left], size[right]))
        least = np.minimum(SHARED, wanted) - 1
        fit &= np.minimum(length[left], length[right]) >= least
        left, right, least = left[fit], right[fit], least[fit]
        known = np.flatnonzero((place[left] >= 0) & (place[right] >= 0))
        if len(known):
            a, b = left[known], right[known]
            most = np.minimum(plus[a], plus[b])
            for word in words:
                most += np.bitwise_count(word[place[a]] & word[place[b]])
            fit = np.ones(len(left), bool)
            fit[known] = most >= similarity * np.maximum(size[a], size[b]) - 1e-9
            left, right, least = left[fit], right[fit], least[fit]
        if not len(left):
            continue
        number = np.arange(len(left), dtype=np.uint64)
        both = []
        for side in (left, right):
            counts = length[side]
            at = np.arange(counts.sum()) + np.repeat(start[side] - (np.cumsum(counts) - counts), counts)
            both.append((np.repeat(number, counts) << np.uint64(16)) | after[at])
        both = np.sort(np.concatenate(both))
        equal = both[1:][both[1:] == both[:-1]] >> np.uint64(16)
        good = np.bincount(equal.astype(np.int64), minlength=len(left)) >= least
        yield left[good], right[good]


def _joined_prefixes(active: DataFrame, frequent: np.ndarray, postings: int, share: float, hot: int, similarity: float) -> DataFrame:
    """(a, b, n): distinct pairs of texts that pass the filters, with n = 0, and (text, shingle, n) of the hot runs."""
    shared, bits = active.sparkSession.sparkContext.broadcast(frequent), bits_for(postings)

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, size, n, m = (batch.column(i).to_numpy() for i in range(4))
            values, sketches = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            length = np.array([len(v) // 8 for v in values])
            keys, doc = np.frombuffer(b"".join(values), np.uint64), np.repeat(np.arange(len(ids)), length)
            ends = np.cumsum(length)
            fps = keys & np.uint64(BITS)
            bucket = by_bucket(fps, np.isin(fps, shared.value), bits, int(ids[0]) & 0xFFFF)
            order = np.lexsort((fps, bucket))
            starts = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
            rest = (ends[doc] - np.arange(len(keys)) - 1).astype(np.int32)  # keys that follow in the prefix
            short = scramble(fps).astype(np.uint16)
            df = keys >> np.uint64(48)
            # What has too little behind it meets nobody there; the lists of hot shingles are whole all the same.
            least = np.minimum(SHARED, np.ceil(share * n - 1e-9).astype(np.int64)) - 1
            used = (rest >= least[doc]) | (df >= min(hot, MOST))
            with_sketch = (df > OFTEN) & np.array([len(x) > 0 for x in sketches])[doc]
            rows = []
            for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                p = order[a:b][used[order[a:b]]]
                if not len(p):
                    continue
                d, r = doc[p], rest[p]
                at = np.arange(r.sum()) + np.repeat(p + 1 - (np.cumsum(r) - r), r)
                numbers = np.concatenate([size[d], n[d], m[d], r, with_sketch[p]]).astype(np.int32)
                drawn = np.frombuffer(b"".join([sketches[i] for i in d[with_sketch[p]]]), np.uint8)
                rows.append((int(bucket[p[0]]), squeeze(fps[p], True), squeeze(ids[d]), squeeze(numbers), squeeze(short[at]), squeeze(drawn)))
            if not rows:
                continue
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 5, strict=True)], ["bucket", "fps", "ids", "numbers", "after", "sketches"])

    def rows_of(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int32))], ["a", "b", "n"])

    def read(batches):
        for bucket, parts in grouped(batches):
            fps, ids = np.concatenate(column(parts, "fps", np.uint64, True)), np.concatenate(column(parts, "ids", np.int64))
            size, n, m, length, drawn = np.concatenate([x.reshape(5, -1) for x in column(parts, "numbers", np.int32)], 1).astype(np.int64)
            if bucket >> bits:
                yield rows_of(ids, fps.astype(np.int64), n)
                continue
            start, after = np.cumsum(length) - length, np.concatenate(column(parts, "after", np.uint16)).astype(np.uint64)
            place, sketches = np.where(drawn, np.cumsum(drawn) - 1, -1), np.concatenate(column(parts, "sketches", np.uint8)).reshape(-1, SKETCH // 8)
            order = np.lexsort((ids, fps))
            order = order[np.concatenate(([True], (fps[order][1:] != fps[order][:-1]) | (ids[order][1:] != ids[order][:-1])))]
            fps, ids, size, n, m, length, start, place = (x[order] for x in (fps, ids, size, n, m, length, start, place))
            _, inverse, df = np.unique(fps, return_inverse=True, return_counts=True)
            many, few = np.flatnonzero(df[inverse] > hot), np.flatnonzero((df[inverse] <= hot) & (df[inverse] > 1))
            if len(many):
                yield rows_of(ids[many], fps[many].astype(np.int64), n[many])
            own = ids[few]
            for left, right in _common(fps[few], own, *(x[few] for x in (n, m, size, length, start, place)), after, sketches, share, similarity):
                yield rows_of(np.minimum(own[left], own[right]), np.maximum(own[left], own[right]), np.zeros(len(left)))

    sent = active.select("id", "size", "n", "m", "keys", "sketch").mapInArrow(pack, "bucket int, fps binary, ids binary, numbers binary, after binary, sketches binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(read, "a bigint, b bigint, n int")
    return found.distinct()


def _hot_pairs(lists: DataFrame, share: float, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs among the texts of hot shingles, the texts of pairs of shingles that are hot as well, and the table both are read from."""
    hot_ids = lists.groupBy("id", "n").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
    twos = "flatten(transform(fps, (x, i) -> transform(slice(fps, i + 2, size(fps)), y -> struct(x as fp, y as fq))))"
    ones = "transform(fps, x -> struct(x as fp, x as fq))"
    small = f"ceil({share} * n - 1e-9) < 2"  # one shared shingle is enough
    one = f"case when size(fps) = 1 then {ones} when {small} then concat({ones}, {twos}) else {twos} end"
    double = hot_ids.select("id", "n", F.explode(F.expr(one)).alias("p")).select("p.fp", "p.fq", "id", "n")
    sizes = double.groupBy("fp", "fq").agg(F.count("*").alias("df"), F.min("id").alias("least")).filter("df > 1")
    double = materialize(double.join(sizes, ["fp", "fq"]), "double")
    many = double.filter(F.col("df") > hot)
    stars = many.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    by_size = Window.partitionBy("fp", "fq", F.floor(F.log2(F.col("n") + 1)), F.pmod(F.xxhash64("n"), F.lit(64))).orderBy("n", "id")
    near = many.withColumn("next", F.lead("id").over(by_size)).filter("next is not null")
    chains = near.select(F.least("id", "next").alias("a"), F.greatest("id", "next").alias("b"))
    left, right = (double.filter(F.col("df") <= hot).select("fp", "fq", F.col("id").alias(i), F.col("n").alias(f"n{i}")) for i in "ab")
    size = (F.col("na") >= share * F.col("nb")) & (F.col("nb") >= share * F.col("na"))
    few = left.join(right, ["fp", "fq"]).filter((F.col("a") < F.col("b")) & size).select("a", "b")
    rest = many.filter((F.col("fp") != F.col("fq")) | F.expr(small)).select("fp", "fq", "id", "df")
    return few.unionByName(stars).unionByName(chains).distinct(), rest, double


def _expanded(failed: DataFrame, kin: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members of groups whose leaders didn't verify, where a link is still possible.

    All members of a group are of one size ``S`` and share the part ``o`` with their leader. If a member of ``a``'s
    group and one of ``b``'s share the part ``s``, the leaders share at least ``oa + ob + s - 2`` of the shorter.
    """
    least = kin.groupBy("leader").agg(F.min("part").alias("least"))
    known = failed.join(least.select(F.col("leader").alias("a"), F.col("least").alias("oa")), "a", "left").join(least.select(F.col("leader").alias("b"), F.col("least").alias("ob")), "b", "left")
    bound = similarity * (F.coalesce("oa", F.lit(1.0)) + F.coalesce("ob", F.lit(1.0)) + similarity - 2)
    open_pairs = known.filter((F.col("oa").isNotNull() | F.col("ob").isNotNull()) & (F.col("part") >= bound)).select("a", "b")
    for side in "ab":
        own = kin.select(F.col("leader").alias(side), F.col("id").alias("member"))
        moved = open_pairs.join(own, side).select(*(F.col("member").alias(c) if c == side else c for c in "ab"))
        open_pairs = open_pairs.unionByName(moved)
    return open_pairs.join(failed.select("a", "b"), ["a", "b"], "left_anti").filter("a <> b").distinct()


def _unjoined(label: np.ndarray, block: np.ndarray, inside: bool, texts: list[str], similarity: float) -> list[tuple[int, int]]:
    """Links between texts of different labels that reach the similarity, enough to join all that belong together.

    Only pairs within one block are compared if ``inside``, else only pairs across the two blocks.
    """
    tokens = tokenize(texts)
    h, first = shingles(tokens, 2)
    owner = tokens.doc[first]
    width = 256
    # Counts by hash bucket: the sum of the lesser counts is never below the true overlap.
    cells = owner * width + (h % np.uint64(width)).astype(np.int64)
    counts = np.bincount(cells, minlength=len(texts) * width).reshape(-1, width).astype(np.int32)
    size = counts.sum(1)
    label, links = label.copy(), []
    for i in range(len(texts) - 1):
        later = np.arange(i + 1, len(texts))
        later = later[(label[later] != label[i]) & ((block[later] == block[i]) == inside)]
        longer = np.maximum(size[later], size[i])
        later = later[np.minimum(size[later], size[i]) >= similarity * longer]
        longer = np.maximum(size[later], size[i])
        later = later[np.minimum(counts[later], counts[i]).sum(1) >= similarity * longer]
        if len(later):
            good = later[overlap([texts[i]] * len(later), [texts[j] for j in later]) >= similarity]
            links += [(i, int(j)) for j in good]
            label[np.isin(label, label[good])] = label[i]
    return links


def _rest(many: DataFrame, links: DataFrame, rows: DataFrame, hot: int, similarity: float, prepare: Callable | None) -> DataFrame:
    """Verified links among the texts of hot pairs of shingles that ``links`` leave in different groups.

    Every two texts of a hot pair are either in one group already or compared, so that no true pair is missing from
    the closure. Blocks of about ``hot / 2`` texts are compared two by two; pairs of shingles with the same texts count
    once.
    """
    groups = connected_components(links)
    labels = many.select("id").distinct().join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    named = many.join(labels, "id")
    same = named.groupBy("fp", "fq").agg(
        F.count("*").alias("df"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum"),
        (F.min("label") < F.max("label")).alias("open"),
    )
    chosen = same.filter("open").groupBy("df", "sum").agg(F.min(F.struct("fp", "fq")).alias("p")).select("p.fp", "p.fq")
    texts = materialize(named.join(chosen, ["fp", "fq"]), "open")
    if texts.isEmpty():
        release(texts)
        return links.limit(0)
    blocks = F.ceil(F.col("df") / F.lit(max(1, hot // 2))).cast("int")
    placed = texts.select("fp", "fq", "id", "label", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    placed = placed.select("fp", "fq", "id", "label", "block", other)
    cells = placed.select("fp", "fq", "id", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    wanted = materialize(rows.join(texts.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, label, block = (table[c].to_numpy() for c in ("id", "label", "block"))
        inside = table["i"][0].as_py() == table["j"][0].as_py()
        found = _unjoined(label, block, inside, _prepared(table["text"].to_pylist(), prepare), similarity)
        a, b = ([ids[x[k]] for x in found] for k in range(2))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = cells.join(wanted, "id")
    return full.groupBy("fp", "fq", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(
    df: DataFrame, key: str, text: str, k: int = K, w: int = W, share: float = SHARE, similarity: float = SIMILARITY, hot: int = HOT, prepare: Callable | None = None
) -> DataFrame:
    """(id, group_id) of every text that has a near-duplicate; the group is named by its smallest id.

    ``prepare`` maps each text to the form that is compared.
    """
    if not 0 < share <= 1 or not 0 < similarity <= 1:
        raise ValueError("share and similarity are fractions")
    rows = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    docs = materialize(packed_sets(rows, k, w, prepare), "docs")
    postings = docs.agg(F.coalesce(F.sum("postings"), F.lit(0))).first()[0]
    prefixed = materialize(_prefixes(docs, _counted(docs, heavy_keys(docs, postings, hot), postings), share), "prefixed")
    release(docs, shuffles=True)
    # Groups of identical prefix and size.
    alike = prefixed.groupBy("alike").agg(F.count("*").alias("n"), F.min(F.struct("id", "same")).alias("first")).filter("n > 1")
    alike = alike.select("alike", "n", F.col("first.id").alias("leader"), (F.col("first.same")).alias("same_leader"))
    inside = join_by_degree(prefixed.select("alike", "id", "same"), alike, ["alike"], prefixed.count()).filter("id <> leader")
    inside = materialize(inside.select(F.col("leader").alias("a"), F.col("id").alias("b"), (F.col("same") == F.col("same_leader")).alias("copy")).distinct(), "inside")
    copies = inside.filter("copy").select("a", "b")
    members = _verified(inside.filter("not copy").select("a", "b"), rows, prepare)
    kin = members.filter(F.col("part") >= similarity).select(F.col("a").alias("leader"), F.col("b").alias("id"), "part")
    led = copies.unionByName(kin.select(F.col("leader").alias("a"), F.col("id").alias("b")))
    # Members leave the search; leaders whose members are not copies stay without a sketch, see _expanded.
    parts = led.select(F.col("b").alias("id"), F.lit(1).alias("led")).unionByName(kin.select(F.col("leader").alias("id"), F.lit(0).alias("led")))
    placed = prefixed.join(parts.groupBy("id").agg(F.max("led").alias("led")), "id", "left").filter("led is null or led = 0")
    active = placed.withColumn("sketch", F.when(F.col("led").isNull(), F.col("sketch")).otherwise(F.lit(b"")))
    kept = prefixed.agg(F.coalesce(F.sum(F.length("keys") / 8), F.lit(0))).first()[0]
    found = materialize(_joined_prefixes(active, _heavy_prefixes(prefixed, kept, hot), kept, share, hot, similarity), "found")
    release(prefixed, shuffles=True)
    pairs, lists = found.filter("n = 0").select("a", "b"), found.filter("n > 0").select(F.col("b").alias("fp"), F.col("a").alias("id"), "n")
    some_hot = not lists.isEmpty()
    if some_hot:
        more, many, double = _hot_pairs(lists, share, hot)
        pairs = materialize(pairs.unionByName(more).distinct(), "pairs")
    checked = _verified(pairs, rows, prepare)
    expanded = _expanded(checked.filter(F.col("part") < similarity), kin, similarity)
    expanded = _verified(materialize(expanded, "expanded"), rows, prepare)
    links = checked.unionByName(expanded).filter(F.col("part") >= similarity).select("a", "b").unionByName(led)
    if some_hot:
        links = materialize(links, "links")
        links = links.unionByName(materialize(_rest(many, links, rows, hot, similarity, prepare), "rest"))
        release(double, pairs)
    groups = materialize(connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("group_id")), "groups")
    release(found, inside, members, checked, expanded, shuffles=True)
    return groups


def member_pairs(groups: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of members of each group, smaller id first; only for results that are defined as pairs."""
    left, right = groups.select("group_id", F.col("id").alias(a)), groups.select("group_id", F.col("id").alias(b))
    return left.join(right, "group_id").filter(F.col(a) < F.col(b)).select(a, b)
