"""Values cut off by length limits or in transfer, and how often each source cuts.

Near-copies are found by min-hash banding over whole values and over their heads, which a strongly cut value keeps.
Values that agree in a band are compared with its longest members first, and those that these don't decide with further
ones in rounds, until each value is decided or has met all members of its bands that are no shorter. Only a text that
holds most of the value's token pairs is its copy. The end of a value is aligned within each copy: if the copy goes on
inside the sentence, the value is cut; if the copy has a sentence end there, it is whole. Values that no copy decides
are scored by the terminality of their last clause: a logistic model of how sentences end, fit on a bounded sample of
the values themselves, whose inner sentence ends are the positive examples and whose inner clause ends and random
places are the negative ones. Closing marks at the very end are ignored, as a mark set after a cut does not heal it.

Values of several fields go through one pipeline; each field has its own bands and model. Bands travel packed
(``packed``); those that hold a large part of the values are spread over many buckets, in each of which they have a
longest member.

Defined results: NULL and blank values and values without letters are not judged; an empty table gives empty results;
long values are processed whole; a repeated key counts once, and one with different values counts as each of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.neardup import SIMILARITY, _prepared, _same, overlap
from palimpsest.llm.packed import BITS, bits_for, by_bucket, column, grouped, heavy_keys, often, restored, squeeze
from palimpsest.llm.tokens import Tokens, fingerprints, scramble, slices, tokenize
from palimpsest.plans.shared import materialize, release

#: Tokens of a shingle in scripts without spaces and in words, bands and hashes of a band.
K, WORDS_K, BANDS, ROWS = 9, 6, 12, 3
#: Bands over the first shingles of a value alone, how many shingles these are, and their tokens as above.
HEADS, HEAD, HEAD_K, HEAD_WORDS_K = 2, 3, 12, 8
#: Members of each band that all others meet in the first round, and how many times as far each further round goes.
FIRST, STEP = 16, 8
#: A band of more values than this may be spread.
HOT = 5000
#: Values of each field in the sample that its terminality model is fit on; it doesn't grow with the data.
SAMPLE = 20_000
DIMENSIONS = 1 << 20
#: A last clause that ends a sentence with less than this probability is cut.
TERMINALITY = 0.1
#: Letters at the end of a value that are aligned with a copy, and those of them that must be the same.
TAIL, EXACT = 32, 4

STRONG, WEAK = "。！？!?；;.…", "，,、：:"
_CLAUSE = re.compile(f"[^{re.escape(STRONG + WEAK)}]+")
_TAIL = re.compile(r"[\W_]+$")


def _shingled(tokens: Tokens, characters: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents; texts whose tokens are mostly single characters have shingles of another length."""
    dense = np.bincount(tokens.doc, weights=tokens.end - tokens.start == 1, minlength=tokens.docs) * 2 > np.bincount(tokens.doc, minlength=tokens.docs)
    parts = []
    for k, own in ((characters, True), (words, False)):
        fps, first = fingerprints(tokens, k, 1)
        kept = dense[tokens.doc[first]] == own
        parts.append((fps[kept], tokens.doc[first][kept]))
    fps, doc = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(doc, kind="stable")
    return fps[order], doc[order]


def _bands(texts: list[str | None], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with tokens, a number that is equal for equal tokens, numbers of tokens, and 48-bit band keys in a row for each."""
    tokens = tokenize(texts)
    fps, doc = _shingled(tokens, K, WORDS_K)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, BANDS + HEADS), np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    rows = doc[starts]
    heads, of_heads = _shingled(tokens, HEAD_K, HEAD_WORDS_K)
    begins = np.flatnonzero(np.concatenate(([True], of_heads[1:] != of_heads[:-1])))
    late = np.arange(len(of_heads)) - np.repeat(begins, np.diff(np.append(begins, len(of_heads)))) >= HEAD
    keys = []
    with np.errstate(over="ignore"):
        for b in range(BANDS + HEADS):
            key = salts[rows] * np.uint64(31) + np.uint64(b)
            for r in range(ROWS if b < BANDS else 1):
                salt = scramble(np.array([b * ROWS + r + 1], np.uint64))
                h = scramble((fps if b < BANDS else heads).view(np.uint64) ^ salt)
                if b >= BANDS:
                    h[late] = ~np.uint64(0)
                key = scramble(key * np.uint64(31) + np.minimum.reduceat(h, starts if b < BANDS else begins))
            keys.append(key & np.uint64(BITS))
    both = _same(tokens, rows)
    with np.errstate(over="ignore"):
        same = scramble(both[:, 0] ^ scramble(both[:, 1] + salts[rows]))
    return rows, same, np.bincount(tokens.doc, minlength=tokens.docs)[rows], np.stack(keys, 1)


def _signed(texts: DataFrame, models, prepare: Callable | None) -> DataFrame:
    """One row per batch: the texts with tokens, their sizes, band keys and terminality scores.

    ``same`` is equal for the texts of one field with equal tokens, whose ends need to be looked for only once.
    """
    names = ["postings", "uids", "same", "sizes", "scores", "bands", "heavy"]

    def sign(batches):
        for batch in batches:
            uids, fields, values = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_pylist()
            for a, b in slices(values, 2_000_000):
                own = _prepared(values[a:b], prepare)
                salts = np.frombuffer(pd.util.hash_array(fields[a:b], categorize=True).tobytes(), np.uint64)
                rows, same, sizes, bands = _bands(own, salts)
                if not len(rows):
                    continue
                scores = np.zeros(len(own))
                for field in set(fields[a:b]):
                    some = np.flatnonzero(fields[a:b] == field)
                    scores[some] = models.value[field].score([own[i] for i in some])
                out = [bands.size, *(x.tobytes() for x in (uids[a:b][rows].astype(np.int64), same, sizes.astype(np.int32), scores[rows])), squeeze(bands.ravel()), often(bands.ravel())]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, [pa.int64()] + [pa.binary()] * 6, strict=True)], names)

    return texts.select("uid", "field", "text").mapInArrow(sign, "postings bigint, uids binary, same binary, sizes binary, scores binary, bands binary, heavy binary")


def _ranked(signed: DataFrame, hot: int) -> DataFrame:
    """(band, id, size, rank): the members of each band of two or more, the longest one first, with rank 0.

    A band that holds a large part of all values is ranked in several parts.
    """
    postings = signed.agg(F.coalesce(F.sum("postings"), F.lit(0))).first()[0]
    shared, bits = signed.sparkSession.sparkContext.broadcast(heavy_keys(signed, postings, hot)), bits_for(postings)

    def pack(batches):
        salt = TaskContext.get().partitionId() << 8
        for batch in batches:
            for ids, sizes, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = restored(packed, np.uint64)
                owner = np.repeat(np.arange(len(keys) // (BANDS + HEADS)), BANDS + HEADS)
                bucket = by_bucket(keys, np.isin(keys, shared.value), bits, salt)
                salt += 1
                order = np.lexsort((keys, bucket))
                keys, bucket, owner = keys[order], bucket[order], owner[order]
                starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                ends = np.append(starts[1:], len(keys))
                ids, sizes = np.frombuffer(ids, np.int64)[owner], np.frombuffer(sizes, np.int32)[owner]
                rows = [bucket[starts], *([squeeze(x[a:b], rising) for a, b in zip(starts, ends, strict=True)] for x, rising in ((keys, True), (ids, False), (sizes, False)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, [pa.int32()] + [pa.binary()] * 3, strict=True)], ["bucket", "bands", "ids", "sizes"])

    def rank(batches):
        for bucket, parts in grouped(batches):
            keys, ids, sizes = (np.concatenate(column(parts, c, t, c == "bands")) for c, t in (("bands", np.uint64), ("ids", np.int64), ("sizes", np.int32)))
            order = np.lexsort((ids, -sizes, keys))
            order = order[np.concatenate(([True], (np.diff(keys[order]) != 0) | (np.diff(ids[order]) != 0)))]
            keys, ids, sizes = keys[order], ids[order], sizes[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            runs = np.diff(np.append(starts, len(keys)))
            place = np.arange(len(keys)) - np.repeat(starts, runs)
            kept = (np.repeat(runs, runs) > 1) | bool(bucket >> bits)
            columns = [keys[kept].astype(np.int64), ids[kept], sizes[kept], place[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["band", "id", "size", "rank"])

    sent = signed.select("same", "sizes", "bands").mapInArrow(pack, "bucket int, bands binary, ids binary, sizes binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rank, "band bigint, id bigint, size int, rank bigint")


@lru_cache(maxsize=4096)
def _letters(text: str) -> tuple[str, list[int]]:
    low = text.lower() if len(text.lower()) == len(text) else text
    at = [i for i, c in enumerate(low) if c.isalnum()]
    return "".join(low[i] for i in at), at


def _aligned_end(tail: str, letters: str, most: float = 0.25) -> int:
    """Where ``tail`` ends in ``letters`` at its best alignment, or -1 if it has more edits than ``most`` of it.

    The last letters must be the same, so that an edit at the end itself aligns nowhere.
    """
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (tail, letters))
    row = np.zeros(len(b) + 1, np.int32)  # the alignment may begin anywhere
    place = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        best = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (b != c))))
        row = np.minimum.accumulate(best - place) + place
    ends = [m.end() for m in re.finditer(f"(?={re.escape(tail[-EXACT:])})", letters)]
    ends = [e + len(tail[-EXACT:]) for e in ends]
    end = min(ends, key=lambda e: (int(row[e]), -e), default=-1)
    return end if end >= 0 and row[end] <= most * len(a) else -1


def ends_early(value: str, copy: str) -> int:
    """1 if the copy goes on inside the sentence where the value ends, -1 if a sentence ends there, 0 if undecided."""
    a, _ = _letters(value)
    b, at = _letters(copy)
    end = -1
    for size in (14, 9):
        tail = a[-size:]
        if len(tail) < min(size, 6):
            return 0
        found = b.find(tail, max(0, len(a) - len(tail) - 60))
        if found < 0:
            found = b.find(tail)
        if found >= 0:
            end = found + len(tail)
            break
    if end < 0 and len(a) >= TAIL:
        end = _aligned_end(a[-TAIL:], b)
    if end < 0 or end == len(b):
        return 0
    between = copy[at[end - 1] + 1 : at[end]]
    if all(c.isspace() or c in "-'’·" for c in between):
        # Where words aren't spaced, a space stands for a mark that may end the sentence.
        return 0 if between and "\u2e80" <= b[end - 1] and "\u2e80" <= b[end] else 1
    return -1 if any(c in STRONG for c in between) else 0


def _votes(pairs: DataFrame, texts: DataFrame, prepare: Callable | None) -> DataFrame:
    """(id, most, least) of the votes of the texts that hold most of the value's token pairs."""

    def align(batches):
        for batch in batches:
            values, copies = (_prepared(batch.column(i).to_pylist(), prepare) for i in (1, 2))
            some = np.flatnonzero(overlap(values, copies, of_left=True) >= SIMILARITY)
            votes = np.array([ends_early(values[i], copies[i]) for i in some], np.int32)
            some, votes = some[votes != 0], votes[votes != 0]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(votes)], ["id", "vote"])

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select(F.col("a").alias("id"), "ta", "tb")
    return joined.mapInArrow(align, "id bigint, vote int").groupBy("id").agg(F.max("vote").alias("most"), F.min("vote").alias("least"))


def _decided(signed: DataFrame, known: DataFrame, texts: DataFrame, prepare: Callable | None, hot: int) -> DataFrame:
    """(id, vote) of the values whose copies agree, from rounds down the bands that end with the longest of them."""
    ranked = materialize(_ranked(signed, hot), "ranked")
    top = ranked.agg(F.max("rank")).first()[0]
    first = known.groupBy("id").agg(F.min("uid").alias("uid"))
    low, high, votes = 0, FIRST, None
    while top is not None and low <= top:
        value = ranked.select("band", F.col("id").alias("a"), F.col("size").alias("own"))
        if votes is not None:
            value = value.join(votes.select(F.col("id").alias("a")), "a", "left_anti")
        longer = ranked.filter((F.col("rank") >= low) & (F.col("rank") < high)).select("band", F.col("id").alias("b"), "size")
        pairs = materialize(value.join(longer, "band").filter("own <= size and a <> b").select("a", "b").distinct(), "pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = materialize(texts.select("uid", "text").join(first.join(ids, "id", "left_semi"), "uid").select("id", "text"), "texts")
        found = materialize(_votes(pairs, wanted, prepare), "votes")
        votes = found if votes is None else votes.unionByName(found)
        release(pairs, wanted)
        low, high = high, high * STEP
    release(ranked, shuffles=True)
    if votes is None:
        return known.limit(0).select("id", F.lit(0).alias("vote"))
    return votes.filter("most = least").select("id", F.col("most").alias("vote"))


class Terminality:
    """Logistic model: does the last clause of a text end its sentence?"""

    def __init__(self, values: list[str]):
        rng = np.random.default_rng(11)
        words = tokenize(values)
        unique, counts = np.unique(words.hash, return_counts=True)
        self.known = unique[counts >= 3]
        clauses, labels, weights = [], [], []
        for value in values:
            found = list(_CLAUSE.finditer(value))
            for m in found:
                clause = m.group()
                mark = value[m.end() : m.end() + 1]
                if mark and mark in STRONG and mark != "…":
                    clauses.append(clause)
                    labels.append(1.0)
                    weights.append(1.0)
                elif mark and mark in WEAK:
                    clauses.append(clause)
                    labels.append(0.0)
                    weights.append(0.5)
                elif not mark:  # most values without a closing mark are whole
                    clauses.append(clause)
                    labels.append(1.0)
                    weights.append(0.3)
                if len(clause) > 3:
                    cut = clause[: int(rng.integers(1, len(clause)))]
                    if cut.strip():
                        clauses.append(cut)
                        labels.append(0.0)
                        weights.append(0.5)
        self.weights = np.zeros(DIMENSIONS)
        if clauses:
            self._fit(clauses, np.array(labels), np.array(weights), rng)

    def features(self, clauses: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(clause number, feature) pairs: tokens and pairs of them, the first and the last ones, and unknown words."""
        tokens = tokenize(clauses)
        bounds = tokens.bounds()
        h, doc = tokens.hash, tokens.doc
        rows, feats = [], []

        def add(owner, value, salt):
            rows.append(owner)
            with np.errstate(over="ignore"):
                feats.append((scramble(value + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(DIMENSIONS)).astype(np.int64))

        with np.errstate(over="ignore"):
            run = h.copy()
            for n in range(1, 3):
                if n > 1:
                    run = run[: len(h) - n + 1] * np.uint64(0x100000001B3) + h[n - 1 :] if len(h) >= n else run[:0]
                inside = doc[: len(run)] == doc[n - 1 : n - 1 + len(run)]
                add(doc[: len(run)][inside], run[inside], n)
            count = np.diff(bounds)
            last, first = bounds[1:] - 1, bounds[:-1]
            tail, head = np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64)
            for n in range(5):
                ok = np.flatnonzero(count > n)
                tail[ok] = tail[ok] * np.uint64(0x100000001B3) + h[last[ok] - n]
                add(ok, tail[ok], 10 + n)
                if n < 2:
                    head[ok] = head[ok] * np.uint64(0x100000001B3) + h[first[ok] + n]
                    add(ok, head[ok], 20 + n)
            some = np.flatnonzero(count > 0)
            if len(self.known):
                at = np.minimum(np.searchsorted(self.known, h[last[some]]), len(self.known) - 1)
                add(some, (self.known[at] == h[last[some]]).astype(np.uint64), 30)
            add(some, np.minimum(count[some], 12).astype(np.uint64), 31)
        return np.concatenate(rows), np.concatenate(feats)

    def _fit(self, clauses: list[str], labels: np.ndarray, weights: np.ndarray, rng) -> None:
        squares, size = np.full(DIMENSIONS, 1e-3), 4000
        for _ in range(6):
            order = rng.permutation(len(clauses))
            for start in range(0, len(order), size):
                part = order[start : start + size]
                rows, feats = self.features([clauses[i] for i in part])
                p = self._probability(rows, feats, len(part))
                error = (p - labels[part]) * weights[part]
                used, place = np.unique(feats, return_inverse=True)
                gradient = np.bincount(place, weights=error[rows]) / len(part) * 50
                squares[used] += gradient**2
                self.weights[used] -= 0.3 * gradient / np.sqrt(squares[used])

    def _probability(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(rows, weights=self.weights[feats], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, values: list[str]) -> np.ndarray:
        """Probability that each value ends with its last sentence, whatever marks follow."""
        clauses = []
        for value in values:
            bare = _TAIL.sub("", value)
            found = None
            for found in _CLAUSE.finditer(bare):
                pass
            clauses.append(found.group() if found else "")
        rows, feats = self.features(clauses)
        return self._probability(rows, feats, len(values))


def _models(texts: DataFrame, sample: int, prepare: Callable | None) -> dict[str, Terminality]:
    """A terminality model of each field, fit on the executors on about ``sample`` of its values."""
    numbers = {r.field: r["count"] for r in texts.groupBy("field").count().collect()}
    share = F.lit(0)
    for field, number in numbers.items():
        share = F.when(F.col("field") == field, int(min(1.0, sample / number) * 1_000_000)).otherwise(share)
    chosen = texts.filter(F.pmod(F.col("h"), F.lit(1_000_000)) < share).select("field", "h", "text")

    def fit(table: pa.Table) -> pa.Table:
        values = _prepared(table.sort_by("h")["text"].to_pylist(), prepare)
        model = Terminality([v for v in values if v])
        used = np.flatnonzero(model.weights)
        packed = [x.tobytes() for x in (model.known, used.astype(np.int64), model.weights[used])]
        return pa.table({"field": [table["field"][0].as_py()], **{n: pa.array([x], pa.binary()) for n, x in zip(("known", "at", "weights"), packed, strict=True)}})

    models = {field: Terminality([]) for field in numbers}
    for row in chosen.groupBy("field").applyInArrow(fit, "field string, known binary, at binary, weights binary").collect():
        model = models[row.field]
        model.known = np.frombuffer(row.known, np.uint64)
        model.weights[np.frombuffer(row.at, np.int64)] = np.frombuffer(row.weights)
    return models


def find_cut(
    df: DataFrame, key: str, text: str, prepare: Callable | None = None, sample: int = SAMPLE, threshold: float = TERMINALITY, field: str | None = None, hot: int = HOT
) -> DataFrame:
    """(field, id, cut, score, by): every judged value; ``by`` says whether a copy or the last clause decided.

    Values are compared with others of the same ``field`` only; without it all rows are of one field.
    """
    named = F.coalesce(F.col(field).cast("string"), F.lit("")) if field else F.lit("")
    rows = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(named.alias("field"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    hashes = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "text").alias("g")]
    # Numbers are fixed by writing the table.
    texts = materialize(rows.select("field", "text").distinct().select("field", "text", *hashes, F.monotonically_increasing_id().alias("uid")), "values")
    models = df.sparkSession.sparkContext.broadcast(_models(texts, sample, prepare))
    signed = materialize(_signed(texts, models, prepare), "signed")

    def spread(batches):
        for batch in batches:
            for value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, t)) for v, t in zip(value, (np.int64, np.int64, np.float64), strict=True)], ["uid", "id", "score"])

    known = signed.select("uids", "same", "scores").mapInArrow(spread, "uid bigint, id bigint, score double")
    scored = known.join(_decided(signed, known, texts, prepare, hot), "id", "left")
    cut = F.when(F.col("vote").isNotNull(), F.col("vote") > 0).otherwise(F.col("score") < threshold)
    judged = scored.select("uid", cut.alias("cut"), "score", F.when(F.col("vote").isNotNull(), "copy").otherwise("clause").alias("by"))
    judged = judged.join(texts.select("field", "h", "g", "uid"), "uid").drop("uid")
    members = rows.select("field", "id", *hashes).distinct()
    return members.join(judged, ["field", "h", "g"]).select("field", "id", "cut", "score", "by")


def causal_descriptions(results: DataFrame) -> DataFrame:
    """(result_id, source, description) from the outline, also under its older name and in wrapped or text sections."""
    from palimpsest.operators.nested import _sections

    def read(batches):
        for batch in batches:
            at, out = [], []
            for i, document in enumerate(batch.column(2).to_pylist()):
                for _, section in _sections(document, ("causal_chain",), "outline_architecture"):
                    if isinstance(section, dict):
                        value = section.get("causal_description", section.get("observation"))
                        if isinstance(value, str):
                            at.append(i)
                            out.append(value)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(out, pa.string())], ["result_id", "source", "description"])

    chosen = results.filter("outline_architecture is not null").select("result_id", "source", "outline_architecture")
    return chosen.mapInArrow(read, "result_id bigint, source string, description string")
