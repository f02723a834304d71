"""The languages of a document, sentence by sentence, by word-first backoff.

A known word is scored by its log frequency in each language; an unseen word by its longest known character n-grams,
progressively shorter ones. Characters of scripts without spaces are words of one character. The word counts are
trained on a bounded sample of the documents' own labels in two rounds: the second counts the sample's texts under the
language that the first one gives them, which takes out wrong labels. A few function words per language are fixed
prior counts, so that a language that is rare in the sample is still known.

Each sentence gets the best language if it beats the document's main one clearly, else the main one. The main language
is that of most whole sentences. Confidence is the posterior of the language over the part's words, damped because
words of one text are not independent.

Defined results: NULL, blank and symbol-only texts have no language and no segment; long texts are processed whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.leaks import BATCH_CHARS
from palimpsest.llm.tokens import slices, tokenize

LANGUAGES = ("zh", "en", "ja", "fr", "de", "es", "pt", "ru")
MISSING = ("", "und", "unknown")

# Frequent function words.
FUNCTION_WORDS = {
    "zh": "的 了 是 在 不 我 他 她 这 那 们 你 说 也 就 都 而 与 被 把 从 向 为 之 着 过 却 还 又 已",
    "en": "the of and to in a was that he she it his her had with for as at on by not but from they which said were when",
    "ja": "の は に を た が て と で し も い な ら か れ さ っ る り ん こ そ だ き け よ ま す ア イ ン ス ト ル ラ リ",
    "fr": "le la les de des du et un une que qui dans il elle ne pas sur avec pour se au ce était avait sans mais plus par",
    "de": "der die das und in zu den von mit ist nicht ein eine sich auf dem des es war hatte als wie nur aber noch im an",
    "es": "el la los las de del y en que un una no se por con su para al lo como más pero sin había era cuando sobre fue",
    "pt": "o a os as de do da dos das e em que um uma não se por com para ao no na mais mas como foi era havia sem quando",
    "ru": "и в не на что он она с как а то его но к это по из у за от так же ее был была было только о бы когда",
}
PRIOR = 200

#: Documents of each label in the training sample, and words of each language that are kept.
SAMPLE, WORDS = 400, 8000
LONGEST_NGRAM = 4
#: A sentence leaves the main language if another one is better by this many nats.
MARGIN = 8.0


def label_language(label: Column) -> Column:
    """The language that a label names, NULL for a missing label."""
    code = F.lower(F.trim(F.regexp_extract(label, r"^\s*([^-_]*)", 1)))
    return F.when(label.isNotNull() & ~F.trim(F.lower(label)).isin(*MISSING), code)


class Model:
    """Log frequencies of words and character n-grams by language."""

    def __init__(self, counts: dict[str, Counter]):
        counts = {lang: counts.get(lang, Counter()) + Counter({w: PRIOR for w in words.split()}) for lang, words in FUNCTION_WORDS.items()}
        self.words = sorted({w for c in counts.values() for w in c})
        table = np.array([[counts[lang][w] for lang in LANGUAGES] for w in self.words], np.float64)
        self.scores = self._logs(table)
        grams: dict[str, np.ndarray] = {}
        for word, row in zip(self.words, np.log1p(table), strict=True):
            for n in range(1, LONGEST_NGRAM + 1):
                for g in self.ngrams(word, n):
                    grams[g] = grams[g] + row if g in grams else row
        names = sorted(grams)
        self.grams = {g: i for i, g in enumerate(names)}
        by_n = np.array([len(g) for g in names])
        rows = np.array([grams[g] for g in names])
        self.gram_scores = np.zeros(rows.shape, np.float32)
        for n in range(1, LONGEST_NGRAM + 1):
            self.gram_scores[by_n == n] = self._logs(rows[by_n == n])
        self.index = None
        self.seen: dict[int, np.ndarray] = {}

    @staticmethod
    def _logs(table: np.ndarray) -> np.ndarray:
        logs = np.log((table + 0.5) / (table.sum(0) + 0.5 * len(table)))
        return np.clip(logs - logs.max(1, keepdims=True), -8, 0).astype(np.float32)

    @staticmethod
    def ngrams(word: str, n: int) -> list[str]:
        word = f"^{word}$"
        return [word[i : i + n] for i in range(len(word) - n + 1) if word[i : i + n] not in ("^", "$")]

    def unseen(self, word: str) -> np.ndarray:
        """Score of a word outside the table: the mean over its longest known n-grams."""
        for n in range(LONGEST_NGRAM, 0, -1):
            known = [self.grams[g] for g in self.ngrams(word[:60], n) if g in self.grams]
            if known:
                return self.gram_scores[known].mean(0)
        return np.zeros(len(LANGUAGES), np.float32)

    def rows(self, texts: list[str | None], tokens) -> np.ndarray:
        """Score of every token of the texts by language."""
        if self.index is None:
            own = tokenize(self.words)
            first = np.flatnonzero(np.diff(own.bounds()) == 1)
            hashes = own.hash[own.bounds()[:-1][first]]
            order = np.argsort(hashes)
            self.index = hashes[order], first[order]
        hashes, at = self.index
        unique, where, inverse = np.unique(tokens.hash, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(hashes, unique), len(hashes) - 1)
        known = hashes[place] == unique
        table = np.zeros((len(unique), len(LANGUAGES)), np.float32)
        table[known] = self.scores[at[place[known]]]
        for i in np.flatnonzero(~known):
            key = int(unique[i])
            if key not in self.seen:
                t = where[i]
                if len(self.seen) > 500_000:
                    self.seen.clear()
                self.seen[key] = self.unseen(texts[tokens.doc[t]][tokens.start[t] : tokens.end[t]].lower())
            table[i] = self.seen[key]
        return table[inverse]


_ENDS = np.zeros(0x110000, np.uint8)
_ENDS[[ord(c) for c in "。！？!?…"]] = 1
_ENDS[[ord("\n"), ord("\r"), 0]] = 2
_CLOSERS = [ord(c) for c in " \t\n\r\x00\"'”’»」』）)"]


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places where sentences end, whether a mark ends them, where each text begins) over the joined texts."""
    points = np.frombuffer("\x00".join([*(t.replace("\x00", " ") for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _ENDS[points]
    stops = np.flatnonzero(points == ord("."))
    stops = stops[np.isin(points[np.minimum(stops + 1, len(points) - 1)], _CLOSERS)]
    kind[stops] = 1
    ends = np.flatnonzero(kind)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    return ends, kind[ends] == 1, begins


def analyse(model: Model, texts: list[str]):
    """Per text: list of (start, end, whole, language number, log posterior row) of its sentences with words."""
    tokens = tokenize(texts)
    out: list[list] = [[] for _ in texts]
    if not len(tokens.hash):
        return out
    ends, marked, begins = sentences(texts)
    place = begins[tokens.doc] + tokens.start
    sentence = np.searchsorted(ends, place, side="left")
    rows = model.rows(texts, tokens)
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    sums = np.add.reduceat(rows.astype(np.float64), first, axis=0)
    number, doc, start = sentence[first], tokens.doc[first], tokens.start[first]
    last = np.append(first[1:], len(place)) - 1
    sizes = np.diff(np.append(first, len(place)))
    end = np.minimum(ends[np.minimum(number, len(ends) - 1)] - begins[doc] + 1, [len(texts[d]) for d in doc])
    end = np.maximum(end, tokens.end[last])
    whole = marked[np.minimum(number, len(ends) - 1)]
    # A headline or a number is no sentence; nor is a run of one or two words.
    for d, s, e, w, row, n in zip(doc.tolist(), start.tolist(), end.tolist(), whole.tolist(), sums, sizes.tolist(), strict=True):
        out[d].append((s, e, w and n >= 3, row))
    return out


def decide(found: list) -> tuple[int, list[int]]:
    """Main language of a text and the language of each of its sentences."""
    best = [int(row.argmax()) for *_, row in found]
    weight = np.zeros(len(LANGUAGES))
    for (s, e, whole, _), b in zip(found, best, strict=True):
        weight[b] += (1.0 if whole else 0.0) + (e - s) * 1e-6
    total = sum(row for *_, row in found)
    # Sentences that are undecided between two languages go with the whole text.
    main = int(weight.argmax())
    tied = [i for i in range(len(LANGUAGES)) if weight[i] >= 0.8 * weight[main]]
    if len(tied) > 1:
        main = max(tied, key=lambda i: total[i])
    return main, [b if row[b] - row[main] >= MARGIN else main for b, (*_, row) in zip(best, found, strict=True)]


def confidence(row: np.ndarray, chosen: int, chars: int) -> float:
    """Posterior of a language; the evidence counts like its square root, as words of one text aren't independent."""
    x = np.exp((row - row.max()) / max(1, chars) ** 0.5)
    return float(x[chosen] / x.sum())


def _count_words(docs: DataFrame, model: Model | None) -> dict[str, Counter]:
    """Counts of the most frequent words of each language; the kept words bound what reaches the driver."""

    def count(batches):
        for batch in batches:
            counts: dict[str, Counter] = {}
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, BATCH_CHARS):
                part = texts[a:b]
                if model is None:
                    tokens = tokenize(part)
                    for d, s, e in zip(tokens.doc.tolist(), tokens.start.tolist(), tokens.end.tolist(), strict=True):
                        counts.setdefault(labels[a + d], Counter())[part[d][s:e].lower()] += 1
                else:
                    for text, found in zip(part, analyse(model, part), strict=True):
                        if not found:
                            continue
                        main, each = decide(found)
                        for (s, e, *_), lang in zip(found, each, strict=True):
                            own = tokenize([text[s:e]])
                            counts.setdefault(LANGUAGES[lang], Counter()).update(text[s + x : s + y].lower() for x, y in zip(own.start.tolist(), own.end.tolist(), strict=True))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    counted = docs.select("text", "label").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    out: dict[str, Counter] = {}
    for row in counted.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= WORDS).toLocalIterator():
        out.setdefault(row.lang, Counter())[row.word] = row.n
    return out


def train(docs: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` documents of each label; the sample doesn't grow with the data."""
    labelled = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), label_language(F.col(label)).alias("label"))
    labelled = labelled.filter(F.col("label").isin(*LANGUAGES))
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("label") == lang) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(min(1.0, sample / n) * 1_000_000)))
    picked = labelled.filter(chosen)
    return Model(_count_words(picked, Model(_count_words(picked, None))))


def with_languages(docs: DataFrame, key: str, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(key, keep.., lang, main, sentences, chars, confidence): a row per language of each text with words."""
    return _scan(docs, key, text, model, keep or [], by_segment=False)


def language_segments(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, segment, start, end, lang, confidence): the stretches of one language of each text."""
    return _scan(docs, key, text, model, [], by_segment=True)


def _scan(docs: DataFrame, key: str, text: str, model: Model, keep: list[str], by_segment: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("segment", "int"), ("start", "int"), ("end", "int"), ("lang", "string"), ("confidence", "double")]
    if not by_segment:
        fields = [("lang", "string"), ("main", "boolean"), ("sentences", "int"), ("chars", "int"), ("confidence", "double")]
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}

    def scan(batches):
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            at, rows = [], []
            for a, b in slices(texts, BATCH_CHARS):
                for i, found in enumerate(analyse(own, texts[a:b]), a):
                    if found:
                        new = (_segments if by_segment else _languages)(found)
                        at += [i] * len(new)
                        rows += new
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
            taken = [c.take(pa.array(at, pa.int32())) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields, strict=True))], [key, *keep, *(f for f, _ in fields)])

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep)), *(f"`{f}` {t}" for f, t in fields)])
    return docs.filter(F.col(text).isNotNull()).select(text, key, *keep).mapInArrow(scan, kinds)


def _languages(found: list) -> list[tuple]:
    main, each = decide(found)
    out = []
    for lang in sorted(set(each), key=lambda x: x != main):
        own = [f for f, x in zip(found, each, strict=True) if x == lang]
        chars = sum(f[1] - f[0] for f in own)
        out.append((LANGUAGES[lang], lang == main, sum(f[2] for f in own), chars, confidence(sum(f[3] for f in own), lang, chars)))
    return out


def _segments(found: list) -> list[tuple]:
    _, each = decide(found)
    out: list[list] = []
    for (s, e, _, row), lang in zip(found, each, strict=True):
        if out and out[-1][2] == lang:
            out[-1][1], out[-1][3] = e, out[-1][3] + row
        else:
            out.append([s, e, lang, row])
    return [(i, s, e, LANGUAGES[lang], confidence(row, lang, e - s)) for i, (s, e, lang, row) in enumerate(out, 1)]
