"""Document metrics: readability, texture, templates, polarity arcs, density and noise, as JVM-side expressions.

Ratios come out in ten-thousandths (basis points), as whole numbers, so that results don't depend on rounding modes.
Defined results: NULL and blank texts have no row.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.packs import NOVEL, LanguagePack
from palimpsest.functions.text import count_present, normalize_newlines, occurrences, strip, total_occurrences
from palimpsest.operators.segment import sentences


def basis_points(part: Column, whole: Column) -> Column:
    """``part / whole`` in ten-thousandths, rounded down; 0 for an empty whole."""
    return F.when(whole > 0, F.floor(part * 10000 / whole)).otherwise(0).cast("bigint")


def quoted_length(text: Column, pack: LanguagePack = NOVEL) -> Column:
    """Characters inside quotes, the marks included."""
    pattern = "|".join(f"{a}[^{b}]*{b}" for a, b in pack.quotes)
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def readable(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__t", normalize_newlines(F.col(text))).filter(F.col("__t").rlike(r"\S"))


def readability(df: DataFrame, key: str, text: str, pack: LanguagePack = NOVEL) -> DataFrame:
    """Sentence and line lengths, dialogue, connectives, and an index of six parts (100 at best) with a grade."""
    lengths = F.transform(sentences(F.col("__t"), pack), lambda s: F.length(strip(s)))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"\S"))
    connectives = reduce(add, (total_occurrences(F.col("__t"), words) for words in pack.connectives.values()))
    base = readable(df, text).select(
        key,
        F.length("__t").alias("n_chars"),
        F.filter(lengths, lambda n: n > 0).alias("l"),
        F.size(lines).alias("n_lines"),
        quoted_length(F.col("__t"), pack).alias("quoted"),
        connectives.alias("connectives"),
        F.size(F.array_distinct(F.split("__t", ""))).alias("n_unique"),
    )
    sums = base.select(
        key,
        "n_chars",
        F.size("l").alias("n_sentences"),
        F.aggregate("l", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("sum_len"),
        F.aggregate("l", F.lit(0).cast("bigint"), lambda a, n: a + n * n).alias("sum_sq"),
        F.size(F.filter("l", lambda n: n > 60)).alias("n_long"),
        "n_lines",
        basis_points(F.col("quoted"), F.col("n_chars")).alias("dialogue_bp"),
        basis_points(F.col("connectives"), F.col("n_chars")).alias("connective_bp"),
        basis_points(F.col("n_unique"), F.col("n_chars")).alias("unique_bp"),
    ).filter("n_sentences > 0")
    mean = F.col("sum_len") / F.col("n_sentences")
    variance = (F.col("n_sentences") * F.col("sum_sq") - F.col("sum_len") * F.col("sum_len")) / F.greatest(F.col("n_sentences") * (F.col("n_sentences") - 1), F.lit(1))
    stats = sums.select("*", F.floor(mean * 100).cast("bigint").alias("mean_x100"), F.floor(F.sqrt(variance) * 100).cast("bigint").alias("std_x100"), F.floor(F.col("n_chars") * 100 / F.col("n_lines")).cast("bigint").alias("line_x100"))

    def clamp(value: Column, most: float) -> Column:
        return F.least(F.lit(most), F.greatest(F.lit(0.0), value))

    parts = (
        clamp((35 - F.abs(F.col("mean_x100") / 100 - 28)) / 35 * 25, 25.0),
        clamp((20 - F.least(F.col("std_x100") / 100, F.lit(20.0))) / 20 * 15, 15.0),
        clamp((1 - F.abs(F.col("dialogue_bp") / 10000 - 0.35) / 0.65) * 20, 20.0),
        clamp((200 - F.abs(F.col("line_x100") / 100 - 200)) / 200 * 15, 15.0),
        F.when(F.col("connective_bp").between(5, 20), 15.0).when(F.col("connective_bp") < 5, F.col("connective_bp") / 5 * 15).otherwise(clamp(15 - (F.col("connective_bp") - 20) / 10 * 15, 15.0)),
        F.when(F.col("unique_bp").between(800, 2000), 10.0).when(F.col("unique_bp") < 800, F.col("unique_bp") / 800 * 10).otherwise(clamp(10 - (F.col("unique_bp") - 2000) / 1000 * 10, 10.0)),
    )
    index = F.floor(reduce(add, parts) * 10 + 0.5).cast("bigint")
    scored = stats.withColumn("index_x10", index)
    grade = F.when(F.col("index_x10") >= 800, "easy").when(F.col("index_x10") >= 600, "normal").when(F.col("index_x10") >= 400, "patient").otherwise("hard")
    size = F.when(F.col("n_chars") >= 100_000, "high").when(F.col("n_chars") >= 30_000, "medium").otherwise("low")
    return scored.select(key, "n_sentences", "mean_x100", "std_x100", "n_long", "dialogue_bp", "connective_bp", "unique_bp", "index_x10", grade.alias("grade"), size.alias("confidence"))


# Marks between the sentences whose mean length the writing score looks at.
SENTENCE = r"[^。！？!?…\s\x{3000}](?:[^。！？!?…]*[^。！？!?…\s\x{3000}])?"


def texture(df: DataFrame, key: str, text: str, pack: LanguagePack = NOVEL) -> DataFrame:
    """Template words, dialogue, exclamations, ellipses and mean sentence length, and the writing and emotion scores (x10)."""
    t = F.col("__t")
    words = [w for group in pack.templates.values() for w in group]
    # Sentences without the white space around them; those of one or two characters don't count.
    lengths = F.filter(F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), F.length), lambda n: n > 2)
    sized = readable(df, text).withColumn("__n", lengths)
    rows = sized.select(
        key,
        F.when(F.size("__n") > 0, F.floor(F.aggregate("__n", F.lit(0), lambda a, n: a + n) * 10 / F.size("__n") + 0.5)).otherwise(0).cast("bigint").alias("sentence_x10"),
        basis_points(total_occurrences(t, words), F.length(t)).alias("template_bp"),
        basis_points(quoted_length(t, pack), F.length(t)).alias("dialogue_bp"),
        basis_points(F.regexp_count(t, F.lit("[！!]")), F.length(t)).alias("exclaim_bp"),
        basis_points(F.regexp_count(t, F.lit("…{2,}|。{3,}|\\.{3,}")), F.length(t)).alias("ellipsis_bp"),
        F.when(F.length(t) > 100, basis_points(F.size(F.array_distinct(F.split(t, ""))), F.length(t))).otherwise(0).cast("bigint").alias("unique_bp"),
    )
    density, unique, exclaim = F.col("template_bp"), F.col("unique_bp"), F.col("exclaim_bp")
    writing = 70 + F.when(density > 30, -25).when(density > 15, -15).when(density > 8, -8).when(density < 3, 5).otherwise(0) + F.when(unique > 2500, 5).when(unique < 1200, -10).otherwise(0)
    writing = writing + F.when(F.col("sentence_x10") > 500, -8).when(F.col("sentence_x10").between(150, 400), 3).otherwise(0)
    emotion = 60 + F.when(exclaim.between(5, 25), 15).when(exclaim > 40, -10).when(exclaim < 2, -5).otherwise(0) + F.when(density > 20, -10).otherwise(0)
    return rows.select("*", F.least(F.lit(100), F.greatest(F.lit(10), writing)).alias("writing_x10"), F.least(F.lit(100), F.greatest(F.lit(10), emotion)).alias("emotion_x10"))


def template_hits(df: DataFrame, key: str, text: str, pack: LanguagePack = NOVEL, least: int = 1) -> DataFrame:
    """(key, category, phrase, hits) of the template phrases that occur."""
    pairs = [(c, w) for c, words in pack.templates.items() for w in words]
    hits = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(w).alias("phrase"), occurrences(F.col("__t"), w).alias("hits")) for c, w in pairs))
    rows = readable(df, text).select(key, F.explode(F.filter(hits, lambda h: h.hits >= least)).alias("h"))
    return rows.select(key, "h.category", "h.phrase", "h.hits")


def polarity_segments(df: DataFrame, key: str, text: str, segments: int = 5, pack: LanguagePack = NOVEL) -> DataFrame:
    """(key, segment from 0, positive, negative, polarity_bp) of equal pieces of each text."""
    t = F.col("__t")
    size = F.ceil(F.length(t) / segments).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.substring(t, i * size + 1, size))
    rows = readable(df, text).select(key, F.posexplode(pieces).alias("segment", "piece"))
    rows = rows.select(key, "segment", total_occurrences(F.col("piece"), pack.positive).alias("positive"), total_occurrences(F.col("piece"), pack.negative).alias("negative"))
    both = F.col("positive") + F.col("negative")
    polarity = F.when(both > 0, F.floor((F.col("positive") - F.col("negative")) * 10000 / both)).otherwise(0).cast("bigint")
    return rows.withColumn("polarity_bp", polarity)


def arc_class(segments: DataFrame, key: str, count: int = 5) -> DataFrame:
    """The shape of the polarity over a text by the means of its thirds, and its extremes (first on ties)."""
    third = count // 3
    i, p = F.col("segment"), F.col("polarity_bp")
    means = segments.groupBy(key).agg(
        F.sum(F.when(i < third, p)).alias("a"),
        F.sum(F.when((i >= third) & (i < 2 * third), p)).alias("b"),
        F.sum(F.when(i >= 2 * third, p)).alias("c"),
        F.max_by("segment", F.struct("polarity_bp", -i)).alias("best_segment"),
        F.min_by("segment", F.struct("polarity_bp", "segment")).alias("worst_segment"),
    )
    a, b, c = F.col("a") * (count - 2 * third), F.col("b") * (count - 2 * third), F.col("c") * third
    step = 500 * third * (count - 2 * third)
    shape = (
        F.when((b > a + step) & (c > b + step), "rise")
        .when((b < a - step) & (c < b - step), "fall")
        .when((a > b) & (b < c) & (a > c), "oedipus")
        .when((a < b) & (b > c) & (a < c), "cinderella")
        .when((a > b) & (b < c), "man_in_hole")
        .when((a < b) & (b > c), "icarus")
        .otherwise("flat")
    )
    return means.select(key, shape.alias("arc"), "best_segment", "worst_segment")


def density_level(df: DataFrame, key: str, text: str, pack: LanguagePack = NOVEL) -> DataFrame:
    """How eventful a text is: distinct dense words doubled plus punctuation, against calm words."""
    t = F.col("__t")
    marks = reduce(add, (occurrences(t, m) for m in "！？。；"))
    rows = readable(df, text).select(key, F.length(t).alias("n_chars"), count_present(t, pack.dense).alias("n_dense"), count_present(t, pack.calm).alias("n_calm"), F.floor(marks / 80).cast("int").alias("marks"))
    score = F.col("n_dense") * 2 + F.least(F.lit(4), F.col("marks"))
    scored = rows.withColumn("score", score)
    level = F.when((F.col("score") >= 6) | (F.col("n_dense") >= 3), "high").when((F.col("score") <= 1) & (F.col("n_calm") >= 2), "low").when((F.col("n_chars") < 1200) & (F.col("score") == 0) & (F.col("n_calm") >= 1), "low").otherwise("medium")
    return scored.select(key, "n_dense", "n_calm", "score", level.alias("level"))


def noise_flags(df: DataFrame, key: str, text: str) -> DataFrame:
    """Control, replacement and NUL characters, long lines, and the severity they amount to."""
    t = F.col(text)
    longest = F.array_max(F.transform(F.split(normalize_newlines(t), "\n"), F.length))
    rows = df.filter(t.isNotNull()).select(
        key,
        F.regexp_count(t, F.lit("[\\x{1}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}]")).alias("n_control"),
        F.regexp_count(t, F.lit("\\x{fffd}")).alias("n_replaced"),
        F.regexp_count(t, F.lit("\r")).alias("n_returns"),
        longest.alias("longest_line"),
        F.length(t).alias("n_chars"),
    )
    bad = F.col("n_control") + F.col("n_replaced")
    severity = F.when(F.col("n_chars") == 0, "empty").when(bad * 100 > F.col("n_chars"), "high").when((bad > 0) | (F.col("longest_line") > 5000), "medium").when(F.col("n_returns") > 0, "low").otherwise("none")
    return rows.select(key, "n_control", "n_replaced", "n_returns", "longest_line", severity.alias("severity"))


def genre_scores(df: DataFrame, key: str, text: str, pack: LanguagePack = NOVEL, extra: int = 3) -> DataFrame:
    """(key, genre, score): a word's weight once, plus up to ``extra - 1`` more for heavy words that recur."""
    lexicon = [(g, w, weight) for g, words in pack.genres.items() for w, weight in words.items()]
    entries = F.array(*(F.struct(F.lit(g).alias("genre"), F.lit(w).alias("word"), F.lit(weight).alias("weight")) for g, w, weight in lexicon))

    def counted(e: Column) -> Column:
        n = (F.length("l") - F.length(F.replace("l", e.word, F.lit("")))) / F.length(e.word)
        return F.struct(e.genre.alias("genre"), e.weight.alias("weight"), n.cast("int").alias("n"))

    # The words that occur are found before rows are made of them, so that no text is copied.
    rows = readable(df, text).select(key, F.lower("__t").alias("l"))
    rows = rows.select(key, F.explode(F.filter(F.transform(entries, counted), lambda e: e.n > 0)).alias("e")).select(key, "e.genre", "e.weight", "e.n")
    more = F.when((F.col("weight") >= 3) & (F.col("n") >= 3), F.least(F.lit(extra), F.col("n") - 1)).otherwise(0)
    return rows.groupBy(key, "genre").agg(F.sum(F.col("weight") + more).alias("score"))
