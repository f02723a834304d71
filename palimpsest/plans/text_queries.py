"""Queries over documents: segmentation, readability, texture, polarity, density, noise, genres."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.packs import NOVEL
from palimpsest.functions.text import ngrams, normalize_newlines, strip, text_hash, token_estimate, unnegated_occurrences
from palimpsest.operators import metrics, segment
from palimpsest.plans.shared import spread
from palimpsest.sources import table

MARKS = NOVEL.terminators
#: DuckDB: the text with plain line breaks, and its sentences.
T = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
STRIP = "regexp_replace(s, '^[ \\t\u3000]+|[ \\t\u3000]+$', '', 'g')"
BLANK = "regexp_matches(text, '\\S')"
SENTENCES = f"list_filter(regexp_extract_all({T}, '[^{MARKS}\\n]*[{MARKS}]+|[^{MARKS}\\n]+'), lambda s: regexp_matches(s, '[^ \\t\\n\\r\\f\\v]'))"


def _docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


def _count(t: str, words) -> str:
    return " + ".join(f"(length({t}) - length(replace({t}, '{w}', ''))) // {len(w)}" for w in words)


def _present(t: str, words) -> str:
    return " + ".join(f"contains({t}, '{w}')::int" for w in words)


def newline_normalize_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = normalize_newlines(F.col("text"))
    lines = F.size(F.split(t, "\n", -1))
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.length("text").alias("n_before"), F.length(t).alias("n_after"), lines.alias("n_lines"))


def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.line_spans(_docs(spark, sf_dir), "doc_id", "text")


def sentence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.posexplode(segment.sentences(F.col("text"))).alias("no", "sentence"))
    return rows.select("doc_id", (F.col("no") + 1).alias("sent_no"), F.length("sentence").alias("n_chars"), F.md5("sentence").alias("sentence_md5"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform(segment.sentences(F.col("text")), F.length)
    rows = _docs(spark, sf_dir).filter("text is not null").select("doc_id", lengths.alias("l")).filter(F.size("l") > 0)
    return rows.select("doc_id", F.size("l").alias("n_sentences"), F.array_max("l").alias("longest"), F.array_min("l").alias("shortest"), F.aggregate("l", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("total"))


def ngram_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 most frequent 2- and 3-grams of the passages (a top-k report), ties by term."""
    bare = F.regexp_replace(F.lower("passage"), r"[\s\p{P}]+", "")
    rows = table(spark, sf_dir, "eval_passages").select(bare.alias("p"))
    both = rows.select(F.explode(F.concat(ngrams(F.col("p"), 2), ngrams(F.col("p"), 3))).alias("term"))
    return both.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(200)


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunk_table(_docs(spark, sf_dir), "doc_id", "text", "fixed", 1000, 100)


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole books, chunk texts in order, cut at chapters."""
    return segment.book_chunk_table(table(spark, sf_dir, "documents"), "book_id", "chunk_idx", "text", 2000, 200)


def length_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunk_table(_docs(spark, sf_dir), "doc_id", "text", "length", 600).select("doc_id", "chunk_index", "core_start", "core_end")


def halving_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunk_table(_docs(spark, sf_dir), "doc_id", "text", "halves").select("doc_id", "chunk_index", "core_start", "core_end")


def chapter_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin a chapter, with the number of characters before them on the page."""
    lines = F.split(normalize_newlines(F.col("text")), "\n", -1)
    rows = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.posexplode(lines).alias("no", "line"))
    title = F.regexp_replace("line", r"^[ \t　]+|[ \t　]+$", "")
    return rows.select("doc_id", (F.col("no") + 1).alias("line_no"), title.alias("title")).filter(F.col("title").rlike(f"^{NOVEL.heading}"))


def readability_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.readability(_docs(spark, sf_dir), "doc_id", "text")


def text_texture_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.texture(_docs(spark, sf_dir), "doc_id", "text")


def template_phrase_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.template_hits(_docs(spark, sf_dir), "doc_id", "text", least=2)


def template_phrase_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = metrics.template_hits(_docs(spark, sf_dir), "doc_id", "text")
    return hits.groupBy("category", "phrase").agg(F.sum("hits").alias("hits"), F.count("*").alias("documents"))


def lexicon_polarity_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.polarity_segments(_docs(spark, sf_dir), "doc_id", "text")


def polarity_arc_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.arc_class(metrics.polarity_segments(_docs(spark, sf_dir), "doc_id", "text"), "doc_id")


def density_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.density_level(_docs(spark, sf_dir), "doc_id", "text")


def encoding_noise_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.noise_flags(_docs(spark, sf_dir), "doc_id", "text")


NEGATABLE = ("肯相信", "认领", "forgive", "left")


def keyword_hits_negation_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = normalize_newlines(F.col("text"))
    hits = F.array(*(F.struct(F.lit(w).alias("word"), F.regexp_count(t, F.lit(re.escape(w))).alias("hits"), unnegated_occurrences(t, w, NOVEL.negations).alias("plain_hits")) for w in NEGATABLE))
    rows = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.word", "h.hits", "h.plain_hits")
    return rows.filter("hits > 0")


def genre_inference_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked genres of each book with a calibrated confidence in per cent, from all its chunks."""
    scores = metrics.genre_scores(_docs(spark, sf_dir, "book_id"), "doc_id", "text")
    books = table(spark, sf_dir, "documents").select("doc_id", "book_id")
    total = scores.join(books, "doc_id").groupBy("book_id", "genre").agg(F.sum("score").alias("score")).filter("score >= 6")
    w = Window.partitionBy("book_id").orderBy(F.desc("score"), "genre")
    ranked = total.select("*", F.row_number().over(w).alias("rank"), F.first("score").over(w).alias("top"), F.coalesce(F.lead("score").over(w), F.lit(0)).alias("next"))
    confidence = F.least(F.lit(95), F.floor(35 + 45 * F.col("score") / F.col("top") + 20 * (F.col("score") - F.col("next")) / F.col("score")).cast("bigint"))
    return ranked.select("book_id", "genre", "score", "rank", confidence.alias("confidence"))


def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once, by content hash: the kept document and the number of copies."""
    rows = _docs(spark, sf_dir).filter("text is not null").select("doc_id", text_hash(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1")


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "book_id").filter("text is not null").select("book_id", token_estimate(F.col("text"), 100).alias("n"))
    return rows.groupBy("book_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("chunks"))


def passage_sentence_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain whole sentences of passages: a semi-join on sentence hashes, never a scan per pair."""
    passages = table(spark, sf_dir, "eval_passages").select("item_id", F.explode(segment.sentences(F.col("passage"))).alias("s"))
    keys = passages.filter(F.length(strip(F.col("s"))) >= 12).select("item_id", F.md5(strip(F.col("s"))).alias("h")).distinct()
    docs = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.explode(segment.sentences(F.col("text"))).alias("s"))
    hashed = docs.select("doc_id", F.md5(strip(F.col("s"))).alias("h")).distinct()
    return hashed.join(keys, "h").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


QUERIES = {
    f.__name__: f
    for f in (
        newline_normalize_lengths,
        paragraph_spans,
        sentence_explode,
        sentence_stats,
        ngram_top_terms,
        fixed_chunks,
        semantic_chunks,
        length_chunks,
        halving_split,
        chapter_headings,
        readability_profile,
        text_texture_metrics,
        template_phrase_density,
        template_phrase_global,
        lexicon_polarity_by_segment,
        polarity_arc_class,
        density_level,
        encoding_noise_flags,
        keyword_hits_negation_aware,
        genre_inference_rank,
        content_hash_dedup,
        token_estimates,
        passage_sentence_reuse,
    )
}

_SPACE = " || ".join(f"chr({ord(c)})" for c in map(chr, range(1, 0x3001)) if c.isspace())
_WORDS = [w for group in NOVEL.templates.values() for w in group]
_PAIRS = [(c, w) for c, group in NOVEL.templates.items() for w in group]
_CONNECTIVES = [w for group in NOVEL.connectives.values() for w in group]
_QUOTES = "|".join(f"{a}[^{b}]*{b}" for a, b in NOVEL.quotes)
_DOCS = f"(SELECT doc_id, book_id, {T} AS t FROM documents WHERE {BLANK})"
_SEGMENTS = f"""
  SELECT doc_id, i AS segment,
    {_count("p", NOVEL.positive)} AS positive, {_count("p", NOVEL.negative)} AS negative
  FROM (SELECT doc_id, i, substring(t, i * z + 1, z) AS p
        FROM (SELECT doc_id, t, CAST(ceil(length(t) / 5) AS INT) AS z FROM {_DOCS}), (SELECT unnest(range(5))::INT AS i))
"""
_POLARITY = f"""
  SELECT *, CASE WHEN positive + negative > 0
    THEN CAST(floor((positive - negative) * 10000 / (positive + negative)) AS BIGINT) ELSE 0 END AS polarity_bp
  FROM ({_SEGMENTS})
"""
_HIT_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, '{w}' AS phrase, {_count('t', [w])} AS hits FROM d" for c, w in _PAIRS)


def _genre(words: dict[str, int]) -> str:
    parts = []
    for w, weight in words.items():
        n = f"({_count('l', [w])})"
        more = f" + CASE WHEN {n} >= 3 THEN least(3, {n} - 1) ELSE 0 END" if weight >= 3 else ""
        parts.append(f"CASE WHEN {n} > 0 THEN {weight}{more} ELSE 0 END")
    return " + ".join(parts)


_GENRE_ROWS = " UNION ALL ".join(f"SELECT doc_id, book_id, '{g}' AS genre, {_genre(words)} AS score FROM d" for g, words in NOVEL.genres.items())

SQL = {
    "newline_normalize_lengths": f"""SELECT doc_id, length(text) AS n_before, length({T}) AS n_after,
        len(string_split({T}, chr(10))) AS n_lines FROM documents WHERE text IS NOT NULL""",
    "paragraph_spans": f"""
        WITH l AS (SELECT doc_id, unnest(string_split({T}, chr(10))) AS line,
                          generate_subscripts(string_split({T}, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
        o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l)
        SELECT doc_id, no::INT AS para_no, s::INT AS start, (s + length(line))::INT AS "end" FROM o
        WHERE length(trim(line, chr(32) || chr(9) || chr(11) || chr(12))) > 0""",
    "sentence_explode": f"""
        SELECT doc_id, no::INT AS sent_no, length(s) AS n_chars, md5(s) AS sentence_md5
        FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS no FROM (SELECT doc_id, {SENTENCES} AS l FROM documents WHERE text IS NOT NULL))""",
    "sentence_stats": f"""
        SELECT doc_id, len(l) AS n_sentences, list_max(l) AS longest, list_min(l) AS shortest, list_sum(l)::BIGINT AS total
        FROM (SELECT doc_id, list_transform({SENTENCES}, lambda s: length(s)) AS l FROM documents WHERE text IS NOT NULL) WHERE len(l) > 0""",
    "ngram_top_terms": """
        WITH p AS (SELECT regexp_replace(lower(passage), '[\\s\\p{P}]+', '', 'g') AS p FROM eval_passages),
        g AS (SELECT substring(p, i::INT, 2) AS term FROM p, unnest(range(1, length(p))) r(i)
              UNION ALL SELECT substring(p, i::INT, 3) FROM p, unnest(range(1, length(p) - 1)) r(i))
        SELECT term, count(*) AS n FROM g GROUP BY term ORDER BY n DESC, term LIMIT 200""",
    "chapter_headings": f"""
        WITH l AS (SELECT doc_id, unnest(string_split({T}, chr(10))) AS line,
                          generate_subscripts(string_split({T}, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
        h AS (SELECT doc_id, no::INT AS line_no, regexp_replace(line, '^[ \\t　]+|[ \\t　]+$', '', 'g') AS title FROM l)
        SELECT * FROM h WHERE regexp_matches(title, '^{NOVEL.heading}')""",
    "readability_profile": f"""
        WITH b AS (SELECT doc_id, t, list_filter(list_transform({SENTENCES.replace(T, "t")}, lambda s: length({STRIP})), lambda n: n > 0) AS l FROM {_DOCS}),
        s AS (SELECT doc_id, length(t) AS n_chars, len(l) AS n_sentences, list_sum(l)::BIGINT AS sum_len,
                list_sum(list_transform(l, lambda n: n * n))::BIGINT AS sum_sq, len(list_filter(l, lambda n: n > 60)) AS n_long,
                len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS n_lines,
                (length(t) - length(regexp_replace(t, '{_QUOTES}', '', 'g'))) * 10000 // length(t) AS dialogue_bp,
                ({_count("t", _CONNECTIVES)}) * 10000 // length(t) AS connective_bp,
                len(list_distinct(regexp_extract_all(t, '(?s).'))) * 10000 // length(t) AS unique_bp
              FROM b WHERE len(l) > 0),
        x AS (SELECT *, CAST(floor(sum_len / n_sentences * 100) AS BIGINT) AS mean_x100,
                CAST(floor(sqrt((n_sentences * sum_sq - sum_len * sum_len) / greatest(n_sentences * (n_sentences - 1), 1)) * 100) AS BIGINT) AS std_x100,
                CAST(floor(n_chars * 100 / n_lines) AS BIGINT) AS line_x100 FROM s),
        i AS (SELECT *, CAST(floor((
                least(25::DOUBLE, greatest(0::DOUBLE, (35 - abs(mean_x100 / 100 - 28)) / 35 * 25))
                + least(15::DOUBLE, greatest(0::DOUBLE, (20 - least(std_x100 / 100, 20::DOUBLE)) / 20 * 15))
                + least(20::DOUBLE, greatest(0::DOUBLE, (1 - abs(dialogue_bp / 10000 - 0.35::DOUBLE) / 0.65::DOUBLE) * 20))
                + least(15::DOUBLE, greatest(0::DOUBLE, (200 - abs(line_x100 / 100 - 200)) / 200 * 15))
                + CASE WHEN connective_bp BETWEEN 5 AND 20 THEN 15::DOUBLE WHEN connective_bp < 5 THEN connective_bp / 5 * 15
                       ELSE least(15::DOUBLE, greatest(0::DOUBLE, 15 - (connective_bp - 20) / 10 * 15)) END
                + CASE WHEN unique_bp BETWEEN 800 AND 2000 THEN 10::DOUBLE WHEN unique_bp < 800 THEN unique_bp / 800 * 10
                       ELSE least(10::DOUBLE, greatest(0::DOUBLE, 10 - (unique_bp - 2000) / 1000 * 10)) END) * 10 + 0.5::DOUBLE) AS BIGINT) AS index_x10 FROM x)
        SELECT doc_id, n_sentences, mean_x100, std_x100, n_long, dialogue_bp, connective_bp, unique_bp, index_x10,
          CASE WHEN index_x10 >= 800 THEN 'easy' WHEN index_x10 >= 600 THEN 'normal' WHEN index_x10 >= 400 THEN 'patient' ELSE 'hard' END AS grade,
          CASE WHEN n_chars >= 100000 THEN 'high' WHEN n_chars >= 30000 THEN 'medium' ELSE 'low' END AS confidence FROM i""",
    "halving_split": f"""
        WITH d AS (SELECT doc_id, {T} AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
        m AS (SELECT *, list_filter(range(1, length(t) - 1), lambda i: substring(t, (i + 1)::INT, 1) IN (chr(10), '。')) AS p, length(t) // 2 AS mid FROM d),
        c AS (SELECT doc_id, t, coalesce(list_sort(list_transform(p, lambda i: {{'far': abs(i - mid), 'stop': substring(t, (i + 1)::INT, 1) = '。', 'at': i}}))[1].at, mid) AS cut FROM m),
        h AS (SELECT doc_id, t, unnest(CASE WHEN cut > 0 AND cut < length(t) THEN [1, 2] ELSE [1] END) AS chunk_index, cut FROM c),
        s AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index = 2 THEN cut ELSE 0 END AS lo, CASE WHEN chunk_index = 2 OR cut = 0 OR cut >= length(t) THEN length(t) ELSE cut END AS hi, t FROM h),
        x AS (SELECT *, substring(t, (lo + 1)::INT, (hi - lo)::INT) AS part FROM s)
        SELECT doc_id, chunk_index::INT AS chunk_index, (lo + length(part) - length(ltrim(part, {_SPACE})))::INT AS core_start,
          (lo + length(part) - length(ltrim(part, {_SPACE})) + length(trim(part, {_SPACE})))::INT AS core_end FROM x""",
    "text_texture_metrics": f"""
        WITH r AS (SELECT doc_id, ({_count("t", _WORDS)}) * 10000 // length(t) AS template_bp,
            (length(t) - length(regexp_replace(t, '{_QUOTES}', '', 'g'))) * 10000 // length(t) AS dialogue_bp,
            len(regexp_extract_all(t, '[！!]')) * 10000 // length(t) AS exclaim_bp,
            len(regexp_extract_all(t, '…{{2,}}|。{{3,}}|\\.{{3,}}')) * 10000 // length(t) AS ellipsis_bp,
            CASE WHEN length(t) > 100 THEN len(list_distinct(regexp_extract_all(t, '(?s).'))) * 10000 // length(t) ELSE 0 END AS unique_bp,
            coalesce(floor(list_avg(list_filter(list_transform(regexp_extract_all(t, '{metrics.SENTENCE}'), lambda x: length(x)), lambda n: n > 2)) * 10 + 0.5), 0)::BIGINT AS sentence_x10
          FROM {_DOCS})
        SELECT *, least(100, greatest(10, 70 + CASE WHEN template_bp > 30 THEN -25 WHEN template_bp > 15 THEN -15 WHEN template_bp > 8 THEN -8 WHEN template_bp < 3 THEN 5 ELSE 0 END
            + CASE WHEN unique_bp > 2500 THEN 5 WHEN unique_bp < 1200 THEN -10 ELSE 0 END
            + CASE WHEN sentence_x10 > 500 THEN -8 WHEN sentence_x10 BETWEEN 150 AND 400 THEN 3 ELSE 0 END))::INT AS writing_x10,
          least(100, greatest(10, 60 + CASE WHEN exclaim_bp BETWEEN 5 AND 25 THEN 15 WHEN exclaim_bp > 40 THEN -10 WHEN exclaim_bp < 2 THEN -5 ELSE 0 END
            + CASE WHEN template_bp > 20 THEN -10 ELSE 0 END))::INT AS emotion_x10 FROM r""",
    "template_phrase_density": f"WITH d AS {_DOCS}, h AS ({_HIT_ROWS}) SELECT doc_id, category, phrase, hits::INT AS hits FROM h WHERE hits >= 2",
    "template_phrase_global": f"""WITH d AS {_DOCS}, h AS ({_HIT_ROWS})
        SELECT category, phrase, sum(hits)::BIGINT AS hits, count(*) AS documents FROM h WHERE hits >= 1 GROUP BY ALL""",
    "lexicon_polarity_by_segment": f"SELECT doc_id, segment, positive::INT AS positive, negative::INT AS negative, polarity_bp FROM ({_POLARITY})",
    "polarity_arc_class": f"""
        WITH p AS ({_POLARITY}),
        m AS (SELECT doc_id, sum(polarity_bp) FILTER (segment < 1) * 3 AS a, sum(polarity_bp) FILTER (segment >= 1 AND segment < 2) * 3 AS b,
                sum(polarity_bp) FILTER (segment >= 2) AS c, arg_max(segment, (polarity_bp, -segment)) AS best_segment,
                arg_min(segment, (polarity_bp, segment)) AS worst_segment FROM p GROUP BY doc_id)
        SELECT doc_id, CASE WHEN b > a + 1500 AND c > b + 1500 THEN 'rise' WHEN b < a - 1500 AND c < b - 1500 THEN 'fall'
            WHEN a > b AND b < c AND a > c THEN 'oedipus' WHEN a < b AND b > c AND a < c THEN 'cinderella'
            WHEN a > b AND b < c THEN 'man_in_hole' WHEN a < b AND b > c THEN 'icarus' ELSE 'flat' END AS arc, best_segment, worst_segment FROM m""",
    "density_level": f"""
        WITH r AS (SELECT doc_id, length(t) AS n_chars, ({_present("t", NOVEL.dense)})::INT AS n_dense, ({_present("t", NOVEL.calm)})::INT AS n_calm,
                     (({_count("t", "！？。；")}) // 80)::INT AS marks FROM {_DOCS}),
        s AS (SELECT *, n_dense * 2 + least(4, marks) AS score FROM r)
        SELECT doc_id, n_dense, n_calm, score, CASE WHEN score >= 6 OR n_dense >= 3 THEN 'high' WHEN score <= 1 AND n_calm >= 2 THEN 'low'
            WHEN n_chars < 1200 AND score = 0 AND n_calm >= 1 THEN 'low' ELSE 'medium' END AS level FROM s""",
    "encoding_noise_flags": f"""
        WITH r AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS n_control,
                     len(regexp_extract_all(text, chr(65533))) AS n_replaced, len(regexp_extract_all(text, '\\r')) AS n_returns,
                     list_max(list_transform(string_split({T}, chr(10)), lambda x: length(x))) AS longest_line, length(text) AS n_chars
                   FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, n_control, n_replaced, n_returns, longest_line, CASE WHEN n_chars = 0 THEN 'empty' WHEN (n_control + n_replaced) * 100 > n_chars THEN 'high'
            WHEN n_control + n_replaced > 0 OR longest_line > 5000 THEN 'medium' WHEN n_returns > 0 THEN 'low' ELSE 'none' END AS severity FROM r""",
    "genre_inference_rank": f"""
        WITH d AS (SELECT doc_id, book_id, lower(t) AS l FROM {_DOCS}), g AS ({_GENRE_ROWS}),
        s AS (SELECT book_id, genre, sum(score)::BIGINT AS score FROM g WHERE score > 0 GROUP BY ALL HAVING sum(score) >= 6),
        r AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS top, coalesce(lead(score) OVER w, 0) AS next FROM s WINDOW w AS (PARTITION BY book_id ORDER BY score DESC, genre))
        SELECT book_id, genre, score, rank::INT AS rank, least(95, CAST(floor(35 + 45 * score / top + 20 * (score - next) / score) AS BIGINT)) AS confidence FROM r""",
    "content_hash_dedup": """
        SELECT substring(sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 16) AS hash, min(doc_id) AS kept, count(*) AS copies
        FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
    "token_estimates": "SELECT book_id, sum(length(text) // 3 + 100)::BIGINT AS tokens, count(*) AS chunks FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "passage_sentence_reuse": f"""
        WITH k AS (SELECT DISTINCT item_id, md5({STRIP}) AS h FROM (SELECT item_id, unnest({SENTENCES.replace(T, "regexp_replace(passage, '\\r\\n?', chr(10), 'g')")}) AS s FROM eval_passages) WHERE length({STRIP}) >= 12),
        d AS (SELECT DISTINCT doc_id, md5({STRIP}) AS h FROM (SELECT doc_id, unnest({SENTENCES}) AS s FROM documents WHERE text IS NOT NULL))
        SELECT doc_id, item_id, count(*) AS shared FROM d JOIN k USING (h) GROUP BY ALL""",
}
