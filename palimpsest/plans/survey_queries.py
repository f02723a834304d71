"""Queries of samples, rankings, weights and statistics over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.packs import NOVEL
from palimpsest.functions.text import ngrams, normalize_newlines, text_hash
from palimpsest.plans.shared import spread
from palimpsest.sources import table

#: Patterns whose hits are counted, most hits of each that count, and phrases that switch a word off.
PATTERNS, MOST_HITS = ("[！!]", "剑", "门", "雨", "letter|night"), 30
BLOCKED = (("剑", "剑冢"), ("门", "山门"), ("雨", "雾隐"))

# Words of a later time, anywhere in a line, and of another place, at its beginning; a mark or space follows.
LATER = "次日|翌日|三天后|数日后|半月后|一月后|半年后|数月后|一年后|数年后|翌晨|翌晚|入夜|深夜|天明|清晨|傍晚|午后|午时|子时|丑时|寅时|卯时|辰时|巳时|未时|申时|酉时|戌时|亥时"
ELSEWHERE = "另一处|另一边|与此同时|却说|且说|话分两头|远处|千里之外|百里之外"
#: A line at which a scene begins, whatever stands before it.
SHIFT = f"(?:{LATER})[，。！？\\s\u3000]|^[\\s\u3000]*(?:{ELSEWHERE})[，。！？\\s\u3000]"
#: Pieces that make up a whole text: sentences with their marks, and line breaks.
PIECE = f"[^{NOVEL.terminators}\n]*[{NOVEL.terminators}]+|[^{NOVEL.terminators}\n]+|\n"


def _facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "chunk_facts").select("fact_id", *columns).dropDuplicates(["fact_id"])


def step_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each book's n chunks the ones at floor(i * n / 20), i from 0 to 19 (a sampling operator)."""
    rows = table(spark, sf_dir, "documents").select("book_id", "chunk_idx", "doc_id")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("chunk_idx")) - 1
    rows = rows.withColumn("i", place).join(rows.groupBy("book_id").agg(F.count("*").alias("n")), "book_id")
    # Place p is taken if a whole number i has floor(i * n / 20) = p.
    step = F.ceil(F.col("i") * 20 / F.col("n"))
    return rows.filter((step < 20) & (F.floor(step * F.col("n") / 20) == F.col("i"))).select("book_id", "chunk_idx", "doc_id")


def distinct_first_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 80 different character names of each book in order of appearance (a top-k report)."""
    named = _facts(spark, sf_dir, "book_id", "chunk_index", "character_name").filter("character_name is not null")
    first = named.groupBy("book_id", "character_name").agg(F.min(F.struct("chunk_index", "fact_id")).alias("first"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("first"))
    return first.withColumn("place", place).filter("place <= 80").select("book_id", "character_name", "place")


def manifest_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier and later crawls of each book: chunks reused by content, to be scanned again, removed, and the reuse rate."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    rows = rows.select("book_id", text_hash(F.col("text")).alias("hash"), (F.col("crawled_at") < F.lit("2024-05-01").cast("timestamp_ntz")).alias("old"))
    known = rows.groupBy("book_id", "hash").agg(F.count(F.when(F.col("old"), 1)).alias("n_old"), F.count(F.when(~F.col("old"), 1)).alias("n_new"))
    reused = F.when(F.col("n_old") > 0, F.col("n_new")).otherwise(0)
    total = known.groupBy("book_id").agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"), F.sum(reused).alias("n_reused"))
    rate = F.when(F.col("n_new") > 0, F.floor(F.col("n_reused") * 10000 / F.col("n_new"))).otherwise(0).cast("bigint")
    return total.select("*", (F.col("n_new") - F.col("n_reused")).alias("n_rescan"), F.greatest(F.lit(0), F.col("n_old") - F.col("n_reused")).alias("n_removed"), rate.alias("reuse_bp"))


def manifest_hash_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last chunk of each book with a content: what a later manifest is looked up in."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("book_id", "chunk_idx", text_hash(F.col("text")).alias("hash"))
    return rows.groupBy("book_id", "hash").agg(F.max("chunk_idx").alias("chunk_idx"))


def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the patterns, at most 30 of each, for each thousand characters and one more, in ten-thousandths."""
    t = F.col("text")
    hits = sum((F.least(F.regexp_count(t, F.lit(p)), F.lit(MOST_HITS)) for p in PATTERNS), F.lit(0))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("text is not null").select("doc_id", hits.alias("hits"), F.length(t).alias("n"))
    return rows.select("doc_id", "hits", F.floor(F.col("hits") * 10_000_000 / (1000 + F.col("n"))).cast("bigint").alias("density"))


def unblocked_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each text that no blocking phrase of theirs, anywhere in the text, switches off."""
    t = F.col("text")
    words = F.array(*(F.when(F.contains(t, F.lit(w)) & ~F.contains(t, F.lit(phrase)), F.lit(w)) for w, phrase in BLOCKED))
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.explode(F.array_compact(words)).alias("word"))
    return rows


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, gram, w): 3-grams of the passages weighted by their number and ln((N + 1) / (df + 1)) + 1."""
    items = table(spark, sf_dir, "eval_passages").filter("passage is not null").select("item_id", "passage").distinct()
    grams = items.select("item_id", F.explode(ngrams(F.col("passage"), 3)).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("tf"))
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    total = items.agg(F.count("*").alias("total"))
    return grams.join(df, "gram").crossJoin(F.broadcast(total)).select("item_id", "gram", "df", (F.col("tf") * (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1)).alias("w"))


def idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse document frequency of every 3-gram of the passages, in thousandths."""
    total = table(spark, sf_dir, "eval_passages").filter("passage is not null").select("item_id").distinct().agg(F.count("*").alias("total"))
    rows = _weights(spark, sf_dir).select("gram", "df").distinct().crossJoin(F.broadcast(total))
    return rows.select("gram", "df", F.round((F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1) * 1000).cast("bigint").alias("idf_x1000"))


def tfidf_weighted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passages and the cosine of their weighted 3-grams in per cent, from 10 on; every shared gram counts."""
    w = _weights(spark, sf_dir)
    norms = w.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    a, b = (w.select(F.col("item_id").alias(i), "gram", F.col("w").alias(f"w{i}")) for i in "ab")
    dots = a.join(b, "gram").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    left, right = (norms.select(F.col("item_id").alias(i), F.col("norm").alias(f"n{i}")) for i in "ab")
    cosine = F.round(F.col("dot") / (F.col("na") * F.col("nb")) * 100).cast("bigint")
    return dots.join(left, "a").join(right, "b").select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), cosine.alias("cosine")).filter("cosine >= 10")


def chapter_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter lengths of whole books: their spread, shares of long and short ones, and the pacing score (x10)."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("book_id", "chunk_idx", normalize_newlines(F.col("text")).alias("t"))
    lines = docs.select("book_id", "chunk_idx", F.posexplode(F.split("t", "\n", -1)).alias("no", "line"))
    heading = F.regexp_replace("line", "^[ \t\u3000]+", "").rlike(f"^{NOVEL.heading}")
    lines = lines.select("book_id", "chunk_idx", "no", (F.length("line") + 1).cast("bigint").alias("n"), heading.cast("int").alias("head"))
    chapter = F.sum("head").over(Window.partitionBy("book_id").orderBy("chunk_idx", "no"))
    chapters = lines.withColumn("chapter", chapter).filter("chapter > 0").groupBy("book_id", "chapter").agg(F.sum("n").alias("n"))
    sums = chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares")).filter("chapters >= 3")
    sized = chapters.join(sums, "book_id")
    mean = F.col("total") / F.col("chapters")
    shares = sized.groupBy("book_id").agg(F.count(F.when(F.col("n") > mean * 1.5, 1)).alias("long"), F.count(F.when(F.col("n") < mean * 0.5, 1)).alias("short"))
    cv = F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("chapters") * F.col("squares") - F.col("total") * F.col("total"))) / F.col("total") * 1000).cast("bigint")
    rows = sums.join(shares, "book_id").select("book_id", "chapters", cv.alias("cv_x1000"), F.floor(F.col("long") * 1000 / F.col("chapters")).alias("long_x1000"), F.floor(F.col("short") * 1000 / F.col("chapters")).alias("short_x1000"))
    score = 70 + F.when(F.col("cv_x1000") > 1000, -20).when(F.col("cv_x1000") > 700, -10).when(F.col("cv_x1000") < 300, 5).otherwise(0)
    score = score - F.when(F.col("long_x1000") > 300, 8).otherwise(0) - F.when(F.col("short_x1000") > 300, 8).otherwise(0)
    return rows.select("*", F.least(F.lit(100), F.greatest(F.lit(10), score)).alias("pacing_x10"))


def _rank_of(column: str) -> F.Column:
    return F.when(F.col(column) == "high", 3).when(F.col(column) == "medium", 2).when(F.col(column) == "low", 1).otherwise(0)


def capped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best facts of each chunk by confidence, then by order, in their old order (a top-k report)."""
    rows = _facts(spark, sf_dir, "book_id", "chunk_index", "confidence").withColumn("c", _rank_of("confidence"))
    best = F.row_number().over(Window.partitionBy("book_id", "chunk_index").orderBy(F.desc("c"), "fact_id"))
    kept = rows.withColumn("best", best).filter("best <= 8")
    place = F.row_number().over(Window.partitionBy("book_id", "chunk_index").orderBy("fact_id"))
    return kept.select("fact_id", "book_id", "chunk_index", "best", place.alias("place"))


def focus_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 leading characters of each book by mean confidence, number, first place and name (a top-k report)."""
    rows = _facts(spark, sf_dir, "book_id", "chunk_index", "character_name", "confidence").filter("character_name is not null").withColumn("c", _rank_of("confidence"))
    people = rows.groupBy("book_id", "character_name").agg(F.floor(F.sum("c") * 1000 / F.count("*")).cast("bigint").alias("mean_x1000"), F.count("*").alias("n"), F.min("chunk_index").alias("first"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("mean_x1000"), F.desc("n"), "first", "character_name"))
    return people.withColumn("place", place).filter("place <= 30")


def scene_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at which a scene begins: after two blank lines or more, or with words of another time or place."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split(normalize_newlines(F.col("text")), "\n", -1)).alias("no", "line"))
    lines = lines.withColumn("blank", F.col("line").rlike("^[\\s\u3000]*$"))
    w = Window.partitionBy("doc_id").orderBy("no")
    after = F.coalesce(F.lag("blank", 1).over(w) & F.lag("blank", 2).over(w), F.lit(False))
    # A blank at the end of a line is none that follows a word.
    shift = F.btrim("line", F.lit(" \t\u3000")).rlike(SHIFT)
    return lines.withColumn("after", after).filter(~F.col("blank") & (F.col("after") | shift)).select("doc_id", (F.col("no") + 1).alias("line_no"), "after")


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, no, start, end) of every sentence in the text with plain line breaks; blank ones have no row."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("text is not null")
    pieces = docs.select("doc_id", F.posexplode(F.regexp_extract_all(normalize_newlines(F.col("text")), F.lit(PIECE), F.lit(0))).alias("no", "piece"))
    end = F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("no"))
    rows = pieces.withColumn("end", end).filter(F.col("piece").rlike(r"\S"))
    return rows.select("doc_id", "no", (F.col("end") - F.length("piece")).alias("start"), "end")


QUERIES = {
    f.__name__: f
    for f in (
        step_sample, distinct_first_80, manifest_diff_stats, manifest_hash_map, keyword_density, unblocked_keywords, idf_terms, tfidf_weighted_pairs, chapter_pacing, capped_facts, focus_characters, scene_breaks, sentence_spans,
    )
}

_F = "(SELECT DISTINCT ON (fact_id) * FROM chunk_facts)"
_HASH = "substring(sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 16)"
_C = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_HITS = " + ".join(f"least(len(regexp_extract_all(text, '{p}')), {MOST_HITS})" for p in PATTERNS)
_GRAMS = "SELECT item_id, unnest(list_transform(range(1, greatest(length(passage) - 1, 1)), lambda i: substring(passage, i::INT, 3))) AS gram FROM (SELECT DISTINCT item_id, passage FROM eval_passages WHERE passage IS NOT NULL)"
_WEIGHTS = f"""g AS (SELECT item_id, gram, count(*) AS tf FROM ({_GRAMS}) GROUP BY ALL), d AS (SELECT gram, count(*) AS df FROM g GROUP BY gram),
  n AS (SELECT count(DISTINCT item_id) AS total FROM eval_passages WHERE passage IS NOT NULL)"""

_T = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"

SQL = {
    "scene_breaks": f"""
        WITH d AS (SELECT doc_id, string_split({_T}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM d),
        b AS (SELECT *, regexp_matches(line, '^[\\s\u3000]*$') AS blank FROM l),
        a AS (SELECT *, coalesce(lag(blank, 1) OVER w AND lag(blank, 2) OVER w, false) AS after FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY no))
        SELECT doc_id, no::INT AS line_no, after FROM a WHERE NOT blank AND (after OR regexp_matches(trim(line, ' \u3000' || chr(9)), '{SHIFT}'))""",
    "sentence_spans": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_T}, '{PIECE}') AS ps FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS no FROM d),
        e AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY no) AS stop FROM p)
        SELECT doc_id, no::INT AS no, (stop - length(piece))::BIGINT AS start, stop::BIGINT AS "end" FROM e WHERE regexp_matches(piece, '[^ \\t\\n\\r\\f\\v]')""",
    "step_sample": """
        WITH r AS (SELECT book_id, chunk_idx, doc_id, row_number() OVER (PARTITION BY book_id ORDER BY chunk_idx) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n FROM documents)
        SELECT book_id, chunk_idx, doc_id FROM r WHERE i IN (SELECT k * n // 20 FROM range(20) t(k))""",
    "distinct_first_80": f"""
        WITH p AS (SELECT book_id, character_name, min({{'c': chunk_index, 'f': fact_id}}) AS first FROM {_F} WHERE character_name IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY first) AS place FROM p)
        SELECT book_id, character_name, place::INT AS place FROM r WHERE place <= 80""",
    "manifest_diff_stats": f"""
        WITH m AS (SELECT book_id, {_HASH} AS hash, crawled_at < TIMESTAMP '2024-05-01' AS old FROM documents WHERE text IS NOT NULL),
        s AS (SELECT book_id, count(*) FILTER (old) AS n_old, count(*) FILTER (NOT old) AS n_new,
                count(*) FILTER (NOT old AND EXISTS (SELECT 1 FROM m o WHERE o.old AND o.book_id = m.book_id AND o.hash = m.hash)) AS n_reused FROM m GROUP BY book_id)
        SELECT *, n_new - n_reused AS n_rescan, greatest(0, n_old - n_reused) AS n_removed, CASE WHEN n_new > 0 THEN n_reused * 10000 // n_new ELSE 0 END AS reuse_bp FROM s""",
    "manifest_hash_map": f"SELECT book_id, {_HASH} AS hash, max(chunk_idx) AS chunk_idx FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "keyword_density": f"SELECT doc_id, hits::INT AS hits, hits * 10000000 // (1000 + n) AS density FROM (SELECT doc_id, {_HITS} AS hits, length(text) AS n FROM documents WHERE text IS NOT NULL)",
    "unblocked_keywords": " UNION ALL ".join(f"SELECT doc_id, '{w}' AS word FROM documents WHERE contains(text, '{w}') AND NOT contains(text, '{p}')" for w, p in BLOCKED),
    "idf_terms": f"WITH {_WEIGHTS} SELECT gram, df, round((ln((total + 1) / (df + 1)) + 1) * 1000)::BIGINT AS idf_x1000 FROM d, n",
    "tfidf_weighted_pairs": f"""
        WITH {_WEIGHTS}, w AS (SELECT item_id, gram, tf * (ln((total + 1) / (df + 1)) + 1) AS w FROM g JOIN d USING (gram), n),
        s AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY item_id),
        p AS (SELECT a.item_id AS item_a, b.item_id AS item_b, sum(a.w * b.w) AS dot FROM w a JOIN w b USING (gram) WHERE a.item_id < b.item_id GROUP BY ALL)
        SELECT item_a, item_b, round(dot / (x.norm * y.norm) * 100)::BIGINT AS cosine FROM p JOIN s x ON x.item_id = item_a JOIN s y ON y.item_id = item_b WHERE round(dot / (x.norm * y.norm) * 100) >= 10""",
    "chapter_pacing": f"""
        WITH d AS (SELECT book_id, chunk_idx, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        l AS (SELECT book_id, chunk_idx, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM d),
        c AS (SELECT book_id, length(line) + 1 AS n, sum(regexp_matches(regexp_replace(line, '^[ \\t\u3000]+', ''), '^{NOVEL.heading}')::INT) OVER (PARTITION BY book_id ORDER BY chunk_idx, no) AS chapter FROM l),
        p AS (SELECT book_id, chapter, sum(n)::BIGINT AS n FROM c WHERE chapter > 0 GROUP BY ALL),
        s AS (SELECT book_id, count(*) AS chapters, sum(n)::DOUBLE AS total, sum(n * n)::DOUBLE AS squares FROM p GROUP BY book_id HAVING count(*) >= 3),
        q AS (SELECT book_id, any_value(chapters) AS chapters, any_value(total) AS total, any_value(squares) AS squares, count(*) FILTER (n > total / chapters * 1.5) AS lo, count(*) FILTER (n < total / chapters * 0.5) AS sh FROM p JOIN s USING (book_id) GROUP BY book_id),
        r AS (SELECT book_id, chapters, round(sqrt(greatest(0, chapters * squares - total * total)) / total * 1000)::BIGINT AS cv_x1000, lo * 1000 // chapters AS long_x1000, sh * 1000 // chapters AS short_x1000 FROM q)
        SELECT *, least(100, greatest(10, 70 + CASE WHEN cv_x1000 > 1000 THEN -20 WHEN cv_x1000 > 700 THEN -10 WHEN cv_x1000 < 300 THEN 5 ELSE 0 END
          - CASE WHEN long_x1000 > 300 THEN 8 ELSE 0 END - CASE WHEN short_x1000 > 300 THEN 8 ELSE 0 END))::INT AS pacing_x10 FROM r""",
    "capped_facts": f"""
        WITH r AS (SELECT fact_id, book_id, chunk_index, row_number() OVER (PARTITION BY book_id, chunk_index ORDER BY {_C} DESC, fact_id) AS best FROM {_F})
        SELECT fact_id, book_id, chunk_index, best::INT AS best, (row_number() OVER (PARTITION BY book_id, chunk_index ORDER BY fact_id))::INT AS place FROM r WHERE best <= 8""",
    "focus_characters": f"""
        WITH p AS (SELECT book_id, character_name, (sum({_C}) * 1000 // count(*))::BIGINT AS mean_x1000, count(*) AS n, min(chunk_index) AS first FROM {_F} WHERE character_name IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY mean_x1000 DESC, n DESC, first, character_name) AS place FROM p)
        SELECT * REPLACE (place::INT AS place) FROM r WHERE place <= 30""",
}
