"""Queries of the problems tagged for training text, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import components, language, leaks, mixture, names, neardup, plain, truncated, windows
from palimpsest.plans.shared import materialize
from palimpsest.sources import table


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every retold fact with the smallest fact of its group."""
    facts = table(spark, sf_dir, "chunk_facts").select("fact_id", F.coalesce("event", "description", "fact").alias("statement"))
    return neardup.near_duplicates(facts, "fact_id", "statement", prepare=plain.plain).select(F.col("id").alias("fact_id"), "group_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = p1_groups(spark, sf_dir).withColumnRenamed("fact_id", "id")
    return neardup.member_pairs(groups, "fact_id_a", "fact_id_b")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, key, field in (("chunk_facts", "fact_id", "evidence"), ("chunk_heroine_entries", "entry_id", "heroine_name")):
        rows = plain.not_plain(table(spark, sf_dir, name), key, field)
        parts.append(rows.select(F.lit(field).alias("field"), F.col(key).alias("row_key")))
    return parts[0].unionByName(parts[1]).distinct()


def p3_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling that is linked with another one, and its person."""
    return names.persons(names.spellings(table(spark, sf_dir, "chunk_heroine_entries"), table(spark, sf_dir, "heroine_candidates")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.spelling_pairs(p3_persons(spark, sf_dir))


def _windows(spark: SparkSession, sf_dir: str, plan: str) -> DataFrame:
    spans = windows.cluster_windows(table(spark, sf_dir, "proximity_clusters"), table(spark, sf_dir, "co_occurrence_hits"))
    texts = table(spark, sf_dir, "documents").select("book_id", "chunk_idx", "text")
    return windows.split_windows(spans, texts, ["book_id", "chunk_idx"], "cluster_id", plan=plan)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "last_boundary")


def p4_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "balanced")


def _cut_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, id, cut, score, by) of every judged value of the three fields."""
    facts = table(spark, sf_dir, "chunk_facts")
    outlines = materialize(truncated.causal_descriptions(table(spark, sf_dir, "chunk_results")), "outlines")
    fields = [facts.select(F.lit(name).alias("field"), F.col("fact_id").alias("id"), F.col(name).alias("text")) for name in ("event", "evidence")]
    fields.append(outlines.select(F.lit("causal_description").alias("field"), F.col("result_id").alias("id"), F.col("description").alias("text")))
    return truncated.find_cut(fields[0].unionByName(fields[1]).unionByName(fields[2]), "id", "text", plain.plain, field="field")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_fields(spark, sf_dir).filter("cut").select("field", F.col("id").alias("row_key")).distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts each field; re-delivered rows count once."""
    sources = [
        table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "source").dropDuplicates(["id"])
        for name, key, kind in (("chunk_facts", "fact_id", "fact"), ("chunk_results", "result_id", "result"))
    ]
    judged = _cut_fields(spark, sf_dir).withColumn("kind", F.when(F.col("field") == "causal_description", "result").otherwise("fact"))
    joined = judged.join(sources[0].unionByName(sources[1]), ["kind", "id"])
    n_cut = F.count(F.when(F.col("cut"), 1))
    return joined.groupBy("field", "source").agg(F.count("*").alias("n"), n_cut.alias("n_cut"), (n_cut / F.count("*")).alias("rate"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.alias_groups(table(spark, sf_dir, "alias_records"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the passages they hold and the share held."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_passages"), "item_id", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which passages leaked, and into how many documents."""
    items = table(spark, sf_dir, "eval_passages").select("item_id", "suite").distinct()
    found = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of the mixture, its size and how often it is used."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, language.Model]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs, language.train(docs, "doc_id", "text", "lang")


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language of every text with its whole sentences and a confidence, next to the label."""
    docs, model = _languages(spark, sf_dir)
    return language.with_languages(docs.withColumnRenamed("lang", "label"), "doc_id", "text", model, ["label"])


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, model = _languages(spark, sf_dir)
    return language.language_segments(docs, "doc_id", "text", model)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p10_languages(spark, sf_dir).filter("main or sentences >= 2")
    both = found.groupBy("doc_id").agg(
        F.collect_set("lang").alias("langs"), F.max(F.when(F.col("main"), F.col("lang"))).alias("main"), F.first("label").alias("label")
    )
    named = language.label_language(F.col("label"))
    wrong = named.isNull() | (named != F.col("main")) | (F.size("langs") > 1)
    return both.filter(wrong).select("doc_id", F.explode("langs").alias("lang"))


QUERIES = {
    "p1_groups": p1_groups,
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_persons": p3_persons,
    "p3_found": p3_found,
    "p4_found": p4_found, 
    "p4_balanced": p4_balanced,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p8_leaks": p8_leaks,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_languages": p10_languages,
    "p10_segments": p10_segments,
    "p10_found": p10_found,
}
_CUT = "CASE WHEN e - {s} <= 1000 THEN e ELSE {s} + coalesce(nullif(length(regexp_extract(substring(text, {s} + 1, 1000), '(?s)^.{{500,}}[。！？\\n]')), 0), 1000) END"

SQL = {
    "p4_found": f"""
        WITH RECURSIVE h AS (SELECT cluster_id, min(chunk_idx) AS chunk_idx FROM co_occurrence_hits WHERE chunk_idx IS NOT NULL GROUP BY 1),
        w AS (SELECT DISTINCT cluster_id, greatest(least(window_start, window_end), 0) AS s, least(greatest(window_start, window_end), length(text)) AS e, text
              FROM proximity_clusters JOIN h USING (cluster_id) JOIN documents USING (book_id, chunk_idx) WHERE window_start IS NOT NULL AND window_end IS NOT NULL AND text IS NOT NULL),
        p AS (SELECT cluster_id, 1 AS no, s, {_CUT.format(s="s")} AS c, e, text FROM w WHERE e - s > 1000
              UNION ALL SELECT cluster_id, no + 1, c - 100, {_CUT.format(s="(c - 100)")}, e, text FROM p WHERE c < e)
        SELECT cluster_id, no::INT AS piece_no, s::INT AS piece_start, c::INT AS piece_end FROM p""",
    "p7_found": """
        WITH RECURSIVE n AS (SELECT DISTINCT record_id, book_id, unnest(list_append(coalesce(aliases, []), main_name)) AS name FROM alias_records WHERE book_id IS NOT NULL),
        k AS (SELECT * FROM n WHERE regexp_matches(name, '[^\\s\\p{Z}]')),
        t AS (SELECT book_id, name, min(record_id) AS least FROM k GROUP BY ALL),
        d AS (SELECT DISTINCT record_id AS a, least AS b FROM k JOIN t USING (book_id, name) WHERE record_id <> least),
        e AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
        r AS (SELECT DISTINCT a AS x, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.x = e.a)
        SELECT x AS record_id, min(m) AS group_id FROM r GROUP BY x""",
}
