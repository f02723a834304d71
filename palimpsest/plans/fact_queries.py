"""Queries over facts, results, clusters, hits, entries, candidates and alias records. Re-delivered rows count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.jsontext import json_diagnosis, lenient_json
from palimpsest.functions.names import fragments, split_names
from palimpsest.functions.packs import NOVEL
from palimpsest.functions.text import core_name, count_present, jaccard, ngram_set, ngrams, normalize_newlines, normalize_person, strip, text_hash
from palimpsest.operators import anchors, entities, joins, records, states
from palimpsest.sources import table

FACT_COLUMNS = ["book_id", "chunk_index", "kind", "event", "description", "fact", "evidence", "confidence", "source", "character_name"]
RULES = [
    ("lost_then_kept", "events", "早已失守", "events", "守住"),
    ("hidden_then_public", "worldbuilding", "埋着", "events", "当众"),
    ("refused_then_gave", "events", "宁可失去", "relationships", "交给"),
    ("burned_then_used", "events", "烧掉|burned", "risk_facts", "烧剩|ashen"),
]


def _facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Facts once each: the re-delivered ones have the same content."""
    return table(spark, sf_dir, "chunk_facts").select("fact_id", *columns).dropDuplicates(["fact_id"])


def _statement():
    return F.coalesce("event", "description", "fact")


def keep_first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fact of each book with a given evidence, by id."""
    rows = _facts(spark, sf_dir, "book_id", "evidence", "kind").filter("evidence is not null").select("book_id", F.md5("evidence").alias("evidence_md5"), "fact_id", "kind")
    return records.keep_first(rows, ["book_id", "evidence_md5"], [F.col("fact_id")])


def keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir, "book_id", "kind", "chunk_index")
    return records.keep_last_n(rows, ["book_id", "kind"], ["chunk_index", "fact_id"], 5)


def checkpoint_delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest delivery of each fact."""
    rows = table(spark, sf_dir, "chunk_facts").select("fact_id", "source", "confidence", F.col("ingested_at").cast("string").alias("at"))
    deliveries = rows.groupBy("fact_id").agg(F.count("*").alias("deliveries"))
    latest = records.merge_deltas(rows, ["fact_id"], [F.col("at"), F.col("source")]).select("fact_id", "source", "confidence")
    return latest.join(deliveries, "fact_id")


def knowledge_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir, "book_id", "kind", "event", "description", "fact", "character_name")
    key = F.md5(F.coalesce("event", "description", "fact", "character_name", F.lit("")))
    return rows.groupBy("book_id", "kind").agg(F.count("*").alias("facts"), F.countDistinct(key).alias("distinct_facts"))


def fact_confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive score: evidence (3, or 1 if short), stated confidence, full scan, quoted name."""
    rows = _facts(spark, sf_dir, "evidence", "confidence", "source")
    n = F.length("evidence")
    score = (
        F.when(n >= 20, 3).when(n > 0, 1).otherwise(0)
        + F.when(F.lower("confidence") == "high", 2).when(F.lower("confidence") == "medium", 1).otherwise(0)
        + F.when(F.col("source") == "scan_full", 2).when(F.col("source") == "rescan", 1).otherwise(0)
    )
    scored = rows.select("fact_id", score.alias("score"))
    return scored.withColumn("level", F.when(F.col("score") >= 6, "high").when(F.col("score") >= 3, "medium").otherwise("low"))


def valid_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field validators: what is kept, and why the others are set aside."""
    rows = _facts(spark, sf_dir, *FACT_COLUMNS)
    text = F.coalesce("event", "description", "fact", "character_name")
    reason = F.when(text.isNull() | ~text.rlike(r"\S"), "empty").when(F.length(text) > 500, "too_long").when(F.col("evidence").isNull(), "no_evidence").when(F.contains(F.col("evidence"), F.lit("�")), "broken_evidence").otherwise("ok")
    return rows.select("kind", "source", reason.alias("reason")).groupBy("kind", "source", "reason").agg(F.count("*").alias("n"))


def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir, "book_id", "chunk_index", "kind", "event", "description", "fact").withColumn("statement", _statement())
    return joins.contradictions(rows, ["book_id", "chunk_index"], "fact_id", "kind", "statement", RULES)


def _threads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _facts(spark, sf_dir, "book_id", "chunk_index", "kind", "event", "description")
    thing = F.regexp_extract(F.coalesce("event", "description"), "([A-Z][0-9]+号..)", 1)
    rows = rows.select("book_id", "chunk_index", "kind", "fact_id", thing.alias("thing"), ngram_set(F.coalesce("event", "description"), 2).alias("grams")).filter("thing <> ''")
    planted = rows.filter("kind = 'foreshadowing'").select("book_id", "thing", F.col("fact_id").alias("planted"), F.col("chunk_index").alias("planted_at"), F.col("grams").alias("g"))
    resolved = rows.filter("kind = 'events'").select("book_id", "thing", F.col("fact_id").alias("resolved"), F.col("chunk_index").alias("resolved_at"), "grams")
    return planted, resolved


def temporal_match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted things and later events about the same thing, with the overlap of their wording in ten-thousandths."""
    planted, resolved = _threads(spark, sf_dir)
    pairs = planted.join(resolved, ["book_id", "thing"]).filter("planted_at < resolved_at")
    score = F.floor(jaccard(F.col("g"), F.col("grams")) * 10000).cast("bigint")
    return pairs.select("book_id", "thing", "planted", "planted_at", "resolved", "resolved_at", score.alias("score")).filter("score >= 800")


def temporal_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.greedy_matches(temporal_match_candidates(spark, sf_dir), ["book_id", "thing"])


def foreshadow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted, _ = _threads(spark, sf_dir)
    matched = temporal_match_candidates(spark, sf_dir).groupBy("planted").agg(F.min(F.col("resolved_at") - F.col("planted_at")).alias("distance"))
    rows = planted.select("book_id", "planted").join(matched, "planted", "left")
    return rows.groupBy("book_id").agg(F.count("*").alias("planted"), F.count("distance").alias("matched"), F.min("distance").alias("shortest"), F.max("distance").alias("longest"), F.sum("distance").alias("total"))


def neighbour_chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.neighbours(table(spark, sf_dir, "documents").select("book_id", "chunk_idx", "text"), "book_id", "chunk_idx", "text")
    return rows.select("book_id", "chunk_idx", "n_chars", F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


def manifest_diff_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of later crawls whose content an earlier crawl of any book holds."""
    old, new = _manifests(spark, sf_dir)
    return records.reuse(new, old, "hash").select("doc_id", "hash")


def manifest_diff_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _manifests(spark, sf_dir)
    return records.rescan(new, old, "hash").select("doc_id", "hash")


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text_hash(F.col("text")).alias("hash"), (F.col("crawled_at") < F.lit("2024-05-01").cast("timestamp_ntz")).alias("old"))
    return rows.filter("old"), rows.filter("not old")


def chunk_result_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a copied chunk takes over from the first chunk with the same text."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "book_id", "chunk_idx", text_hash(F.col("text")).alias("hash"))
    first = docs.groupBy("hash").agg(F.min_by(F.struct("book_id", "chunk_idx"), "doc_id").alias("f"), F.min("doc_id").alias("first"))
    facts = _facts(spark, sf_dir, "book_id", "chunk_index").groupBy("book_id", F.col("chunk_index").alias("chunk_idx")).agg(F.count("*").alias("facts"))
    copies = docs.join(first, "hash").filter("doc_id <> first").select("doc_id", "first", F.col("f.book_id").alias("book_id"), F.col("f.chunk_idx").alias("chunk_idx"))
    return copies.join(facts, ["book_id", "chunk_idx"], "left").select("doc_id", "first", F.coalesce("facts", F.lit(0)).alias("facts"))


def cooccurrence_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored hits per name and dimension: the first four chunks by place, half a point being 5."""
    hits = table(spark, sf_dir, "co_occurrence_hits").dropDuplicates(["hit_id"]).filter("chunk_idx is not null and keyword_pos is not null and anchor_pos is not null")
    d = F.abs(F.col("anchor_pos") - F.col("keyword_pos"))
    score = joins.proximity_score(d, F.lit(1), F.lit(1), F.col("dimension") == "relationship") * 10
    rows = hits.select("book_id", "heroine_name", "dimension", "chunk_idx", "hit_id", score.cast("int").alias("score_x10")).filter("score_x10 >= 10")
    one = records.keep_first(rows, ["book_id", "heroine_name", "dimension", "chunk_idx"], [F.col("hit_id")])
    w = Window.partitionBy("book_id", "heroine_name", "dimension").orderBy("chunk_idx")
    return one.withColumn("place", F.row_number().over(w)).filter("place <= 4")


def cluster_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one chunk merged where they overlap: gaps and islands over the running end."""
    spans = table(spark, sf_dir, "proximity_clusters").filter("window_start is not null and window_end is not null").select("cluster_id", F.least("window_start", "window_end").alias("s"), F.greatest("window_start", "window_end").alias("e"))
    chunks = table(spark, sf_dir, "co_occurrence_hits").filter("chunk_idx is not null").groupBy("cluster_id").agg(F.min("book_id").alias("book_id"), F.min("chunk_idx").alias("chunk_idx"))
    rows = spans.join(chunks, "cluster_id")
    w = Window.partitionBy("book_id", "chunk_idx").orderBy("s", "e", "cluster_id")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("book_id", "chunk_idx", "island").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.count("*").alias("windows"))


def dimension_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "proximity_clusters").filter("all_dimensions is not null").select(F.array_join(F.array_sort(F.array_distinct("all_dimensions")), "|").alias("dims"))
    return rows.groupBy("dims").agg(F.count("*").alias("n"))


def partner_tristate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one normalised name: longest spelling, rows, and a flag that is true, else false, else unknown."""
    rows = table(spark, sf_dir, "chunk_heroine_entries").dropDuplicates(["entry_id"]).filter("heroine_name is not null")
    key = core_name(normalize_person(F.col("heroine_name")))
    rows = rows.select("book_id", key.alias("name_key"), "heroine_name", "is_free_rider")
    longest = F.max_by("heroine_name", F.struct(F.length("heroine_name"), F.col("heroine_name")))
    return rows.groupBy("book_id", "name_key").agg(F.md5(longest).alias("longest_md5"), F.count("*").alias("n"), records.tri_state(F.col("is_free_rider")).alias("free_rider"))


def coverage_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names among entries but not candidates of the same book, and the other way round."""
    a = table(spark, sf_dir, "chunk_heroine_entries").filter("heroine_name is not null").select("book_id", F.col("heroine_name").alias("name"))
    b = table(spark, sf_dir, "heroine_candidates").filter("canonical_name is not null").select("book_id", F.col("canonical_name").alias("name"))
    return records.coverage(a, b, ["book_id", "name"])


def verdict_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against the alias records as verdict table: verified, rejected or pending."""
    verdicts = table(spark, sf_dir, "alias_records").filter("main_name is not null").groupBy(F.col("main_name").alias("canonical_name")).agg(F.max("mentions").alias("mentions"))
    rows = table(spark, sf_dir, "heroine_candidates").dropDuplicates(["candidate_id"]).join(verdicts, "canonical_name", "left")
    verdict = F.when(F.col("mentions").isNull(), "pending").when(F.col("mentions") >= 5, "verified").otherwise("rejected")
    return rows.select("candidate_id", verdict.alias("verdict"))


def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "heroine_candidates").dropDuplicates(["candidate_id"]).filter("canonical_name is not null and aliases is not null and book_id is not null")
    return entities.alias_map(rows, "book_id", "canonical_name", "aliases", F.count("*"))


def typo_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate names of one book within one edit: met on names with one character left out, not pairwise."""
    names = table(spark, sf_dir, "heroine_candidates").filter("canonical_name is not null and book_id is not null").select("book_id", F.col("canonical_name").alias("name")).filter(F.length("name") > 1).distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, F.length("name"))))
    keyed = names.select("book_id", "name", F.explode(F.array_distinct(F.concat(cuts, F.array("name")))).alias("k"))
    a, b = keyed.withColumnRenamed("name", "name_a"), keyed.withColumnRenamed("name", "name_b")
    pairs = a.join(b, ["book_id", "k"]).filter("name_a < name_b").select("book_id", "name_a", "name_b").distinct()
    return pairs.filter(F.levenshtein("name_a", "name_b") <= 1)


def tfidf_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most similar other passage by shared 3-grams, squared cosine of binary weights in millionths."""
    rows = table(spark, sf_dir, "eval_passages").select("item_id", F.explode(ngram_set(F.regexp_replace(F.lower("passage"), r"[\s\p{P}]+", ""), 3)).alias("g"))
    df = rows.groupBy("g").agg(F.count("*").alias("df")).filter("df between 2 and 20")
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("n"))
    kept = rows.join(df, "g").select("item_id", "g")
    a, b = kept.withColumnRenamed("item_id", "item_a"), kept.withColumnRenamed("item_id", "item_b")
    shared = a.join(b, "g").filter("item_a < item_b").groupBy("item_a", "item_b").agg(F.count("*").alias("shared"))
    both = shared.join(sizes.select(F.col("item_id").alias("item_a"), F.col("n").alias("na")), "item_a").join(sizes.select(F.col("item_id").alias("item_b"), F.col("n").alias("nb")), "item_b")
    return both.select("item_a", "item_b", "shared", F.floor(F.col("shared") * F.col("shared") * 1_000_000 / (F.col("na") * F.col("nb"))).cast("bigint").alias("cosine2_ppm")).filter("shared >= 5")


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outlines as they are, or fenced, cut, or with full-width marks outside and inside strings."""
    rows = table(spark, sf_dir, "chunk_results").dropDuplicates(["result_id"]).select("result_id", F.col("outline_architecture").alias("o"))
    kind = F.col("result_id") % 4
    wide = F.concat(F.lit("｛\"a，b\"：\"他说，走：吧\"，\"o\"："), "o", F.lit("｝"))
    damaged = F.when(kind == 1, F.concat(F.lit("```json\n"), "o", F.lit("\n```"))).when(kind == 2, F.expr("substring(o, 1, cast(length(o) / 2 as int))")).when(kind == 3, wide)
    return rows.select("result_id", damaged.otherwise(F.col("o")).alias("o"))


def json_lenient_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How damaged outlines parse, and the hash of what they were repaired to."""
    parsed = _damaged(spark, sf_dir).select("result_id", lenient_json("o").alias("p"))
    return parsed.select("result_id", "p.how", F.length("p.json").alias("n_chars"), F.sha1("p.json").alias("hash"))


def json_diagnosis_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each damaged outline."""
    rows = _damaged(spark, sf_dir).select("result_id", json_diagnosis("o").alias("d"))
    return rows.select("result_id", "d.flags", "d.length", "d.braces", "d.brackets")


def evidence_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each fact's evidence stands in its chunk."""
    facts = _facts(spark, sf_dir, "book_id", "chunk_index", "evidence").filter("evidence is not null").withColumnRenamed("chunk_index", "chunk_idx")
    texts = table(spark, sf_dir, "documents").filter("text is not null").select("book_id", "chunk_idx", "text")
    return anchors.anchor_evidence(facts, "fact_id", "evidence", texts, ["book_id", "chunk_idx"], "text")


def _chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir, "book_id", "chunk_index", "kind", "character_name", "description", "event")

    def some(kind: str, column: str):
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col(column))))

    return rows.groupBy("book_id", F.col("chunk_index").alias("chunk")).agg(some("characters", "character_name").alias("characters"), some("foreshadowing", "description").alias("opened"), some("events", "event").alias("resolved"))


def rolling_context_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "documents").groupBy("book_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("length"))
    chunks = _chunk_stream(spark, sf_dir).join(lengths, "book_id", "left").fillna(0, ["length"])
    return states.rolling_context(chunks, "book_id").select("book_id", "last_chunk", F.size("characters").alias("n_characters"), F.size("open_threads").alias("n_open"), "n_resolved")


def scan_memory_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.scan_memory(_chunk_stream(spark, sf_dir), "book_id").groupBy("book_id", "stale").agg(F.count("*").alias("threads"), F.max("last_seen").alias("last_seen"))


def character_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir, "book_id", "chunk_index", "kind", "character_name", "confidence").filter("kind = 'characters' and character_name is not null")
    points = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    return rows.groupBy("book_id", "character_name").agg(F.sum(points).alias("score"), F.count("*").alias("n"), F.countDistinct("chunk_index").alias("chunks"), F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"))


def segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed groups of 50 chunks with the hash of their first five event texts."""
    rows = _facts(spark, sf_dir, "book_id", "chunk_index", "event").filter("event is not null").select("book_id", "chunk_index", "fact_id", "event", F.floor(F.col("chunk_index") / 50).alias("segment"))
    w = Window.partitionBy("book_id", "segment").orderBy("chunk_index", "fact_id")
    first = rows.withColumn("r", F.row_number().over(w)).filter("r <= 5")
    merged = F.concat_ws("；", F.transform(F.array_sort(F.collect_list(F.struct("r", "event"))), lambda x: x.event))
    counts = rows.groupBy("book_id", "segment").agg(F.count("*").alias("events"))
    return first.groupBy("book_id", "segment").agg(F.md5(merged).alias("summary_md5")).join(counts, ["book_id", "segment"])


def worker_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("book_id", "chunk_idx", F.ntile(4).over(Window.partitionBy("book_id").orderBy("chunk_idx")).alias("block"))
    return rows.groupBy("book_id", "block").agg(F.min("chunk_idx").alias("first"), F.max("chunk_idx").alias("last"), F.count("*").alias("n"))


def evidence_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir, "evidence").filter("evidence is not null").select("fact_id", fragments(F.col("evidence")).alias("f"))
    return rows.select("fact_id", F.size("f").alias("n"), F.array_max(F.transform("f", F.length)).alias("longest"), F.md5(F.array_join("f", "|")).alias("fragments_md5"))


def name_list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names typed as lists, taken apart: main name and aliases of a record joined as people join them."""
    listed = F.concat_ws("、", "main_name", "aliases")
    rows = table(spark, sf_dir, "alias_records").dropDuplicates(["record_id"]).select("record_id", split_names(listed).alias("names"))
    return rows.select("record_id", F.posexplode("names").alias("place", "name"))


def entity_prescan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent Han 3- and 4-grams of each book; a 3-gram that is mostly part of one 4-gram gives way to it.

    The 80 most frequent of each book are kept (a top-k report).
    """
    texts = table(spark, sf_dir, "documents").filter("text is not null").select("book_id", "text")
    runs = texts.select("book_id", F.explode(F.regexp_extract_all("text", F.lit("[一-鿿]{3,}"), F.lit(0))).alias("r"))
    grams = runs.select("book_id", F.explode(F.concat(ngrams(F.col("r"), 3), ngrams(F.col("r"), 4))).alias("term"))
    counts = grams.groupBy("book_id", "term").agg(F.count("*").alias("n")).filter(F.col("n") >= F.when(F.length("term") == 3, 8).otherwise(5))
    longer = counts.filter(F.length("term") == 4)
    parts = longer.select("book_id", F.col("n").alias("m"), F.explode(F.array(F.substring("term", 1, 3), F.substring("term", 2, 3))).alias("term"))
    covered = counts.join(parts, ["book_id", "term"]).filter("m * 10 >= n * 8").select("book_id", "term").distinct()
    kept = counts.join(covered, ["book_id", "term"], "left_anti")
    w = Window.partitionBy("book_id").orderBy(F.desc("n"), F.desc(F.length("term")), "term")
    return kept.withColumn("place", F.row_number().over(w)).filter("place <= 80")


def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges between characters of one chunk that a relationship names together.

    Names are found by joining chunk facts with the chunk's own characters, never with all names.
    """
    facts = _facts(spark, sf_dir, "book_id", "chunk_index", "kind", "character_name", "description")
    people = facts.filter("kind = 'characters' and character_name is not null").select("book_id", "chunk_index", F.col("character_name").alias("name")).distinct()
    said = facts.filter("kind = 'relationships' and description is not null").select("fact_id", "book_id", "chunk_index", "description")
    named = said.join(people, ["book_id", "chunk_index"]).filter(F.contains("description", "name")).select("fact_id", "book_id", "name")
    a, b = named.withColumnRenamed("name", "name_a"), named.withColumnRenamed("name", "name_b")
    return a.join(b, ["fact_id", "book_id"]).filter("name_a < name_b").groupBy("book_id", "name_a", "name_b").agg(F.count("*").alias("n"))


def uncovered_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword places of hits that no window of their cluster covers: an anti-join on intervals within the cluster."""
    hits = table(spark, sf_dir, "co_occurrence_hits").dropDuplicates(["hit_id"]).filter("keyword_pos is not null").select("hit_id", "cluster_id", "keyword_pos")
    spans = table(spark, sf_dir, "proximity_clusters").filter("window_start is not null and window_end is not null")
    spans = spans.select("cluster_id", F.least("window_start", "window_end").alias("s"), F.greatest("window_start", "window_end").alias("e"))
    inside = hits.join(spans, "cluster_id").filter("keyword_pos >= s and keyword_pos < e").select("hit_id").distinct()
    return hits.join(inside, "hit_id", "left_anti").groupBy("cluster_id").agg(F.count("*").alias("uncovered"), F.min("keyword_pos").alias("first"))


def outline_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter titles of each book; of more than ten, the first and the last five."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("book_id", "chunk_idx", F.posexplode(F.split(normalize_newlines(F.col("text")), "\n", -1)).alias("no", "line"))
    titles = docs.select("book_id", "chunk_idx", "no", strip(F.col("line")).alias("title")).filter(F.col("title").rlike(f"^{NOVEL.heading}"))
    w = Window.partitionBy("book_id")
    ranked = titles.select("*", F.row_number().over(w.orderBy("chunk_idx", "no")).alias("chapter"), F.count("*").over(w).alias("n"))
    return ranked.filter("n <= 10 or chapter <= 5 or chapter > n - 5").select("book_id", "chapter", "chunk_idx", "title")


def book_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 distinct entries of each book over four kinds of facts, in order (a capped report)."""
    rows = _facts(spark, sf_dir, "book_id", "chunk_index", "kind", "event", "description").filter("kind in ('events', 'foreshadowing', 'relationships', 'risk_facts')")
    rows = rows.select("book_id", "chunk_index", "kind", F.md5(F.coalesce("event", "description", F.lit(""))).alias("entry_md5")).distinct()
    w = Window.partitionBy("book_id").orderBy("chunk_index", "kind", "entry_md5")
    return rows.withColumn("place", F.row_number().over(w)).filter("place <= 25")


def key_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 strongest events of each book: points for confidence, full evidence and dense words, three words at most."""
    rows = _facts(spark, sf_dir, "book_id", "chunk_index", "event", "evidence", "confidence").filter("event is not null")
    points = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 1).otherwise(0) + (F.coalesce(F.length("evidence"), F.lit(0)) >= 60).cast("int") + F.least(F.lit(3), count_present(F.col("event"), NOVEL.dense)) * 2
    scored = rows.select("book_id", "fact_id", "chunk_index", points.alias("points"))
    w = Window.partitionBy("book_id").orderBy(F.desc("points"), "chunk_index", "fact_id")
    return scored.withColumn("place", F.row_number().over(w)).filter("place <= 15")


QUERIES = {
    f.__name__: f
    for f in (
        keep_first_dedup, keep_last_n, checkpoint_delta_merge, knowledge_base_counts, fact_confidence_levels, valid_facts, contradiction_pairs, temporal_match_candidates, temporal_match_greedy,
        foreshadow_stats, neighbour_chunk_context, manifest_diff_reuse, manifest_diff_rescan, chunk_result_reuse, cooccurrence_proximity, cluster_overlaps, dimension_sets, partner_tristate_merge,
        coverage_two_way, verdict_split, alias_components, typo_name_pairs, tfidf_cosine_pairs, json_lenient_parse, json_diagnosis_flags, evidence_anchor, rolling_context_state, scan_memory_state,
        character_accumulation, segment_summaries, worker_blocks, evidence_fragments, name_list_split, entity_prescan_tokens, relation_edges, uncovered_keywords, outline_ends, book_timeline, key_scenes,
    )
}

_F = "(SELECT DISTINCT ON (fact_id) * FROM chunk_facts)"
_HASH = "substring(sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 16)"
_PERSON = "trim(regexp_replace(translate(heroine_name, '，；：　\"''“”‘’', ',;: '), '\\s+', ' ', 'g'), ' ')"
_CORE = f"substring(regexp_replace(regexp_replace({_PERSON}, '[\\s\"''“”‘’]+', '', 'g'), '[（(][^）)]*[）)]', '', 'g'), 1, 80)"
_MANIFEST = f"(SELECT doc_id, {_HASH} AS hash, crawled_at < TIMESTAMP '2024-05-01' AS old FROM documents WHERE text IS NOT NULL)"
_RULE_A = " UNION ALL ".join(f"SELECT book_id, chunk_index, fact_id AS fact_a, '{r[0]}' AS rule FROM f WHERE kind = '{r[1]}' AND regexp_matches(s, '{r[2]}')" for r in RULES)
_RULE_B = " UNION ALL ".join(f"SELECT book_id, chunk_index, fact_id AS fact_b, '{r[0]}' AS rule FROM f WHERE kind = '{r[3]}' AND regexp_matches(s, '{r[4]}')" for r in RULES)
_GRAMS2 = "list_distinct(list_transform(range(1, greatest(length(s), 1)), lambda i: substring(s, i::INT, 2)))"
_CANDIDATES = f"""
  WITH t AS (SELECT book_id, chunk_index, kind, fact_id, regexp_extract(s, '([A-Z][0-9]+号..)', 1) AS thing, {_GRAMS2} AS g FROM (SELECT *, coalesce(event, description) AS s FROM {_F})),
  p AS (SELECT a.book_id, a.thing, a.fact_id AS planted, a.chunk_index AS planted_at, b.fact_id AS resolved, b.chunk_index AS resolved_at,
      CAST(floor(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) * 10000) AS BIGINT) AS score
    FROM t a JOIN t b ON a.book_id = b.book_id AND a.thing = b.thing AND a.chunk_index < b.chunk_index WHERE a.thing <> '' AND a.kind = 'foreshadowing' AND b.kind = 'events')
  SELECT * FROM p WHERE score >= 800
"""

SQL = {
    "keep_first_dedup": f"SELECT book_id, md5(evidence) AS evidence_md5, min(fact_id) AS fact_id, arg_min(kind, fact_id) AS kind FROM {_F} WHERE evidence IS NOT NULL GROUP BY ALL",
    "keep_last_n": f"SELECT fact_id, book_id, kind, chunk_index FROM {_F} QUALIFY row_number() OVER (PARTITION BY book_id, kind ORDER BY chunk_index DESC, fact_id DESC) <= 5",
    "checkpoint_delta_merge": "SELECT fact_id, arg_max(source, (ingested_at, source)) AS source, arg_max(coalesce(confidence, chr(1)), (ingested_at, source)) AS c, count(*) AS deliveries FROM chunk_facts GROUP BY fact_id",
    "knowledge_base_counts": f"SELECT book_id, kind, count(*) AS facts, count(DISTINCT md5(coalesce(event, description, fact, character_name, ''))) AS distinct_facts FROM {_F} GROUP BY ALL",
    "fact_confidence_levels": f"""
        WITH s AS (SELECT fact_id, CASE WHEN length(evidence) >= 20 THEN 3 WHEN length(evidence) > 0 THEN 1 ELSE 0 END + CASE lower(confidence) WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END
            + CASE source WHEN 'scan_full' THEN 2 WHEN 'rescan' THEN 1 ELSE 0 END AS score FROM {_F})
        SELECT *, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS level FROM s""",
    "valid_facts": f"""
        WITH r AS (SELECT kind, source, evidence, coalesce(event, description, fact, character_name) AS t FROM {_F})
        SELECT kind, source, CASE WHEN t IS NULL OR NOT regexp_matches(t, '\\S') THEN 'empty' WHEN length(t) > 500 THEN 'too_long' WHEN evidence IS NULL THEN 'no_evidence'
            WHEN contains(evidence, chr(65533)) THEN 'broken_evidence' ELSE 'ok' END AS reason, count(*) AS n FROM r GROUP BY ALL""",
    "contradiction_pairs": f"""
        WITH f AS (SELECT *, coalesce(event, description, fact) AS s FROM {_F}), a AS ({_RULE_A}), b AS ({_RULE_B})
        SELECT book_id, chunk_index, rule, fact_a, fact_b FROM a JOIN b USING (book_id, chunk_index, rule) WHERE fact_a <> fact_b""",
    "temporal_match_candidates": _CANDIDATES,
    "foreshadow_stats": f"""
        WITH p AS (SELECT book_id, fact_id AS planted FROM (SELECT *, coalesce(event, description) AS s FROM {_F}) WHERE kind = 'foreshadowing' AND regexp_extract(s, '([A-Z][0-9]+号..)', 1) <> ''),
        m AS (SELECT planted, min(resolved_at - planted_at) AS distance FROM ({_CANDIDATES}) GROUP BY planted)
        SELECT book_id, count(*) AS planted, count(distance) AS matched, min(distance) AS shortest, max(distance) AS longest, sum(distance)::BIGINT AS total FROM p LEFT JOIN m USING (planted) GROUP BY book_id""",
    "neighbour_chunk_context": """
        SELECT book_id, chunk_idx, length(text) AS n_chars, md5(lag(right(text, 80)) OVER w) AS before_md5, md5(lead(left(text, 80)) OVER w) AS after_md5
        FROM documents WINDOW w AS (PARTITION BY book_id ORDER BY chunk_idx)""",
    "manifest_diff_reuse": f"SELECT doc_id, hash FROM {_MANIFEST} WHERE NOT old AND hash IN (SELECT hash FROM {_MANIFEST} WHERE old)",
    "manifest_diff_rescan": f"SELECT doc_id, hash FROM {_MANIFEST} WHERE NOT old AND hash NOT IN (SELECT hash FROM {_MANIFEST} WHERE old)",
    "chunk_result_reuse": f"""
        WITH d AS (SELECT doc_id, book_id, chunk_idx, {_HASH} AS hash FROM documents WHERE text IS NOT NULL), f AS (SELECT hash, min(doc_id) AS first FROM d GROUP BY hash),
        n AS (SELECT book_id, chunk_index AS chunk_idx, count(*) AS facts FROM {_F} GROUP BY ALL)
        SELECT d.doc_id, f.first, coalesce(n.facts, 0) AS facts FROM d JOIN f USING (hash) JOIN d o ON o.doc_id = f.first LEFT JOIN n ON n.book_id = o.book_id AND n.chunk_idx = o.chunk_idx WHERE d.doc_id <> f.first""",
    "cooccurrence_proximity": """
        WITH h AS (SELECT DISTINCT ON (hit_id) * FROM co_occurrence_hits WHERE chunk_idx IS NOT NULL AND keyword_pos IS NOT NULL AND anchor_pos IS NOT NULL),
        s AS (SELECT book_id, heroine_name, dimension, chunk_idx, hit_id, (CASE WHEN abs(anchor_pos - keyword_pos) < 50 THEN 30 WHEN abs(anchor_pos - keyword_pos) < 100 THEN 20 WHEN abs(anchor_pos - keyword_pos) < 200 THEN 10 ELSE 0 END
            + 10 + CASE WHEN dimension = 'relationship' THEN 15 ELSE 0 END)::INT AS score_x10 FROM h),
        k AS (SELECT * FROM s WHERE score_x10 >= 10 QUALIFY row_number() OVER (PARTITION BY book_id, heroine_name, dimension, chunk_idx ORDER BY hit_id) = 1),
        p AS (SELECT *, (row_number() OVER (PARTITION BY book_id, heroine_name, dimension ORDER BY chunk_idx))::INT AS place FROM k)
        SELECT * FROM p WHERE place <= 4""",
    "cluster_overlaps": """
        WITH c AS (SELECT cluster_id, min(book_id) AS book_id, min(chunk_idx) AS chunk_idx FROM co_occurrence_hits WHERE chunk_idx IS NOT NULL GROUP BY 1),
        r AS (SELECT c.book_id, c.chunk_idx, cluster_id, least(window_start, window_end) AS s, greatest(window_start, window_end) AS e FROM proximity_clusters p JOIN c USING (cluster_id) WHERE window_start IS NOT NULL AND window_end IS NOT NULL),
        n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY book_id, chunk_idx ORDER BY s, e, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
        i AS (SELECT *, (sum(new) OVER (PARTITION BY book_id, chunk_idx ORDER BY s, e, cluster_id ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM n)
        SELECT book_id, chunk_idx, island, min(s) AS start, max(e) AS "end", count(*) AS windows FROM i GROUP BY ALL""",
    "dimension_sets": "SELECT array_to_string(list_sort(list_distinct(all_dimensions)), '|') AS dims, count(*) AS n FROM proximity_clusters WHERE all_dimensions IS NOT NULL GROUP BY 1",
    "partner_tristate_merge": f"""
        WITH e AS (SELECT DISTINCT ON (entry_id) * FROM chunk_heroine_entries WHERE heroine_name IS NOT NULL)
        SELECT book_id, {_CORE} AS name_key, md5(arg_max(heroine_name, (length(heroine_name), heroine_name))) AS longest_md5, count(*) AS n, bool_or(is_free_rider) AS free_rider FROM e GROUP BY ALL""",
    "coverage_two_way": """
        WITH a AS (SELECT DISTINCT book_id, heroine_name AS name FROM chunk_heroine_entries WHERE heroine_name IS NOT NULL), b AS (SELECT DISTINCT book_id, canonical_name AS name FROM heroine_candidates WHERE canonical_name IS NOT NULL)
        SELECT *, 'left_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "verdict_split": """
        WITH v AS (SELECT main_name, max(mentions) AS mentions FROM alias_records WHERE main_name IS NOT NULL GROUP BY 1), c AS (SELECT DISTINCT ON (candidate_id) * FROM heroine_candidates)
        SELECT candidate_id, CASE WHEN mentions IS NULL THEN 'pending' WHEN mentions >= 5 THEN 'verified' ELSE 'rejected' END AS verdict FROM c LEFT JOIN v ON canonical_name = main_name""",
    "typo_name_pairs": """
        WITH n AS (SELECT DISTINCT book_id, canonical_name AS name FROM heroine_candidates WHERE canonical_name IS NOT NULL AND book_id IS NOT NULL AND length(canonical_name) > 1)
        SELECT a.book_id, a.name AS name_a, b.name AS name_b FROM n a JOIN n b ON a.book_id = b.book_id AND a.name < b.name
        WHERE a.name = b.name OR list_has_any(list_concat([a.name], list_transform(range(1, length(a.name) + 1), lambda i: left(a.name, (i - 1)::INT) || substring(a.name, (i + 1)::INT))),
          list_concat([b.name], list_transform(range(1, length(b.name) + 1), lambda i: left(b.name, (i - 1)::INT) || substring(b.name, (i + 1)::INT))))
          AND abs(length(a.name) - length(b.name)) <= 1
          AND (length(a.name) <> length(b.name) OR list_sum(list_transform(range(1, length(a.name) + 1), lambda i: (substring(a.name, i::INT, 1) <> substring(b.name, i::INT, 1))::INT)) <= 1)""",
    "tfidf_cosine_pairs": """
        WITH p AS (SELECT item_id, regexp_replace(lower(passage), '[\\s\\p{P}]+', '', 'g') AS p FROM eval_passages), g AS (SELECT DISTINCT item_id, substring(p, i::INT, 3) AS g FROM p, unnest(range(1, length(p) - 1)) r(i)),
        d AS (SELECT g FROM g GROUP BY g HAVING count(*) BETWEEN 2 AND 20), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1), k AS (SELECT item_id, g FROM g SEMI JOIN d USING (g)),
        s AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS shared FROM k a JOIN k b ON a.g = b.g AND a.item_id < b.item_id GROUP BY ALL)
        SELECT item_a, item_b, shared, CAST(floor(shared * shared * 1000000 / (na.n * nb.n)) AS BIGINT) AS cosine2_ppm FROM s JOIN n na ON na.item_id = item_a JOIN n nb ON nb.item_id = item_b WHERE shared >= 5""",
    "character_accumulation": f"""
        SELECT book_id, character_name, sum(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)::BIGINT AS score, count(*) AS n, count(DISTINCT chunk_index) AS chunks, min(chunk_index) AS first_chunk, max(chunk_index) AS last_chunk
        FROM {_F} WHERE kind = 'characters' AND character_name IS NOT NULL GROUP BY ALL""",
    "segment_summaries": f"""
        WITH r AS (SELECT book_id, chunk_index // 50 AS segment, event, row_number() OVER (PARTITION BY book_id, chunk_index // 50 ORDER BY chunk_index, fact_id) AS r FROM {_F} WHERE event IS NOT NULL)
        SELECT book_id, segment, md5(string_agg(event, '；' ORDER BY r) FILTER (r <= 5)) AS summary_md5, count(*) AS events FROM r GROUP BY ALL""",
    "evidence_fragments": f"""
        WITH r AS (SELECT fact_id, regexp_extract_all(evidence, '[“「]([^”」]+)[”」]', 1) AS q, list_transform(regexp_split_to_array(evidence, '……|…|[、,，；;。！？!?]'), lambda x: trim(x, ' ')) AS p FROM {_F} WHERE evidence IS NOT NULL),
        o AS (SELECT fact_id, CASE WHEN len(q) > 0 THEN q ELSE p END AS f FROM r), u AS (SELECT fact_id, list_filter(f, lambda x, i: length(x) >= 2 AND list_position(f, x) = i) AS f FROM o)
        SELECT fact_id, len(f) AS n, list_max(list_transform(f, lambda x: length(x))) AS longest, md5(array_to_string(f, '|')) AS fragments_md5 FROM u""",
    "entity_prescan_tokens": """
        WITH r AS (SELECT book_id, unnest(regexp_extract_all(text, '[一-鿿]{3,}')) AS r FROM documents WHERE text IS NOT NULL),
        g AS (SELECT book_id, substring(r, i::INT, 3) AS term FROM r, unnest(range(1, length(r) - 1)) t(i) UNION ALL SELECT book_id, substring(r, i::INT, 4) FROM r, unnest(range(1, length(r) - 2)) t(i)),
        c AS (SELECT book_id, term, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= CASE WHEN length(term) = 3 THEN 8 ELSE 5 END),
        p AS (SELECT book_id, n AS m, unnest([left(term, 3), right(term, 3)]) AS term FROM c WHERE length(term) = 4),
        k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.book_id = c.book_id AND p.term = c.term AND p.m * 10 >= c.n * 8))
        SELECT book_id, term, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, length(term) DESC, term) AS place FROM k) WHERE place <= 80""",
    "relation_edges": f"""
        WITH f AS {_F}, p AS (SELECT DISTINCT book_id, chunk_index, character_name AS name FROM f WHERE kind = 'characters' AND character_name IS NOT NULL),
        n AS (SELECT f.fact_id, f.book_id, p.name FROM f JOIN p USING (book_id, chunk_index) WHERE f.kind = 'relationships' AND contains(f.description, p.name))
        SELECT a.book_id, a.name AS name_a, b.name AS name_b, count(*) AS n FROM n a JOIN n b ON a.fact_id = b.fact_id AND a.name < b.name GROUP BY ALL""",
    "uncovered_keywords": """
        WITH h AS (SELECT DISTINCT ON (hit_id) hit_id, cluster_id, keyword_pos FROM co_occurrence_hits WHERE keyword_pos IS NOT NULL)
        SELECT cluster_id, count(*) AS uncovered, min(keyword_pos) AS first FROM h WHERE NOT EXISTS (SELECT 1 FROM proximity_clusters p WHERE p.cluster_id = h.cluster_id
          AND keyword_pos >= least(window_start, window_end) AND keyword_pos < greatest(window_start, window_end) AND window_start IS NOT NULL AND window_end IS NOT NULL) GROUP BY 1""",
    "alias_components": """
        WITH RECURSIVE c AS (SELECT DISTINCT ON (candidate_id) * FROM heroine_candidates WHERE canonical_name IS NOT NULL AND aliases IS NOT NULL AND book_id IS NOT NULL),
        e0 AS (SELECT book_id, trim(canonical_name, ' ') AS a, trim(unnest(aliases), ' ') AS b FROM c),
        ok AS (SELECT n FROM (SELECT a AS n FROM e0 UNION SELECT b FROM e0) WHERE n IS NOT NULL AND length(n) BETWEEN 2 AND 20 AND NOT regexp_matches(n, '姑娘|夫人|小姐')
               AND n NOT IN ('她', '他', '我', '你', '师姐', '师妹', '夫人', '小姐', '姑娘', '那位姑娘', '女子', '少女')),
        e1 AS (SELECT DISTINCT book_id, a, b FROM e0 WHERE a IN (SELECT n FROM ok) AND b IN (SELECT n FROM ok) AND a <> b),
        e AS (SELECT book_id, a, b FROM e1 UNION SELECT book_id, b, a FROM e1),
        r AS (SELECT DISTINCT book_id, a AS n, a AS m FROM e UNION SELECT r.book_id, e.b, r.m FROM r JOIN e ON r.book_id = e.book_id AND r.n = e.a),
        l AS (SELECT book_id, n AS name, min(m) AS label FROM r GROUP BY ALL),
        w AS (SELECT book_id, trim(canonical_name, ' ') AS name, count(*) AS w FROM c GROUP BY ALL),
        k AS (SELECT l.*, coalesce(w.w, 0) AS w FROM l LEFT JOIN w USING (book_id, name)),
        b AS (SELECT book_id, label, arg_max(name, (w, (length(name) BETWEEN 2 AND 4)::INT, -length(name), name)) AS canonical FROM k GROUP BY ALL)
        SELECT book_id, name, canonical FROM l JOIN b USING (book_id, label)""",
    "outline_ends": f"""
        WITH l AS (SELECT book_id, chunk_idx, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line,
                     generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
        t AS (SELECT book_id, chunk_idx, no, regexp_replace(line, '^[ \\t\u3000]+|[ \\t\u3000]+$', '', 'g') AS title FROM l),
        r AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY chunk_idx, no))::INT AS chapter, count(*) OVER (PARTITION BY book_id) AS n FROM t WHERE regexp_matches(title, '^{NOVEL.heading}'))
        SELECT book_id, chapter, chunk_idx, title FROM r WHERE n <= 10 OR chapter <= 5 OR chapter > n - 5""",
    "book_timeline": f"""
        WITH r AS (SELECT DISTINCT book_id, chunk_index, kind, md5(coalesce(event, description, '')) AS entry_md5 FROM {_F} WHERE kind IN ('events', 'foreshadowing', 'relationships', 'risk_facts'))
        SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY chunk_index, kind, entry_md5))::INT AS place FROM r QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY chunk_index, kind, entry_md5) <= 25""",
    "key_scenes": f"""
        WITH r AS (SELECT book_id, fact_id, chunk_index, (CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 1 ELSE 0 END + (coalesce(length(evidence), 0) >= 60)::INT
            + least(3, {" + ".join(f"contains(event, '{w}')::INT" for w in NOVEL.dense)}) * 2)::INT AS points FROM {_F} WHERE event IS NOT NULL),
        p AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY points DESC, chunk_index, fact_id))::INT AS place FROM r)
        SELECT * FROM p WHERE place <= 15""",
    "worker_blocks": """
        SELECT book_id, block::INT AS block, min(chunk_idx) AS first, max(chunk_idx) AS last, count(*) AS n FROM (SELECT book_id, chunk_idx, ntile(4) OVER (PARTITION BY book_id ORDER BY chunk_idx) AS block FROM documents) GROUP BY ALL""",
}
SQL["checkpoint_delta_merge"] = "SELECT fact_id, source, nullif(c, chr(1)) AS confidence, deliveries FROM (" + SQL["checkpoint_delta_merge"] + ")"
