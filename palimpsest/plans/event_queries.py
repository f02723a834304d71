"""Queries over events and the order tables: ordered analytics, ranking, rules, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import windows as W
from palimpsest.operators.windows import cents, epoch
from palimpsest.sources import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def reading_metrics_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and sample deviation of positive values, share of types, confidence by the number of values."""
    v = F.when(F.col("value") > 0, cents(F.col("value")))
    rows = _events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count(v).alias("n_valid"),
        F.sum(v).alias("s"),
        F.sum(v * v).alias("sq"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("payoffs"),
        F.count(F.when(F.col("value") >= 70, 1)).alias("tense"),
    )
    std = F.floor(F.sqrt((F.col("n_valid") * F.col("sq") - F.col("s") * F.col("s")) / F.greatest(F.col("n_valid") * (F.col("n_valid") - 1), F.lit(1)))).cast("bigint")
    mean = F.when(F.col("n_valid") > 0, F.floor(F.col("s") / F.col("n_valid"))).otherwise(0).cast("bigint")
    enough = F.when(F.col("n") < 5, 0).otherwise(F.least(F.lit(100), F.floor(F.col("n_valid") * 100 / 30))).cast("bigint")
    return rows.select("user_id", "n", "n_valid", mean.alias("mean_cents"), F.coalesce(std, F.lit(0)).alias("std_cents"), "payoffs", "tense", enough.alias("confidence"))


def trend_half_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.half_trend(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value")


def low_activity_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.low_islands(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("value") < 30)


def session_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("sec", epoch("ts"))
    return W.session_gaps(rows, "user_id", "sec", "event_id", 3600)


def anchored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("sec", epoch("ts"))
    return W.anchored_clusters(rows, "user_id", "sec", 7200)


def asof_event_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the user's latest purchase before it."""
    rows = _events(spark, sf_dir)
    latest = W.asof_latest(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", "event_id")
    return rows.withColumn("purchase_id", latest).filter("event_type = 'error'").select("event_id", "purchase_id")


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("book_id", "chunk_idx", "doc_id")
    return W.uniform_sample(rows, "book_id", ["chunk_idx"], 12).select("book_id", "chunk_idx", "doc_id")


def content_aware_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("book_id", "chunk_idx", F.coalesce(F.regexp_count("text", F.lit("[！!]")), F.lit(0)).alias("signal"))
    return W.content_aware_sample(rows, "book_id", ["chunk_idx"], "signal", 20, 13).select("book_id", "chunk_idx", "signal")


def two_stage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-value events and every 20th of each user's others (a sampling operator)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, sf_dir).select("event_id", "user_id", "value", (F.row_number().over(w) - 1).alias("rn"))
    return rows.filter((F.col("value") >= 95) | (F.col("rn") % 20 == 0)).select("event_id", "user_id", "rn")


def level_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("value") >= 70, "high").when(F.col("value") < 30, "low").otherwise("medium")
    return W.level_changes(_events(spark, sf_dir), "user_id", ["ts", "event_id"], level)


def rate_limit_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.rate_limit(_events(spark, sf_dir), "event_type", "ts", cents(F.col("value")), 600, 3)
    return rows.select("event_id", "recent", "recent_size", "limited")


def cooldown_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors within a debounce make one incident; the k-th incident of a user cools down 30 * 2^k seconds, 300 at most."""
    rows = _events(spark, sf_dir).filter("event_type = 'error'").withColumn("sec", epoch("ts"))
    found = W.session_gaps(rows, "user_id", "sec", "event_id", 1800)
    wait = F.least(F.lit(300), F.lit(30) * F.pow(F.lit(2.0), F.least(F.col("cluster") - 1, F.lit(10)))).cast("int")
    return found.select("user_id", F.col("cluster").alias("incident"), "n", "first", wait.alias("wait_s"))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", cents(F.col("value")).alias("v"))
    return rows.rollup("user_id", "day", "event_type").agg(F.sum("v").alias("size"), F.count("*").alias("calls"), F.grouping_id().cast("bigint").alias("level"))


def failure_reason_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten reasons of failures by an ordered CASE over the message, with the latest time."""
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.when(k % 7 == 0, "timeout").when(k < 20, "parse").when(k < 50, "rate_limit").when(k < 80, "connection").otherwise("other")
    rows = _events(spark, sf_dir).filter("event_type = 'error'").select(reason.alias("reason"), "ts")
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.max("ts").cast("string").alias("latest")).orderBy(F.desc("n"), F.desc("latest"), "reason").limit(10).select("reason", "n")


def rank_strong_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance within segment; strong ones are the top min(max(12, 15 %), 40)."""
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.row_number().over(w).alias("rank"), F.count("*").over(Window.partitionBy("c_mktsegment")).alias("n"))
    strong = F.least(F.greatest(F.lit(12), F.floor(F.col("n") * 15 / 100 + 0.5)), F.lit(40), F.col("n"))
    return rows.select("c_custkey", "c_mktsegment", "rank", (F.col("rank") <= strong).alias("strong"))


def percentile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation: the balance at place n div 2, and each customer's share of balances not above theirs."""
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("c_nationkey")).alias("n"))
    return rows.filter("rn = floor(n / 2) + 1").select("c_nationkey", "n", cents(F.col("c_acctbal")).alias("median_cents"))


def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders of each priority in queue order: explicit place first, then date, then id."""
    place = F.when(F.col("o_custkey") % 5 == 0, F.col("o_custkey"))
    w = Window.partitionBy("o_orderpriority").orderBy(place.asc_nulls_last(), "o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return rows.select("o_orderkey", "o_orderpriority", F.row_number().over(w).alias("position"))


def exclusivity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: four existence rules over its lines, and the order is clean if all hold."""
    rules = {
        "no_return": ~(F.col("l_returnflag") == "R"),
        "no_large": ~(F.col("l_quantity") > 49),
        "no_free": ~(F.col("l_discount") >= 0.1),
        "no_open": ~((F.col("l_linestatus") == "O") & (F.col("l_tax") == 0)),
    }
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.bool_and(c).alias(n) for n, c in rules.items()))
    held = sum((F.col(n).cast("int") for n in rules), F.lit(0))
    return rows.select("*", (held == 4).alias("clean"), held.alias("held"))


def severity_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most severe level per part and its reason: first match of a ladder, then the maximum."""
    level = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08), 4).when(F.col("l_returnflag") == "R", 3).when(F.col("l_discount") > 0.08, 2).when(F.col("l_tax") > 0.06, 1).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", level.alias("level"), "l_orderkey", "l_linenumber")
    best = F.max_by(F.struct("l_orderkey", "l_linenumber"), F.struct("level", -F.col("l_orderkey"), -F.col("l_linenumber")))
    return rows.groupBy("l_partkey").agg(F.max("level").alias("level"), best.alias("w")).select("l_partkey", "level", F.col("w.l_orderkey").alias("order_key"), F.col("w.l_linenumber").alias("line_no"))


def score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores per supplier (x10), fused by how far they differ, with a confidence."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"))
    a = F.floor(100 - F.col("r") * 100 / F.col("n")).cast("bigint")
    b = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(10000.0), F.col("s_acctbal"))) / 100).cast("bigint")
    rows = table(spark, sf_dir, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", a.alias("a"), F.when(F.col("s_acctbal") > 0, b).alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    fused = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), 500)
        .when(F.col("a").isNull(), F.col("b") * 10)
        .when(F.col("b").isNull(), F.col("a") * 10)
        .when(d <= 15, (F.col("a") + F.col("b")) * 5)
        .when(d <= 30, F.col("a") * 6 + F.col("b") * 4)
        .otherwise(F.col("a") * 7 + F.col("b") * 3)
    )
    sure = F.when(F.col("a").isNull() | F.col("b").isNull(), "low").when(d <= 15, "high").otherwise("medium")
    return rows.select("s_suppkey", fused.cast("bigint").alias("fused_x100"), sure.alias("confidence"))


def recommendation_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("clean"), F.count(F.when(F.col("l_discount") >= 0.1, 1)).alias("issues"))
    score = F.floor(F.col("clean") * 500 / F.col("n")) + F.least(F.lit(300), F.floor(F.col("n") * 20)) - F.least(F.lit(200), F.floor(F.col("issues") * 10))
    rows = lines.select(F.col("l_suppkey").alias("s_suppkey"), score.cast("bigint").alias("score_x100"))
    level = F.when(F.col("score_x100") >= 700, "S").when(F.col("score_x100") >= 550, "A").when(F.col("score_x100") >= 400, "B").when(F.col("score_x100") >= 250, "C").otherwise("D")
    return rows.withColumn("level", level)


def cooccurrence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two purchases of each user with an error within 30 minutes before, by one ordered pass."""
    rows = _events(spark, sf_dir).withColumn("sec", epoch("ts"))
    last = W.asof_latest(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "sec")
    hits = rows.withColumn("gap", F.col("sec") - last).filter("event_type = 'purchase' and gap <= 1800")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return hits.select("user_id", "event_id", "gap", F.row_number().over(w).alias("hit")).filter("hit <= 2")


def open_minus_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of users that are viewed and never purchased: a set difference."""
    key = F.get_json_object("props", "$.k").cast("int").alias("k")
    rows = _events(spark, sf_dir).select("user_id", key, "event_type")
    return rows.filter("event_type = 'view'").select("user_id", "k").distinct().join(rows.filter("event_type = 'purchase'").select("user_id", "k").distinct(), ["user_id", "k"], "left_anti")


QUERIES = {
    f.__name__: f
    for f in (
        reading_metrics_by_user, trend_half_means, low_activity_islands, session_gap_clusters, anchored_clusters, asof_event_context, uniform_sample, content_aware_sample,
        two_stage_sample, level_transitions, rate_limit_delays, cooldown_sessions, usage_rollup, failure_reason_summary, rank_strong_threshold, percentile_profile, queue_order,
        exclusivity_rules, severity_level, score_fusion, recommendation_level, cooccurrence_events, open_minus_resolved,
    )
}

_V = "CAST(floor(value * 100 + 0.5::DOUBLE) AS BIGINT)"
_GAPS = """
  SELECT user_id, cluster, min(sec) AS first, max(sec) AS last, count(*) AS n, max(CASE WHEN rn = c // 2 + 1 THEN sec END) AS middle FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, cluster ORDER BY sec, event_id) AS rn, count(*) OVER (PARTITION BY user_id, cluster) AS c FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM (
        SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) <= {gap} THEN 0 ELSE 1 END AS new FROM (
          SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events WHERE {where})))) GROUP BY ALL
"""
_UNIFORM = """
  SELECT * FROM (SELECT {cols}, row_number() OVER (PARTITION BY book_id ORDER BY chunk_idx) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n FROM {src})
  WHERE n <= {k} OR list_contains(list_transform(range({k}), lambda j: round_even(j * (n - 1) / ({k} - 1), 0)::BIGINT), i)
"""

SQL = {
    "reading_metrics_by_user": f"""
        WITH r AS (SELECT user_id, count(*) AS n, count(v) AS n_valid, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS sq, count(*) FILTER (event_type = 'purchase') AS payoffs, count(*) FILTER (value >= 70) AS tense
                   FROM (SELECT *, CASE WHEN value > 0 THEN {_V} END AS v FROM events) GROUP BY user_id)
        SELECT user_id, n, n_valid, CASE WHEN n_valid > 0 THEN CAST(floor(s / n_valid) AS BIGINT) ELSE 0 END AS mean_cents,
          coalesce(CAST(floor(sqrt((n_valid * sq - s * s) / greatest(n_valid * (n_valid - 1), 1))) AS BIGINT), 0) AS std_cents, payoffs, tense,
          CASE WHEN n < 5 THEN 0 ELSE least(100, n_valid * 100 // 30) END AS confidence FROM r""",
    "trend_half_means": f"""
        WITH r AS (SELECT user_id, {_V} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > 0),
        a AS (SELECT user_id, count(*) AS n, sum(v) FILTER (rn <= n // 2)::BIGINT AS s1, sum(v) FILTER (rn > n // 2)::BIGINT AS s2, sum(v)::BIGINT AS s, sum(v * v)::BIGINT AS sq FROM r GROUP BY user_id),
        o AS (SELECT user_id, n, CAST(floor(s1 / (n // 2)) AS BIGINT) AS first_half, CAST(floor(s2 / (n - n // 2)) AS BIGINT) AS second_half,
                CAST(floor(sqrt((n * sq - s * s) / greatest(n * (n - 1), 1))) AS BIGINT) AS std FROM a)
        SELECT *, CASE WHEN n < 6 THEN 'insufficient' WHEN second_half - first_half > CASE WHEN std > 0 THEN std * 3 // 10 ELSE 30 END THEN 'rising'
          WHEN second_half - first_half < -CASE WHEN std > 0 THEN std * 3 // 10 ELSE 30 END THEN 'falling' ELSE 'stable' END AS trend FROM o""",
    "low_activity_islands": """
        WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        l AS (SELECT user_id, rn, rn - row_number() OVER (PARTITION BY user_id ORDER BY rn) AS run FROM r WHERE value < 30)
        SELECT user_id, min(rn) AS first, max(rn) AS last, count(*) AS length FROM l GROUP BY user_id, run HAVING count(*) >= 3""",
    "session_gap_clusters": _GAPS.format(gap=3600, where="true"),
    "asof_event_context": """
        SELECT event_id, purchase_id FROM (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase_id FROM events)
        WHERE event_type = 'error'""",
    "uniform_sample": "SELECT book_id, chunk_idx, doc_id FROM (" + _UNIFORM.format(cols="book_id, chunk_idx, doc_id", src="documents", k=12) + ")",
    "content_aware_sample": f"""
        WITH d AS (SELECT book_id, chunk_idx, coalesce(len(regexp_extract_all(text, '[！!]')), 0) AS signal FROM documents),
        e AS ({_UNIFORM.format(cols="book_id, chunk_idx, signal", src="d", k=13)}),
        r AS (SELECT d.*, e.book_id IS NOT NULL AS even FROM d LEFT JOIN e USING (book_id, chunk_idx)),
        k AS (SELECT *, row_number() OVER (PARTITION BY book_id, even ORDER BY signal DESC, chunk_idx) AS rk FROM r)
        SELECT book_id, chunk_idx, signal FROM k WHERE even OR (signal > 0 AND rk <= 7)""",
    "two_stage_sample": """
        SELECT event_id, user_id, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) WHERE value >= 95 OR rn % 20 = 0""",
    "level_transitions": """
        WITH l AS (SELECT user_id, ts, event_id, CASE WHEN value >= 70 THEN 'high' WHEN value < 30 THEN 'low' ELSE 'medium' END AS to_level FROM events),
        p AS (SELECT *, lag(to_level) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_level FROM l)
        SELECT user_id, from_level, to_level, count(*) AS n FROM p WHERE from_level <> to_level AND to_level <> 'medium' GROUP BY ALL""",
    "rate_limit_delays": f"""
        SELECT event_id, count(*) OVER w AS recent, (sum({_V}) OVER w)::BIGINT AS recent_size, count(*) OVER w > 3 AS limited
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW)""",
    "cooldown_sessions": f"""
        SELECT user_id, cluster AS incident, n, first, least(300, 30 * 2 ^ least(cluster - 1, 10))::INT AS wait_s FROM ({_GAPS.format(gap=1800, where="event_type = 'error'")})""",
    "usage_rollup": f"""
        SELECT user_id, day, event_type, sum(v)::BIGINT AS size, count(*) AS calls, grouping(user_id, day, event_type)::BIGINT AS level
        FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, {_V} AS v FROM events) GROUP BY ROLLUP (user_id, day, event_type)""",
    "failure_reason_summary": """
        WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, ts FROM events WHERE event_type = 'error'),
        r AS (SELECT CASE WHEN k % 7 = 0 THEN 'timeout' WHEN k < 20 THEN 'parse' WHEN k < 50 THEN 'rate_limit' WHEN k < 80 THEN 'connection' ELSE 'other' END AS reason, ts FROM e)
        SELECT reason, n FROM (SELECT reason, count(*) AS n, max(ts) AS latest FROM r GROUP BY reason ORDER BY n DESC, latest DESC, reason LIMIT 10)""",
    "rank_strong_threshold": """
        WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
        SELECT c_custkey, c_mktsegment, rank::INT AS rank, rank <= least(greatest(12, floor(n * 15 / 100 + 0.5::DOUBLE)), 40, n) AS strong FROM r""",
    "percentile_profile": """
        WITH r AS (SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
        SELECT c_nationkey, n, CAST(floor(c_acctbal * 100 + 0.5::DOUBLE) AS BIGINT) AS median_cents FROM r WHERE rn = n // 2 + 1""",
    "queue_order": """
        SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_custkey % 5 = 0 THEN o_custkey END ASC NULLS LAST, o_orderdate, o_orderkey))::INT AS position
        FROM orders WHERE o_orderstatus = 'O'""",
    "exclusivity_rules": """
        WITH r AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS no_return, bool_and(NOT l_quantity > 49) AS no_large, bool_and(NOT l_discount >= 0.1::DOUBLE) AS no_free,
                     bool_and(NOT (l_linestatus = 'O' AND l_tax = 0)) AS no_open FROM lineitem GROUP BY l_orderkey)
        SELECT *, no_return AND no_large AND no_free AND no_open AS clean, no_return::INT + no_large::INT + no_free::INT + no_open::INT AS held FROM r""",
    "severity_level": """
        WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_discount > 0.08::DOUBLE THEN 4 WHEN l_returnflag = 'R' THEN 3 WHEN l_discount > 0.08::DOUBLE THEN 2 WHEN l_tax > 0.06::DOUBLE THEN 1 ELSE 0 END AS level FROM lineitem)
        SELECT l_partkey, level, l_orderkey AS order_key, l_linenumber AS line_no FROM r QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY level DESC, l_orderkey, l_linenumber) = 1""",
    "score_fusion": """
        WITH l AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey),
        s AS (SELECT s_suppkey, CAST(floor(100 - r * 100 / n) AS BIGINT) AS a, CASE WHEN s_acctbal > 0 THEN CAST(floor(greatest(0, least(10000, s_acctbal)) / 100) AS BIGINT) END AS b FROM supplier LEFT JOIN l ON s_suppkey = l_suppkey)
        SELECT s_suppkey, (CASE WHEN a IS NULL AND b IS NULL THEN 500 WHEN a IS NULL THEN b * 10 WHEN b IS NULL THEN a * 10 WHEN abs(a - b) <= 15 THEN (a + b) * 5
            WHEN abs(a - b) <= 30 THEN a * 6 + b * 4 ELSE a * 7 + b * 3 END)::BIGINT AS fused_x100,
          CASE WHEN a IS NULL OR b IS NULL THEN 'low' WHEN abs(a - b) <= 15 THEN 'high' ELSE 'medium' END AS confidence FROM s""",
    "recommendation_level": """
        WITH l AS (SELECT l_suppkey AS s_suppkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS clean, count(*) FILTER (l_discount >= 0.1::DOUBLE) AS issues FROM lineitem GROUP BY 1),
        s AS (SELECT s_suppkey, (clean * 500 // n + least(300, n * 20) - least(200, issues * 10))::BIGINT AS score_x100 FROM l)
        SELECT *, CASE WHEN score_x100 >= 700 THEN 'S' WHEN score_x100 >= 550 THEN 'A' WHEN score_x100 >= 400 THEN 'B' WHEN score_x100 >= 250 THEN 'C' ELSE 'D' END AS level FROM s""",
    "cooccurrence_events": """
        WITH r AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
        g AS (SELECT *, sec - last_value(CASE WHEN event_type = 'error' THEN sec END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS gap FROM r),
        h AS (SELECT user_id, event_id, gap, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS hit FROM g WHERE event_type = 'purchase' AND gap <= 1800)
        SELECT * FROM h WHERE hit <= 2""",
    "open_minus_resolved": """
        WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type FROM events)
        SELECT DISTINCT user_id, k FROM e WHERE event_type = 'view' EXCEPT SELECT user_id, k FROM e WHERE event_type = 'purchase'""",
}
