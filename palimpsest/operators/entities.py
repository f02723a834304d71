"""Conservative alias maps: safe names, links between them, the smallest label of each group, a canonical name.

Generic words, pronouns, one-character and very long names are unsafe and tie nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.shared import materialize, release

# Words that name nobody in particular.
GENERIC = ("她", "他", "我", "你", "师姐", "师妹", "夫人", "小姐", "姑娘", "那位姑娘", "女子", "少女")


def alias_safety(name: Column) -> Column:
    """2 for safe names, 1 for doubtful ones that contain a generic word, 0 for those that tie nothing."""
    n = F.length(name)
    bad = name.isNull() | (n < 2) | (n > 20) | name.isin(*GENERIC)
    return F.when(bad, 0).when(name.rlike("姑娘|夫人|小姐"), 1).otherwise(2)


def smallest_labels(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each component of links (a, b), by label propagation with pointer jumps.

    Every round is two aggregations with map-side combine over a written table; labels of labels are followed, so that
    chains halve with each round.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a is not null and b is not null and a <> b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        jump = better.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = materialize(jump.select("node", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = not new.join(labels, ["node", "label"], "left_anti").isEmpty()
        release(labels)
        labels = new
        if not changed:
            release(both)
            return labels
    raise RuntimeError("labels did not settle")


def alias_map(rows: DataFrame, by: str, name: str, aliases: str, weight: Column) -> DataFrame:
    """(by, name, canonical): safe names tied by alias records; the canonical one is the most frequent, then of usual length."""
    pairs = rows.select(by, F.trim(name).alias("n"), F.explode(F.array_distinct(aliases)).alias("o")).select(by, "n", F.trim("o").alias("o"))
    safe = pairs.filter((alias_safety(F.col("n")) == 2) & (alias_safety(F.col("o")) == 2))
    links = safe.select(F.concat_ws("\u0001", by, "n").alias("a"), F.concat_ws("\u0001", by, "o").alias("b"))
    groups = smallest_labels(links)
    named = groups.select("label", F.substring_index("node", "\u0001", 1).cast("bigint").alias(by), F.substring_index("node", "\u0001", -1).alias("name"))
    counts = rows.groupBy(by, F.trim(name).alias("name")).agg(weight.alias("w"))
    ranked = named.join(counts, [by, "name"], "left").na.fill(0, ["w"])
    usual = F.length("name").between(2, 4).cast("int")
    best = ranked.groupBy("label").agg(F.max_by("name", F.struct("w", usual, -F.length("name"), "name")).alias("canonical"))
    return named.join(best, "label").select(by, "name", "canonical")
