"""Record sets: keep-first and keep-last, content-hash reuse, coverage both ways, delta logs, partial merges.

Defined results: rows with a NULL key are a group of their own where grouped, and match nothing where joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order; the smallest struct is aggregated map-side, no window is sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*")


def keep_last_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group in order."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def reuse(new: DataFrame, old: DataFrame, hash_: str) -> DataFrame:
    """Rows of ``new`` whose content the old version holds."""
    return new.join(old.select(hash_).distinct(), hash_, "left_semi")


def rescan(new: DataFrame, old: DataFrame, hash_: str) -> DataFrame:
    """Rows of ``new`` whose content is new; a NULL hash is always new."""
    return new.join(old.select(hash_).distinct(), hash_, "left_anti")


def coverage(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on, side): keys of either side that the other one lacks."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("right_only")))


def merge_deltas(deltas: DataFrame, keys: list[str], version: list[Column]) -> DataFrame:
    """The latest delta of each key: a snapshot of an append-only log."""
    rest = [c for c in deltas.columns if c not in keys]
    return deltas.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r")).select(*keys, "__r.*")


def tri_state(flag: Column) -> Column:
    """Aggregate: true if any is true, else false if any is false, else NULL."""
    return F.max(flag.cast("int")).cast("boolean")
