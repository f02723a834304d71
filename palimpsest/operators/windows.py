"""Ordered analytics: trends, islands, session gaps, anchored clusters, as-of values, limits and samples.

Sums over money-like doubles are taken in whole hundredths, so that results don't depend on the order of addition.
Defined results: rows with a NULL order key come first, as in the session's order; ties are broken by the id given.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(value: Column) -> Column:
    return F.floor(value * 100 + 0.5).cast("bigint")


def epoch(ts: str, unit: str = "SECOND") -> Column:
    """Whole units since 1970 of a timestamp's own fields, whatever the session's time zone."""
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def half_trend(df: DataFrame, by: str, order: list[str], value: str, least: int = 6) -> DataFrame:
    """Means of the first and second half of the positive values in order, and the direction between them."""
    w = Window.partitionBy(by).orderBy(*order)
    whole = Window.partitionBy(by)
    rows = df.filter(F.col(value) > 0).select(by, *order, cents(F.col(value)).alias("v"))
    rows = rows.select(by, "v", F.row_number().over(w).alias("rn"), F.count("*").over(whole).alias("n"))
    half = F.floor(F.col("n") / 2)
    agg = rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("rn") <= half, F.col("v"))).alias("s1"),
        F.sum(F.when(F.col("rn") > half, F.col("v"))).alias("s2"),
        F.sum("v").alias("s"),
        F.sum(F.col("v") * F.col("v")).alias("sq"),
    )
    h = F.floor(F.col("n") / 2)
    first, second = F.floor(F.col("s1") / h).cast("bigint"), F.floor(F.col("s2") / (F.col("n") - h)).cast("bigint")
    std = F.floor(F.sqrt((F.col("n") * F.col("sq") - F.col("s") * F.col("s")) / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1)))).cast("bigint")
    out = agg.select(by, "n", first.alias("first_half"), second.alias("second_half"), std.alias("std"))
    limit = F.when(F.col("std") > 0, F.floor(F.col("std") * 3 / 10)).otherwise(30)
    change = F.col("second_half") - F.col("first_half")
    trend = F.when(F.col("n") < least, "insufficient").when(change > limit, "rising").when(change < -limit, "falling").otherwise("stable")
    return out.withColumn("trend", trend)


def low_islands(df: DataFrame, by: str, order: list[str], low: Column, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` consecutive low rows: their first and last place and length."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.select(by, F.row_number().over(w).alias("rn"), low.alias("low")).filter("low")
    runs = rows.select(by, "rn", (F.col("rn") - F.row_number().over(Window.partitionBy(by).orderBy("rn"))).alias("run"))
    out = runs.groupBy(by, "run").agg(F.min("rn").alias("first"), F.max("rn").alias("last"), F.count("*").alias("length"))
    return out.filter(F.col("length") >= least).select(by, "first", "last", "length")


def session_gaps(df: DataFrame, by: str, at: str, tie: str, gap: int) -> DataFrame:
    """Clusters of rows whose distance to the row before is at most ``gap``; (by, cluster, first, last, n, middle)."""
    w = Window.partitionBy(by).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    rows = df.select(by, at, tie, new.alias("new"))
    rows = rows.select(by, at, tie, F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))
    inside = Window.partitionBy(by, "cluster")
    rows = rows.select("*", F.row_number().over(inside.orderBy(at, tie)).alias("rn"), F.count("*").over(inside).alias("n"))
    middle = F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col(at)))
    return rows.groupBy(by, "cluster").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), middle.alias("middle"))


def anchored_clusters(df: DataFrame, by: str, at: str, reach: int) -> DataFrame:
    """Clusters around their first element: a row further than ``reach`` from it starts the next cluster.

    The boundary depends on all rows before it in the group, so each group is folded in order by one function; groups
    are read sorted and nothing but the fold's state is kept per row.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        anchor, number, numbers = None, 0, []
        for x in pdf[at]:
            if anchor is None or x - anchor > reach:
                anchor, number = x, number + 1
            numbers.append(number)
        pdf = pdf.assign(cluster=numbers)
        out = pdf.groupby("cluster", as_index=False).agg(first=(at, "min"), last=(at, "max"), n=(at, "size"))
        out.insert(0, by, pdf[by].iloc[0])
        return out

    kinds = {c: t for c, t in df.dtypes}
    rows = df.filter(F.col(at).isNotNull()).select(by, at)
    return rows.groupBy(by).applyInPandas(lambda pdf: fold(pdf.sort_values(at)), f"{by} {kinds[by]}, cluster bigint, first {kinds[at]}, last {kinds[at]}, n bigint")


def asof_latest(df: DataFrame, by: str, order: list[str], mark: Column, value: str) -> Column:
    """Column: the value of the latest marked row at or before each row of its group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(mark, F.col(value)), ignorenulls=True).over(w)


def uniform_sample(df: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The ``k`` rows of each group at places round(i (n - 1) / (k - 1)), all rows of a smaller group."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.select("*", (F.row_number().over(w) - 1).alias("__i"), F.count("*").over(Window.partitionBy(by)).alias("__n"))
    # Place i is taken iff it is the rounding of some multiple; halves go to the even neighbour.
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / (k - 1)).cast("bigint"))
    return rows.filter((F.col("__n") <= k) | F.array_contains(places, F.col("__i").cast("bigint"))).drop("__i", "__n")


def content_aware_sample(df: DataFrame, by: str, order: list[str], signal: str, k: int, even: int) -> DataFrame:
    """``even`` rows spread over the group, then those with the strongest positive signal, ``k`` in all at most."""
    spread = uniform_sample(df, by, order, even).select(by, *order).withColumn("__even", F.lit(True))
    rows = df.join(spread, [by, *order], "left").withColumn("__even", F.coalesce("__even", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(by, "__even").orderBy(F.desc(signal), *order))
    rows = rows.select("*", rank.alias("__r"))
    return rows.filter(F.col("__even") | ((F.col(signal) > 0) & (F.col("__r") <= k - even))).drop("__r", "__even")


def level_changes(df: DataFrame, by: str, order: list[str], level: Column) -> DataFrame:
    """(by, from_level, to_level, n) of changes between neighbours; changes to 'medium' don't count."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = df.select(by, *order, level.alias("to_level")).withColumn("from_level", F.lag("to_level").over(w))
    rows = rows.filter("from_level is not null and from_level <> to_level and to_level <> 'medium'")
    return rows.groupBy(by, "from_level", "to_level").agg(F.count("*").alias("n"))


def rate_limit(df: DataFrame, by: str, ts: str, size: Column, window_s: int, most: int) -> DataFrame:
    """Rows and sum of sizes in the ``window_s`` seconds up to each row, and whether that is beyond the limit."""
    w = Window.partitionBy(by).orderBy(epoch(ts, "MICROSECOND")).rangeBetween(-window_s * 1_000_000, 0)
    rows = df.withColumn("recent", F.count("*").over(w)).withColumn("recent_size", F.sum(size).over(w))
    return rows.withColumn("limited", F.col("recent") > most)
