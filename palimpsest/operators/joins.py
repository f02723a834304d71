"""Theta joins that stay equi-joins at heart: rules on one key, neighbours by place, greedy one-to-one matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contradictions(facts: DataFrame, by: list[str], key: str, dimension: str, text: str, rules: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Pairs of facts of one group that match the two sides of a rule (id, dimension a, pattern a, dimension b, pattern b).

    Each rule's sides are cut down by their patterns where the facts are read; only matching facts meet, on the group
    and the rule. A fact never contradicts itself.
    """

    def side(which: str, dim: int, pattern: int) -> DataFrame:
        matches = F.array_compact(F.array(*(F.when((F.col(dimension) == r[dim]) & F.col(text).rlike(r[pattern]), F.lit(r[0])) for r in rules)))
        return facts.select(*by, F.col(key).alias(which), F.explode(matches).alias("rule"))

    a, b = side("fact_a", 1, 2), side("fact_b", 3, 4)
    return a.join(b, [*by, "rule"]).filter("fact_a <> fact_b").select(*by, "rule", "fact_a", "fact_b")


def neighbours(df: DataFrame, by: str, order: str, text: str, chars: int = 80) -> DataFrame:
    """Each row with the end of the text before it and the beginning of the one after it."""
    w = Window.partitionBy(by).orderBy(order)
    tail, head = F.substring(F.col(text), -chars, chars), F.substring(F.col(text), 1, chars)
    return df.select(by, order, F.length(text).alias("n_chars"), F.lag(tail).over(w).alias("before"), F.lead(head).over(w).alias("after"))


def proximity_score(distance: Column, names: Column, keywords: Column, hint: Column) -> Column:
    """3, 2 or 1 for less than 50, 100 or 200 characters, plus half a point per name and keyword (2 each at most) and a hint."""
    near = F.when(distance < 50, 3.0).when(distance < 100, 2.0).when(distance < 200, 1.0).otherwise(0.0)
    return near + F.least(names * 0.5, F.lit(2.0)) + F.least(keywords * 0.5, F.lit(2.0)) + F.when(hint, 1.5).otherwise(0.0)


def greedy_matches(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One-to-one: later items in order take their best free earlier item (ties to the earliest).

    ``candidates`` has planted, planted_at, resolved, resolved_at and score. The order of decisions matters, so each
    group, which holds the candidates of one subject only, is folded in order by one function.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        pdf = pdf.sort_values(["resolved_at", "resolved", "score", "planted_at", "planted"], ascending=[True, True, False, True, True])
        for resolved, part in pdf.groupby("resolved", sort=False):
            for r in part.itertuples(index=False):
                if r.planted not in used:
                    used.add(r.planted)
                    rows.append((*(getattr(r, b) for b in by), r.planted, resolved, r.resolved_at - r.planted_at, r.score))
                    break
        return pd.DataFrame(rows, columns=[*by, "planted", "resolved", "distance", "score"])

    kinds = dict(candidates.dtypes)
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), f"planted {kinds['planted']}, resolved {kinds['resolved']}, distance {kinds['planted_at']}, score {kinds['score']}"])
    return candidates.groupBy(*by).applyInPandas(fold, schema)
