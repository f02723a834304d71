"""Lists of names typed in one field, and how alike two texts are."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

_GROUP = re.compile("群臣|百官|众人|将领|士兵|弟子们|等人|某人|all of them|others")
_ENUMERATION = re.compile("[、,，]|等")
_OPEN, _CLOSE = "（(【[", "）)】]"


def split_top_level(text: str, separators: str) -> list[str]:
    """Parts between separators that aren't inside brackets, trimmed, empty ones dropped."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth = max(0, depth - 1)
        elif c in separators and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [p for p in (x.strip() for x in (*parts, text[start:])) if p]


def split_names_of(text: str | None) -> list[str]:
    """Single names: 、 always separates, a comma only between names that aren't all Latin; groups name nobody."""
    value = (text or "").strip()
    if not value or (_GROUP.search(value) and _ENUMERATION.search(value)):
        return []
    parts = split_top_level(value, "、")
    return [q for p in parts for q in (split_top_level(p, ",，") if not p.isascii() else [p])]


split_names = F.pandas_udf(lambda values: values.map(split_names_of), ArrayType(StringType()))


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts, each read to 8000 characters; 0 where one is NULL or empty."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p[:8000], q[:8000]).ratio() if p and q else 0.0 for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(ratio, DoubleType())(a, b)


def is_group(name: Column) -> Column:
    """Whether a field names a group or an enumeration of titles instead of a person."""
    return F.coalesce(F.trim(name) == "", F.lit(True)) | (name.rlike(_GROUP.pattern) & name.rlike(_ENUMERATION.pattern)) | (F.trim(name) == "某人")


def fragments(evidence: Column) -> Column:
    """Quoted fragments, or else the parts between ellipses and commas; distinct, of at least two characters."""
    quoted = F.regexp_extract_all(evidence, F.lit("[“「]([^”」]+)[”」]"), F.lit(1))
    parts = F.transform(F.split(evidence, "……|…|[、,，；;。！？!?]"), lambda x: F.trim(x))
    return F.filter(F.array_distinct(F.when(F.size(quoted) > 0, quoted).otherwise(parts)), lambda x: F.length(x) >= 2)
