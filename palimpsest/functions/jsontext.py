"""Lenient JSON: what is clearly meant is repaired, what is cut off is refused."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_FENCE = re.compile(r"^\s*```[^\n]*\n?|\s*```\s*$")
_NEXT = re.compile(r"\s*(\S?)")
# Full-width marks that stand for JSON's own, outside strings.
_WIDE = dict(zip("｛｝［］：，“”", '{}[]:,""', strict=True))
# What may follow the closing mark of a string.
_AFTER_STRING = ":,}]"
# The flags of ``diagnose``, and the length from which an open text counts as cut by an output limit.
FLAGS = (
    "content_none", "content_empty", "code_fence_unclosed", "code_fence_wrapped", "json_string_unclosed", "json_unbalanced", "likely_truncated", "near_max_tokens_truncated",
)
LONG = 5500
CUT = frozenset(FLAGS) - {"content_none", "content_empty", "code_fence_wrapped"}


class Scan:
    """One pass over a text that knows what is inside strings: braces, brackets, and the first object's bounds."""

    def __init__(self, text: str):
        self.start = text.find("{")
        self.end, self.braces, self.brackets, self.quoted = -1, 0, 0, False
        escaped = False
        for i, c in enumerate(text):
            if self.quoted:
                self.quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                self.quoted = True
            elif c in "{}":
                self.braces += 1 if c == "{" else -1
                if c == "}" and self.braces == 0 and self.end < 0 <= self.start < i:
                    self.end = i + 1
            elif c in "[]":
                self.brackets += 1 if c == "[" else -1


def mended(text: str, wide: bool, quotes: bool) -> str:
    """``text`` without control characters; outside strings full-width marks become JSON's own if ``wide``.

    With ``quotes`` a mark inside a string that isn't followed by what follows a string is taken for text.
    """
    out, quoted, escaped = [], False, False
    text = "".join(c for c in text if c >= " " or c in "\t\n\r")
    for i, c in enumerate(text):
        if not quoted:
            c = _WIDE.get(c, c) if wide else c
            quoted = c == '"'
        elif escaped or c == "\\":
            escaped = not escaped
        elif c == '"':
            rest = _NEXT.match(text, i + 1).group(1) if quotes else ""
            if rest and rest not in _AFTER_STRING and not (wide and _WIDE.get(rest, " ") in _AFTER_STRING):
                c = '\\"'
            else:
                quoted = False
        out.append(c)
    return "".join(out)


def diagnose(text: str | None) -> tuple[list[str], int, int, int]:
    """(flags, length, open braces, open brackets) of a text that should be JSON; flags are those of ``FLAGS``, sorted."""
    bare = (text or "").strip()
    seen = Scan(bare)
    unbalanced, open_ = seen.braces != 0 or seen.brackets != 0, seen.braces > 0 or seen.brackets > 0
    fenced = bare.startswith("```")
    holds = (
        text is None, not bare, fenced and not bare.endswith("```"), fenced, seen.quoted, unbalanced,
        bool(bare) and bare[-1] not in "}]`" and (open_ or seen.quoted), len(bare) >= LONG and open_,
    )
    return sorted(f for f, x in zip(FLAGS, holds, strict=True) if x), len(bare), seen.braces, seen.brackets


def repair(text: str | None) -> tuple[str | None, str]:
    """(clean JSON of the first object, how it was got); (None, reason) if there is none or it is cut off."""
    if text is None or not text.strip():
        return None, "empty"
    if _object(text) is not None:
        return _clean(_object(text)), "strict"
    bare = _FENCE.sub("", text)
    for how, wide, quotes in (("fence", False, False), ("wide", True, False), ("quotes", False, True), ("wide_quotes", True, True)):
        candidate = mended(bare, wide, quotes)
        bounds, last = Scan(candidate), candidate.rfind("}")
        for end in dict.fromkeys((bounds.end, last + 1)):
            if bounds.start < 0 or end <= bounds.start:
                continue
            part = candidate[bounds.start : end]
            for variant in (part, re.sub(r",\s*([}\]])", r"\1", part)):
                found = _object(variant, strict=False)
                if found is not None:
                    return _clean(found), how
    return None, "truncated" if CUT & set(diagnose(mended(bare, True, False))[0]) else "no_object"


def _clean(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _object(text: str, strict: bool = True):
    try:
        value = json.loads(text, strict=strict)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("how", StringType())]))
def lenient_json(texts: pd.Series) -> pd.DataFrame:
    """Column function: struct of the clean JSON and how it was got."""
    return pd.DataFrame([repair(t) for t in texts], columns=["json", "how"])


@F.pandas_udf(StructType([StructField("flags", StringType()), StructField("length", IntegerType()), StructField("braces", IntegerType()), StructField("brackets", IntegerType())]))
def json_diagnosis(texts: pd.Series) -> pd.DataFrame:
    """Column function: struct of the flags joined by commas, the stripped length and what is left open."""
    found = [diagnose(t) for t in texts]
    return pd.DataFrame([(",".join(f), *rest) for f, *rest in found], columns=["flags", "length", "braces", "brackets"])
