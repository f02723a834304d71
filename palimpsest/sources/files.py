"""File trees of texts and JSON, rule packs, inherited profiles and keyword snapshots as DataFrames."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Encodings tried by ``decode``, in this order; the order breaks ties.
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "big5", "utf-16", "shift_jis", "euc_kr", "cp1251", "cp1252")
LEAST_SCORE = 0.2


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, modificationTime, length, content) of all matching files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def _score(text: str) -> float:
    """Share of characters that a text of letters, marks and spaces is made of."""
    if not text:
        return 0.0
    sample = text[:20_000]
    good = sum(c.isalnum() or c.isspace() or c in "，。！？；：、“”‘’「」…—,.!?;:'\"()（）-" for c in sample)
    bad = sum(c == "�" or (ord(c) < 32 and c not in "\t\n\r") or "" <= c <= "" for c in sample)
    return max(0.0, (good - 5 * bad) / len(sample))


def decode_bytes(content: bytes) -> tuple[str | None, str | None, float]:
    """(text, encoding, score) of the best decoding; strict decodings weigh a fifth more, replaced ones a tenth less."""
    best: tuple[float, int, str, str] | None = None
    for i, encoding in enumerate(ENCODINGS):
        try:
            text, score = content.decode(encoding), 1.2
        except (UnicodeDecodeError, UnicodeError):
            text, score = content.decode(encoding, "replace"), 0.9
        score = min(1.0, _score(text) * score)
        if best is None or score > best[0]:
            best = (score, i, encoding, text)
    if best is None or best[0] < LEAST_SCORE:
        return None, None, best[0] if best else 0.0
    return best[3].lstrip("﻿"), best[2], best[0]


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType()), StructField("score", DoubleType())]))
def decode(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(bytes(c)) if c is not None else (None, None, 0.0) for c in contents], columns=["text", "encoding", "score"])


def documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, name, text, encoding, signature): decoded texts, with a signature of size, beginning and end."""
    files = text_files(spark, folder, pattern)
    ends = F.concat(F.col("length").cast("string").cast("binary"), F.substring("content", 1, 65536), F.substring(F.col("content"), -65536, 65536))
    rows = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), decode("content").alias("d"), F.sha2(ends, 256).alias("signature"))
    return rows.select("path", "name", "d.text", "d.encoding", "signature")


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """Path of the newest matching file (the greatest path among equally new ones)."""
    found = text_files(spark, folder, pattern).select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return found[0]


def json_records(spark: SparkSession, folder: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """One record per JSON file; unreadable ones give NULL fields and keep their text in ``_corrupt``."""
    full = f"{schema}, _corrupt string"
    return spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)


def rule_points(spark: SparkSession, folder: str) -> DataFrame:
    """(category, point) of rule packs with categories of points."""
    packs = json_records(spark, folder, "categories array<struct<name: string, points: array<string>>>")
    rows = packs.select(F.explode("categories").alias("c"))
    return rows.select(F.col("c.name").alias("category"), F.explode("c.points").alias("point"))


def load_profile(folder: str, name: str) -> dict:
    """A profile merged over the ones it extends: objects merge deeply, lists replace. A cycle is an error.

    Profiles are small configuration files of the application, read where the query is planned.
    """
    seen: list[str] = []
    chain: list[dict] = []
    while name:
        if name in seen:
            raise ValueError(f"profiles extend each other: {' > '.join([*seen, name])}")
        seen.append(name)
        chain.append(json.loads(Path(folder, f"{name}.json").read_text("utf-8")))
        name = chain[-1].get("extends")
    merged: dict = {}
    for layer in reversed(chain):
        merged = _merge(merged, {k: v for k, v in layer.items() if k != "extends"})
    return merged


def _merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def effective_keywords(static: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(dimension, word): fixed words and those of the latest snapshot, 2 to 10 characters each."""
    latest = snapshots.agg(F.max("created_at").alias("created_at"))
    learned = snapshots.join(F.broadcast(latest), "created_at").select("dimension", "word")
    return static.select("dimension", "word").unionByName(learned).filter(F.length("word").between(2, 10)).distinct()
