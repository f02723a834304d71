"""Queries of problem 5: nested outline sections as flat, linked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.nested import flatten_nested, refused, route, subtype_table, subtypes, variants
from palimpsest.sources import table

SECTIONS = ("causal_chain", "protagonist_growth", "worldbuilding_expansion")


def outline_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "chunk_results").select("result_id", "outline_architecture")
    return flatten_nested(results, "result_id", "outline_architecture", SECTIONS, wrapper="outline_architecture")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent links of all subtype tables."""
    return subtypes(route(outline_elements(spark, sf_dir)), "result_id").select("result_id", "parent_path", "child_path").distinct()


def p5_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the elements of each list field; a re-delivered result counts once."""
    rows = outline_elements(spark, sf_dir).select("result_id", "child_path", "list_path", "kind", "shape", "state").distinct()
    return variants(rows).select("list_path", "kind", "shape", "state", F.col("n").cast("bigint").alias("n"))


def p5_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines without rows because they can't be parsed, and why."""
    return refused(table(spark, sf_dir, "chunk_results"), "result_id", "outline_architecture").distinct()


# Typed fields of the objects of each list.
SUBTYPES = {
    "p5_forced_elements": ("causal_chain.forced_elements", {"element": "string", "reason": "string"}),
    "p5_links": ("causal_chain.forced_elements[].links", {"to_chunk": "int", "effect": "string"}),
    "p5_steps": ("protagonist_growth.steps", {"stage": "string", "change": "string"}),
    "p5_gains": ("protagonist_growth.steps[].gains", {"kind": "string", "label": "string"}),
    "p5_new_elements": ("worldbuilding_expansion.new_elements", {"kind": "string", "label": "string"}),
    "p5_rules": ("worldbuilding_expansion.new_elements[].rules", {"rule": "string"}),
    "p5_exceptions": ("worldbuilding_expansion.new_elements[].rules[].exceptions", {"when": "string", "effect": "string"}),
}


def _subtype(list_path: str, fields: dict[str, str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return subtype_table(route(outline_elements(spark, sf_dir)), "result_id", list_path, fields).distinct()

    query.__doc__ = f"The objects of {list_path} with typed fields and their parent."
    return query


QUERIES = {"p5_found": p5_found, "p5_variants": p5_variants, "p5_refused": p5_refused} | {name: _subtype(*x) for name, x in SUBTYPES.items()}
SQL: dict[str, str] = {}
