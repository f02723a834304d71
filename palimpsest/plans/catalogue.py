"""All queries of the core library and their comparison SQL."""

from __future__ import annotations

from palimpsest.plans import event_queries, fact_queries, nested_queries, survey_queries, text_queries

MODULES = (nested_queries, text_queries, event_queries, fact_queries, survey_queries)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}

FLAGSHIP = "readability_profile"
