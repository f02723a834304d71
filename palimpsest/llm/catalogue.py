"""What ``__spark_entry__`` adds when this package is there."""

from palimpsest.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
