"""Readers of tables, file trees and JSON documents."""

from palimpsest.sources.tables import table

__all__ = ["table"]
