"""All queries by name."""

from . import answers, capacity, files, lookups, matching, metadata, nesting, payloads, retrieval, schema, scripts, storing, tables, texts
from .model import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "answers", "capacity", "files", "lookups", "matching", "metadata", "nesting", "payloads", "retrieval", "schema", "scripts", "storing", "tables", "texts"]
