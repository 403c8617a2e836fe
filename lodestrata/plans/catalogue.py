"""All named queries, with their ANSI SQL where SQL expresses them."""

from __future__ import annotations

from lodestrata.plans import data_queries, dialect_queries, graph_queries, project_queries, search_queries, source_queries, structure_queries  # noqa: F401  (they register themselves)
from lodestrata.plans.adapters import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
