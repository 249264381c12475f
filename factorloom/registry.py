"""All registered queries."""

from __future__ import annotations

from . import evaluation_queries, queries, selection_queries

QUERIES, ORACLE = queries.QUERIES, queries.ORACLE
__all__ = ["ORACLE", "QUERIES", "evaluation_queries", "selection_queries"]
