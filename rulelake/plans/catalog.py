"""Registered queries over the driver's tables, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from . import document_queries, graph_queries, program_queries, rule_queries, selection_queries, source_queries, validation_queries

_MODULES = (rule_queries, document_queries, graph_queries, selection_queries, source_queries, validation_queries, program_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
