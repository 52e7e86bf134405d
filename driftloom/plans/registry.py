"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from driftloom.plans import artifact_queries, corpus_queries, geometry_queries, governance_queries, integrity, score_queries, sequence_queries, window_queries

MODULES = (window_queries, corpus_queries, geometry_queries, score_queries, sequence_queries, governance_queries, artifact_queries, integrity)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
