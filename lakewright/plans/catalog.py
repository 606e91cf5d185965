"""All registered queries of the analytics engine and their SQL oracles."""

from __future__ import annotations

from lakewright.plans import audit_queries, cohort_queries, evaluation_queries, evidence_queries, graph_queries, name_queries, retrieval_queries, taxonomy_queries

_PARTS = (evidence_queries, retrieval_queries, graph_queries, name_queries, taxonomy_queries, evaluation_queries, audit_queries, cohort_queries)


def queries() -> dict:
    """name -> callable of (spark, sf_dir)."""
    return {k: f for part in _PARTS for k, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict:
    """name -> DuckDB SQL."""
    return {k: sql for part in _PARTS for k, (_, sql) in part.QUERIES.items() if sql}
