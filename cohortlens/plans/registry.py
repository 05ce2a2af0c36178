"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from . import cell_queries, contract_queries, evidence_queries, fit_queries, prep_queries

MODULES = (cell_queries, contract_queries, prep_queries, evidence_queries, fit_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark, sf_dir):
    return cell_queries.agg1(spark, sf_dir)
