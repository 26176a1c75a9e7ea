"""All queries outside the text subpackage, and their SQL."""

from __future__ import annotations

from allelica.plans import haplotype_queries, io_queries, ld_queries, problems, trait_queries

MODULES = [problems, haplotype_queries, ld_queries, trait_queries, io_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
