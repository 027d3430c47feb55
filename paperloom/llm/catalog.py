"""All queries of this subpackage."""

from __future__ import annotations

from paperloom.llm import queries_leakage, queries_mail, queries_mixing, queries_neighbours, queries_personal, queries_residue, queries_scans, queries_splitting
from paperloom.plans.registry import Query

MODULES = [queries_leakage, queries_mail, queries_mixing, queries_neighbours, queries_personal, queries_residue, queries_scans, queries_splitting]


def queries() -> dict[str, Query]:
    return {name: fn for module in MODULES for name, fn in module.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.REGISTRY.sql.items()}
