"""All queries of the core library."""

from __future__ import annotations

from paperloom.plans import enrichment, intervals, joined, parsed, retrieval
from paperloom.plans.registry import Query

MODULES = [intervals, retrieval, enrichment, parsed, joined]


def queries() -> dict[str, Query]:
    return {name: fn for module in MODULES for name, fn in module.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.REGISTRY.sql.items()}
