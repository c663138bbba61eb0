"""Every query of the library with its SQL, gathered from the plan modules."""

from __future__ import annotations

from .plans import catalogue, delivery, learning, product, relational, scalars, search

FLAGSHIP = "enriched_feed"
MODULES = (scalars, catalogue, product, delivery, search, learning, relational)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
