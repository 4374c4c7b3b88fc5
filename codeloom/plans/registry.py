"""All queries of the core by name."""

from __future__ import annotations

from codeloom.plans import base, graph_queries, index_queries, problems  # noqa: F401  (imported for what they register)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
