"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from terracause.plans import dynamics, graphs, panel, summaries

MODULES = [panel, summaries, graphs, dynamics]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
