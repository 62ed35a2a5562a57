"""Every query of the engine by name, and the SQL it is compared with."""

from __future__ import annotations

from . import evidence, facts, graphs, search, streams

_ALL = evidence.QUERIES | facts.QUERIES | graphs.QUERIES | search.QUERIES | streams.QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
