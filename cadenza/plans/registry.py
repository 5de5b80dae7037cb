"""All registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from cadenza.plans import graph, platform, recommend, serving

_MODULES = (recommend, graph, platform, serving)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
