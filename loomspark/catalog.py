"""All registered queries of the engine and their SQL, by name."""

from __future__ import annotations

from loomspark.plans import claims, exports, facts, graphs, reconciliation, resolution, retrieval, signals, tables, validation

_MODULES = (retrieval, signals, facts, graphs, reconciliation, tables, validation, resolution, claims, exports)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
