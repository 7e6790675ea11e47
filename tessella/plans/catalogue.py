"""Query catalogue: one Spark plan and, where SQL can express it, one DuckDB oracle for each operator family."""

from __future__ import annotations

from . import assembly, manifests, ordered, relational, textual, windows

_PARTS = (relational, manifests, ordered, assembly, textual, windows)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
