"""All queries of the core and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = tuple(f"lorewell.operators.{m}" for m in ("orphans", "relational", "retrieval", "graph", "validation", "quality", "maintenance", "chunking", "notes", "service")) + ("lorewell.streaming.ingest", "lorewell.sources.files")
FLAGSHIP = "qx5_hybrid_fusion"


def queries() -> dict:
    return {name: query for m in MODULES for name, query in import_module(m).QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in import_module(m).SQL.items()}
