"""All queries of this subpackage and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = tuple(f"lorewell.llm.{m}" for m in ("split", "scans", "knn", "neardup", "packing", "mixing", "pii"))


def queries() -> dict:
    return {name: query for m in MODULES for name, query in import_module(m).QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in import_module(m).SQL.items()}
