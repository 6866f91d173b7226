"""All queries over the given tables, with their DuckDB counterparts."""

from __future__ import annotations

import importlib

#: Modules of ``panelloom.plans``; each holds QUERIES {name: function} and SQL {name: text}.
MODULES: tuple[str, ...] = ("features", "evaluation", "tables", "models")


def _gathered(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"panelloom.plans.{name}"), attribute)
        twice = found.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= part
    return found


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("SQL")
