"""Operators for large text corpora; nothing else in the library imports this package."""

from __future__ import annotations

from panelloom.llm import registered


def queries() -> dict:
    return dict(registered.QUERIES)


def oracle_sql() -> dict:
    return dict(registered.SQL)
