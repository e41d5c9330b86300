"""All queries of the library itself, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("records", "search", "notes", "upkeep", "memory", "streams")

QUERIES: dict = {}
SQL: dict = {}
for _name in _PARTS:
    _part = import_module(f"marginalia.plans.{_name}")
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
