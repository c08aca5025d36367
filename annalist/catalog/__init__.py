"""Registered queries by section, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("text", "dating", "facts", "graph", "vectors", "sources")


def _all():
    return [import_module(f"annalist.catalog.{s}").C for s in SECTIONS]


def queries() -> dict:
    """Query functions by name."""
    return {k: f for c in _all() for k, f in c.queries.items()}


def sql() -> dict[str, str]:
    """DuckDB SQL by name, where there is one."""
    return {k: s for c in _all() for k, s in c.sql.items()}
