"""All registered queries and their oracle statements, module by module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pixels", "stats", "texture", "models", "ingest")


def _modules():
    return [import_module(f"pixelloom.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
