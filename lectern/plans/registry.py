"""All queries of the core, by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

from lectern.plans.base import Query

MODULES = ("texts", "web", "skills", "structure", "runs")


def _collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"lectern.plans.{name}").R, what)
    return out


def queries() -> dict[str, Query]:
    return _collect("queries")


def oracle_sql() -> dict[str, str]:
    return _collect("sql")
