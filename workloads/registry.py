"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["workloads.spatial", "workloads.catalog", "workloads.files"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(import_module(name).QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(name).SQL)
    return found
