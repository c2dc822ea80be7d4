"""All registered queries and their SQL forms."""

from __future__ import annotations

import importlib

MODULES = ["pool", "entities", "stories", "ingest", "serving", "lifecycle", "audit", "streaming", "plans"]


def all_queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(importlib.import_module(f"newsflow.catalog.{m}").QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(importlib.import_module(f"newsflow.catalog.{m}").ORACLE)
    return out
