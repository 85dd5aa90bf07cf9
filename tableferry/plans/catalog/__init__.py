"""Registered queries, each beside the SQL that says what it must return."""

from __future__ import annotations

from importlib import import_module

from tableferry.plans.catalog.registry import ORACLES, QUERIES

for _module in ("extraction", "ingest", "merging", "runlog", "views", "objects", "protection", "streams"):
    import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
