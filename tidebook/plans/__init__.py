"""Registered queries, one module per area."""

from __future__ import annotations

from importlib import import_module

MODULES = ("features", "outcomes", "quality", "bronze", "results", "stats", "feeds", "ledger", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
