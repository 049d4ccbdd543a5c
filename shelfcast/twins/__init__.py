"""DuckDB statements that check the Spark queries."""

from __future__ import annotations

import importlib

_MODULES = ["core", "analysis", "forecast", "series"]


def all_twins() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found.update(importlib.import_module(f"shelfcast.twins.{module}").TWINS)
    return found
