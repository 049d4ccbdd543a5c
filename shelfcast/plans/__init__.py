"""Jobs and registered queries."""

from __future__ import annotations

import importlib

_MODULES = ["core_queries", "analysis_queries", "forecast_queries", "model_queries", "series_queries"]


def all_queries():
    from shelfcast.plans import registry

    for module in _MODULES:
        importlib.import_module(f"shelfcast.plans.{module}")
    return dict(registry.QUERIES)
