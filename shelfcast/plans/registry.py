"""Named queries: each builds one result table from a workspace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.functions.columns import rounded
from shelfcast.plans.workspace import Workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}


def query(name: str):
    """Register a query; names start with the inventory ids they cover."""
    def keep(build: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = build
        return build
    return keep


def runner(build: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(build(Workspace.of(spark, folder)))
    return run
