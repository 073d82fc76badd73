"""All queries over the logical views by inventory id."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lodestream.plans.views import Views

MODULES = ["aggregates", "series", "relational", "rules", "graphs", "detectors", "scalars", "further", "exchange"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _bind(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Views(spark, folder))

    run.__doc__ = build.__doc__
    return run


for _name in MODULES:
    for _key, (_build, _sql) in import_module(f"lodestream.plans.{_name}").QUERIES.items():
        QUERIES[_key] = _bind(_build)
        if _sql:
            ORACLE[_key] = _sql
