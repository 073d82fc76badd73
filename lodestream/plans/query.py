"""Registering a plan with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lodestream.plans.views import Views, over

Build = Callable[[Views], DataFrame]


class Register(dict):
    """Maps an inventory id to (plan, SQL or None)."""

    def add(self, key: str, views: str = "", sql: str | None = None) -> Callable[[Build], Build]:
        def keep(build: Build) -> Build:
            self[key] = (build, over(views, sql) if sql and views else sql)
            return build

        return keep
