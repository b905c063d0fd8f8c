"""A small registry: a query over ``Inputs`` and the SQL it is checked against, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from goldsieve.sources.views import Inputs, with_views

_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        _QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = with_views(oracle)
        return build

    return register


def _bind(build: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Inputs(spark, folder))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(build) for name, build in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
