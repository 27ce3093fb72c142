"""Registered queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelquery.sources.adapters import Tables, with_views

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of the tables; ``oracle`` may use the ``v_…`` views by name."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = with_views(oracle)
        return build

    return add


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from reelquery.plans import load

    load()

    def bind(build):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    from reelquery.plans import load

    load()
    return dict(_ORACLES)
