"""Registration of the catalogue's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slidelake.plans.bridge import Bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of a :class:`Bridge` under a name, with its checking SQL."""

    def register(build: Callable[[Bridge], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Bridge(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register
