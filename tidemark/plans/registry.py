"""Where queries register themselves with their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.fixtures import fixture, with_fixtures

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(uses: str, oracle: str | None = None):
    """Register ``f(t)``, where ``t(name)`` is a table or fixture; the oracle sees the fixtures named in ``uses``."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: fixture(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = with_fixtures(uses, oracle) if uses else oracle
        return f

    return add
