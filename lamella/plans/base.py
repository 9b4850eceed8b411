"""Registration of queries: a name, the Spark plan and, where SQL can express it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.plans.views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Inputs:
    """The views of one run, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        from lamella.plans.views import VIEWS, table

        return view(self.spark, self.sf_dir, name) if name in VIEWS else table(self.spark, self.sf_dir, name)


def query(sql: str | None = None, like: str | None = None):
    """Register a function of ``Inputs`` under its own name; ``sql`` may name views; ``like`` names a query of the same result."""

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(spark, sf_dir))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLE_SQL[build.__name__] = oracle(sql)
        elif like is not None:
            ORACLE_SQL[build.__name__] = ORACLE_SQL[like]
        return build

    return register
