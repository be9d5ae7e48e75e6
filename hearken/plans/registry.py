"""Where registered queries and their DuckDB twins live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearken.plans import bindings
from hearken.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Lazy access to the tables of one folder and to the views bound on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._written: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[Inputs], DataFrame]) -> DataFrame:
        """A table several parts of one query read: built and written on first use."""
        if name not in self._written:
            self._written[name] = materialize(build(self), name)
        return self._written[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in bindings.VIEWS:
            return bindings.spark_view(self, name)
        if name in bindings.TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register `fn(inputs) -> DataFrame` under the inventory id `name`.

    `sql` is the DuckDB twin; the views it mentions are prepended as CTEs.
    """

    def wrap(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = bindings.with_views(sql)
        return fn

    return wrap
