"""The register of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from loomgraph.shared import sized
from loomgraph.sources.fixtures import base, fixture, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """A lookup of base and derived tables for one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        sized(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        try:
            return fixture(self.spark, self.sf_dir, name)
        except KeyError:
            return base(self.spark, self.sf_dir, name)

    def together(self, *names: str) -> list[DataFrame]:
        """Several tables; those that are stored for the first time are made side by side."""
        with ThreadPoolExecutor(len(names)) as pool:
            return list(pool.map(self, names))


def query(sql: str | None = None) -> Callable:
    """Registers a function of a lookup for tables; sql names derived tables as <name>."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add
