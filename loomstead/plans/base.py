"""The registry of queries over the benchmark tables; each stands in for the domain's relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstead.schemas import BENCH
from loomstead.sources.tables import bench_table


class Tables:
    """Benchmark tables by name: t.orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bench_table(self.spark, self._dir, name)

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream; a pattern, as streams take a folder or a pattern, not a file."""
        return self.spark.readStream.schema(BENCH[name]).parquet(f"{self._dir}/{name}.parquet*")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        """Registers a function of Tables under its name, with the same result in SQL."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable:
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
