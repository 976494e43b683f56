"""Registry of named queries: how each runs on Spark and the SQL it must agree with."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Lazy access to the parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for heavy per-row work: a scan with fewer splits than cores is spread over them.

        A large table has more splits than cores and is read as it is, without a shuffle.
        """
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


@dataclasses.dataclass(frozen=True)
class Plan:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None
    wide: tuple[str, ...] = ()

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.withColumns({c: df[c].cast("long") for c in self.wide}) if self.wide else df


PLANS: dict[str, Plan] = {}


def plan(covers: str, sql: str | None = None, wide: str = "") -> Callable:
    """Register the decorated function under its own name; ``wide`` names columns given as bigint."""
    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if fn.__name__ in PLANS:
            raise ValueError(f"query {fn.__name__} is registered twice")
        PLANS[fn.__name__] = Plan(fn.__name__, tuple(covers.split()), fn, sql, tuple(wide.split()))
        return fn
    return wrap
