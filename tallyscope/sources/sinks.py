"""Sinks: deterministic tables, append-only stores and lineage rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], fmt: str = "parquet") -> None:
    """Fixed columns in total order; the output committer replaces the folder as a whole."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], spread: Column, files: int) -> None:
    """Partitioned table; the spread column keeps a hot partition value from one task."""
    df.repartition(files, *[F.col(c) for c in by], F.pmod(F.xxhash64(spread), F.lit(files))).write.mode(
        "overwrite").partitionBy(*by).parquet(path)


def new_rows(existing: DataFrame | None, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is new, the first one per key; stored rows are never changed."""
    fresh = incoming if existing is None else incoming.join(existing.select(key), key, "left_anti")
    rest = [c for c in incoming.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def append_new(df: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """Append rows with new keys to the store; a folder without files, at any depth, is an empty store, any other failure is an error."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = False
    if system.exists(folder):
        found = system.listFiles(folder, True)
        while found.hasNext() and not files:
            files = found.next().getPath().getName().endswith(".parquet")
    existing = spark.read.parquet(path) if files else None
    new_rows(existing, df, key, order).write.mode("append").parquet(path)


def lineage(df: DataFrame, name: str, key: str, family: Column) -> DataFrame:
    """Record count, order-free content fingerprint and counts per family of an output."""
    return df.groupBy(family.alias("family")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(key).alias("keys"),
        F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("fingerprint")).withColumn("output", F.lit(name))
