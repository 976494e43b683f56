"""Session settings and lineage cutting shared by tests, bench and jobs."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(app: str = "tallyscope", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and a fixed UTC clock.

    On a cluster, master, memory and shuffle partitions come from the submitter;
    they are only set here when given, which is what the local tests do.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named in ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may go without it and gets a folder of its own;
    on a cluster a machine-local folder would lose the data, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        alone = context.master.split("[")[0] == "local"
        if named is None and not alone:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyscope-ckpt-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and return a plan that reads it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: columnar, with statistics.

    What is read back was committed once, so values that a rerun could change (row ids) are fixed.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Have the driver collect its garbage; only then Spark lets go of finished jobs' broadcasts and shuffle files.

    A query of dozens of jobs over many partitions leaves so much between them that the driver's heap grows to its limit.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes: texts and binaries as long as they are, nested values as their JSON."""
    width = F.lit(16 + 8 * len(schema.fields)).cast("long")
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    return width


def small_side(kept: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 128 << 20) -> DataFrame:
    """A materialised table as one side of a join: broadcast only when rows and bytes are measured within the bounds."""
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(kept.schema)), F.lit(0))).first()
    return F.broadcast(kept) if rows <= max_rows and size <= max_bytes else kept.hint("merge")


def counted_side(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """The short side of a join whose size the planner cannot see.

    That is so next to an exploded text, which the planner could broadcast itself, and for a
    per-cohort summary of a large table, which it could merge-join on a hot cohort key. So
    the side is materialised and counted: within the bound it is broadcast, beyond it both
    sides are sorted and merged.
    """
    return small_side(cut_lineage(df), max_rows)
