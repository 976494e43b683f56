"""Structured Streaming forms of the incremental behaviours.

Every function takes a streaming (or batch) DataFrame and returns one; ``run`` drives a
query over what is available and keeps its results as a table, each micro-batch in its own
folder so that a replayed batch overwrites itself.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyscope.session import shared_folder
from tallyscope.sources.sinks import new_rows


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the folder that driver and executors share."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def read_table_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int = 1000) -> DataFrame:
    """File stream over the parquet files of a folder that match a pattern; schema from the files."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def run(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run until the source is drained; the result carries a ``batch`` column."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")


def latest_per_key(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final state of an update-mode result: the row of the last batch per key."""
    rest = [c for c in results.columns if c not in keys and c != "batch"]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


# --- X1, X2, X3, X7, X8 --------------------------------------------------------

def with_observed_time(stream: DataFrame, event: str, published: str) -> DataFrame:
    """Event, published and observed time as three columns; none stands in for another."""
    return stream.withColumns({"event_time": F.col(event), "published_time": F.col(published), "observed_time": F.current_timestamp()})


def unique_mentions(stream: DataFrame, key: str, time: str, delay: str, cutoff: Column) -> DataFrame:
    """New keys once within the watermark; rows without key or time, or before the cutoff, are refused."""
    kept = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull() & (F.col(time) >= cutoff))
    return kept.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def not_known(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Stream rows whose key the previous listing does not hold."""
    return stream.join(known.select(key), key, "left_anti")


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of a hash over a canonical request."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16)


def append_store(stream: DataFrame, key: str, order: Sequence[str], folder: str,
                 after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Keep only new keys in an append-only store; ``after`` sees the new rows of a batch.

    Each batch owns one folder of the store, so a replay rewrites it instead of adding twice.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        stored = None
        if batch_id:
            store = spark.read.option("basePath", f"{folder}/store").schema(f"{key} {batch.schema[key].dataType.simpleString()}, batch int").parquet(f"{folder}/store")
            stored = store.where(F.col("batch") < batch_id)
        fresh = new_rows(stored, batch, key, order)
        fresh.write.mode("overwrite").parquet(f"{folder}/store/batch={batch_id}")
        if after:
            after(spark.read.parquet(f"{folder}/store/batch={batch_id}"), batch_id)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


# --- X4, X5 --------------------------------------------------------------------

def rolling_counts(stream: DataFrame, key: str, time: str, width: str, slide: str, delay: str) -> DataFrame:
    """Events per key in sliding windows."""
    return (stream.withWatermark(time, delay).groupBy(key, F.window(time, width, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def daily_totals(stream: DataFrame, key: str, time: str, value: str, delay: str) -> DataFrame:
    """Tumbling day totals per key."""
    return (stream.withWatermark(time, delay).groupBy(key, F.window(time, "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total"))


LEDGER_OUT = "reservation_id string, meter string, state string, usd double, entry long"
#: Reservations of a bucket share one state row: a call of Python takes longer than the fold of hundreds of reservations.
LEDGER_BUCKETS = 1 << 12
LEDGER_STATE = ("ids array<string>, r_entry array<long>, meter array<string>, usd_max array<double>, "
                "s_entry array<long>, s_kind array<string>, actual array<double>, seen array<long>, ends array<long>")


def _fold(hold_ms: int | None) -> Callable:
    """Latest reserve and latest settlement of the reservations of one bucket; order of arrival is free.

    With a hold a reservation goes once the watermark is that far behind its last entry.
    """
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {i: one for i, *one in zip(*state.get)} if state.exists else {}
        mark = state.getCurrentWatermarkMs() if hold_ms is not None else 0
        touched = {}
        for pdf in [] if state.hasTimedOut else frames:
            at = pdf["at_ms"].tolist() if hold_ms is not None else [0] * len(pdf)
            for i, kind, entry, meter, usd_max, actual, seen in zip(*(pdf[c].tolist() for c in ("reservation_id", "kind", "entry", "meter", "usd_max", "actual_usd")), at):
                one = touched[i] = held.setdefault(i, [-1, None, 0.0, -1, None, 0.0, 0, 0])
                if kind == "reserve":
                    if entry > one[0]:
                        one[:3] = int(entry), meter, float(usd_max)
                elif entry > one[3]:
                    one[3:6] = int(entry), kind, float(actual)
                if seen > one[6]:
                    one[6] = int(seen)
        if hold_ms is not None:
            for one in touched.values():
                one[7] = max(one[6] + hold_ms, mark + 1)
            held = {i: one for i, one in held.items() if i in touched or one[7] >= mark}
        if held:
            state.update(tuple(map(list, zip(*((i, *one) for i, one in held.items())))))
            if hold_ms is not None:
                state.setTimeoutTimestamp(min(one[7] for one in held.values()))
        else:
            state.remove()
        out = []
        for i, (r_entry, meter, usd_max, s_entry, s_kind, actual, *_) in touched.items():
            if r_entry >= 0:
                done = s_entry > r_entry
                out.append((i, meter, s_kind if done else "reserve", usd_max if not done else (actual if s_kind == "settle" else 0.0), max(r_entry, s_entry)))
        if out:
            yield pd.DataFrame(out, columns=["reservation_id", "meter", "state", "usd", "entry"])
    return fold


def ledger_state(stream: DataFrame, time: str | None = None, delay: str = "0 seconds", hold_days: float | None = None) -> DataFrame:
    """Fold of reserve / settle / release entries kept as keyed state.

    A settlement that arrives before its reservation waits in the state, so late and
    reordered entries give the batch result. With ``time`` and ``hold_days`` a reservation's
    state ends when the watermark passes its last entry by that time; without, it stays.
    Python is called per bucket of reservations, not per reservation.
    """
    d = stream.where(F.col("reservation_id").isNotNull() & F.col("kind").isin("reserve", "settle", "release"))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("reservation_id"), F.lit(LEDGER_BUCKETS)).cast("int"))
    columns = ["bucket", "reservation_id", "kind", "entry", "meter", "usd_max", "actual_usd"]
    if time is None or hold_days is None:
        return d.select(*columns).groupBy("bucket").applyInPandasWithState(_fold(None), LEDGER_OUT, LEDGER_STATE, "update", GroupStateTimeout.NoTimeout)
    timed = d.withWatermark(time, delay).select(*columns, time, F.unix_millis(time).alias("at_ms"))
    return timed.groupBy("bucket").applyInPandasWithState(_fold(int(hold_days * 86_400_000)), LEDGER_OUT, LEDGER_STATE, "update", GroupStateTimeout.EventTimeTimeout)


# --- X6 ------------------------------------------------------------------------

def settle_within(reserves: DataFrame, settles: DataFrame, key: str, time: str, hold: str, delay: str,
                  of_reserve: Sequence[str] = (), of_settle: Sequence[str] = ()) -> DataFrame:
    """Reservations with their settlement inside ``hold``; unsettled ones come out at their upper bound
    once the watermark passes. Further columns of either side may be named."""
    r = reserves.select(F.col(key).alias("r_key"), F.col(time).alias("r_time"), "usd_max", *of_reserve).withWatermark("r_time", delay)
    s = settles.select(F.col(key).alias("s_key"), F.col(time).alias("s_time"), "actual_usd", *of_settle).withWatermark("s_time", delay)
    cond = F.expr(f"r_key = s_key AND s_time >= r_time AND s_time <= r_time + INTERVAL {hold}")
    return r.join(s, cond, "left_outer").select(
        F.col("r_key").alias(key), "r_time", "s_time", F.coalesce("actual_usd", "usd_max").alias("usd"), F.col("s_time").isNull().alias("unsettled"), *of_reserve, *of_settle)
