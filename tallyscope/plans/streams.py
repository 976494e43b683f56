"""Streams over the supplied events, drained and compared with their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.plans.events import LEDGER, ledger_columns
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import with_
from tallyscope.streaming import streams as S


def event_stream(t: Tables) -> DataFrame:
    d = S.read_table_stream(t.spark, t.folder, "events.parquet")
    return d.withColumn("ts", C.utc_instant(F.col("ts")))


@plan("X5", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_totals(t: Tables) -> DataFrame:
    out = S.run(S.daily_totals(event_stream(t), "event_type", "ts", "value", "2 days"), "daily", "update")
    d = S.latest_per_key(out, ["event_type", "start"])
    return d.select("event_type", C.utc_day(F.col("start")).alias("day"), "n", F.round("total", 4).alias("total"))


@plan("X1 X2 X3", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type <> 'error'")
def stream_unique_mentions(t: Tables) -> DataFrame:
    d = event_stream(t).where(F.col("event_type") != "error")
    d = S.unique_mentions(d, "event_id", "ts", "40 days", F.to_timestamp(F.lit("2024-01-10T00:00:00Z")))
    return S.run(S.with_observed_time(d, "ts", "ts"), "mentions").select("event_id", "user_id")


@plan("X7", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)")
def stream_new_discoveries(t: Tables) -> DataFrame:
    known = t.customer.where(F.col("c_acctbal") > 1000).select(F.col("c_custkey").alias("user_id"))
    return S.run(S.not_known(event_stream(t), known, "user_id"), "discovery").select("event_id")


@plan("X5 X6", with_(more=LEDGER) + "SELECT rid AS reservation_id, meter, state, round(usd, 4) AS usd FROM fo")
def stream_ledger_state(t: Tables) -> DataFrame:
    out = S.run(S.ledger_state(ledger_columns(event_stream(t)), "ts", "1 day", 60), "ledger", "update")
    return S.latest_per_key(out, ["reservation_id"]).select("reservation_id", "meter", "state", F.round("usd", 4).alias("usd"))


@plan("X4", """SELECT event_type, CAST(s AS DATE) AS start, count(*) AS n FROM events, LATERAL (SELECT CAST(ts AS DATE) - CAST(i AS INTEGER) AS s FROM range(0, 3) r(i)) u GROUP BY 1, 2""")
def stream_rolling_counts(t: Tables) -> DataFrame:
    out = S.run(S.rolling_counts(event_stream(t), "event_type", "ts", "3 days", "1 day", "5 days"), "rolling", "update")
    d = S.latest_per_key(out, ["event_type", "start", "end"])
    return d.select("event_type", C.utc_day(F.col("start")).alias("start"), "n")


@plan("X6", with_(more=LEDGER) + """SELECT r.rid AS reservation_id, r.entry, s.entry AS settled_by, round(coalesce(s.actual, r.usd_max), 4) AS usd, s.entry IS NULL AS unsettled
    FROM lg r LEFT JOIN lg s ON s.rid = r.rid AND s.kind = 'settle' AND s.ts >= r.ts AND s.ts <= r.ts + INTERVAL 3 DAY WHERE r.kind = 'reserve' AND r.rid IS NOT NULL AND r.ts < TIMESTAMP '2024-01-15'""")
def stream_settled_reservations(t: Tables) -> DataFrame:
    """Reservations of the first half with their settlements inside three days; the others came out when the watermark passed."""
    log = ledger_columns(event_stream(t)).where(F.col("reservation_id").isNotNull())
    pick = lambda kind: log.where(F.col("kind") == kind).select("reservation_id", "ts", "entry", "usd_max", "actual_usd")
    d = S.settle_within(pick("reserve").withColumnRenamed("entry", "r_entry"), pick("settle").withColumnRenamed("entry", "s_entry"), "reservation_id", "ts", "3 DAYS", "1 day", ["r_entry"], ["s_entry"])
    out = S.run(d, "settled").where(F.col("r_time") < F.to_timestamp(F.lit("2024-01-15T00:00:00Z")))
    return out.select("reservation_id", F.col("r_entry").alias("entry"), F.col("s_entry").alias("settled_by"), F.round("usd", 4).alias("usd"), "unsettled")


@plan("X1 S11", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS first_ts FROM events GROUP BY 1")
def stream_append_store(t: Tables) -> DataFrame:
    """The append-only store: each key's first row, whatever comes later."""
    folder = S.work_folder(t.spark, "store")
    rows = event_stream(t).select("user_id", "event_id", F.col("ts").alias("first_ts"))
    S.append_store(rows, "user_id", ["first_ts", "event_id"], folder)
    return t.spark.read.parquet(f"{folder}/store").select("user_id", "event_id", C.utc_instant(F.col("first_ts")).alias("first_ts"))
