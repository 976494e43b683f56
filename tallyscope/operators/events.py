"""Event schema, ledgers, thread roots, gap clusters and district hulls."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.operators.ordering import row_number
from tallyscope.session import cut_lineage

EVENT_COLUMNS = ["event_id", "family", "event_type", "parent_event_id", "registry_id", "event_date",
                 "published_date", "amount", "severity", "lifecycle", "details"]


def to_event_schema(df: DataFrame, **columns: Column) -> DataFrame:
    """One source family in the common event schema; absent fields are NULL."""
    types = {"event_date": "date", "published_date": "date", "amount": "double", "severity": "int", "registry_id": "bigint"}
    return df.select(*[columns.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in EVENT_COLUMNS])


def union_events(families: Sequence[DataFrame]) -> DataFrame:
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f)
    return out


def event_problems(events: DataFrame, parent_of: dict[str, str]) -> DataFrame:
    """Guards: repeated ids, unknown parents, severity outside sanctions, completed orders."""
    twice = events.groupBy("event_id").count().where("count > 1").select("event_id", F.lit("duplicate_id").alias("problem"))
    loud = events.where(F.col("severity").isNotNull() & (F.col("family") != "sanction")).select("event_id", F.lit("foreign_severity").alias("problem"))
    out = twice.unionByName(loud)
    for child, parent in parent_of.items():
        orphans = events.where(F.col("family") == child).join(
            events.where(F.col("family") == parent).select(F.col("event_id").alias("parent_event_id")), "parent_event_id", "left_anti")
        out = out.unionByName(orphans.select("event_id", F.lit("unknown_parent").alias("problem")))
        out = out.unionByName(events.where((F.col("family") == child) & (F.col("lifecycle") != "ordered")).select(
            "event_id", F.lit("overstated").alias("problem")))
    return out


def timeline_order() -> list[Column]:
    """Date first with missing dates last, then family and id."""
    return [F.coalesce(F.col("event_date"), F.lit("9999-12-31").cast("date")), F.col("family"), F.col("event_id")]


def collapse_awards(rows: DataFrame, key: str, invariant: Sequence[str], report: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(events, violations): one event per award if its fields agree over all report rows.

    Equality over a group is min = max, which combines before the shuffle. An event keeps its first and last report;
    ``award_reports`` gives all of them as rows.
    """
    agg = rows.groupBy(key).agg(
        *[F.min(c).alias(c) for c in invariant],
        F.array_compact(F.array(*[F.when(~F.min(c).eqNullSafe(F.max(c)) | (F.count(c) % F.count(F.lit(1)) != 0), F.lit(c))
                                  for c in invariant])).alias("varying"),
        F.count(F.lit(1)).alias("n_reports"), F.min(F.struct(*report)).alias("first_report"), F.max(F.struct(*report)).alias("last_report"))
    return agg.where(F.size("varying") == 0).drop("varying"), agg.where(F.size("varying") > 0).select(key, "varying")


def award_reports(rows: DataFrame, events: DataFrame, key: str, order: str, tie: str, report: Sequence[str]) -> DataFrame:
    """The report rows of agreeing awards, numbered by ``order`` and ``tie``: an award with any number of reports stays a table."""
    own = rows.join(events.select(key), key, "left_semi").select(key, order, tie, *report)
    return row_number(own, F.col(order), F.col(tie), [key], "position")


# --- ledger ------------------------------------------------------------------

def fold_ledger(log: DataFrame) -> DataFrame:
    """One row per reservation: reserve values, overridden by the latest settle or release.

    A settle without its reserve is ignored. Time, meter and period stay those of the reserve.
    log: entry, ts, kind, reservation_id, meter, period, usd_max, actual_usd
    """
    order = F.struct("ts", "entry")
    reserve = F.when(F.col("kind") == "reserve", order)
    later = F.when(F.col("kind").isin("settle", "release"), order)
    d = log.where(F.col("reservation_id").isNotNull()).groupBy("reservation_id").agg(
        F.max_by(F.struct("ts", "meter", "period", "usd_max"), reserve).alias("_r"), F.max(reserve).alias("_at"),
        F.max_by(F.struct("kind", "actual_usd"), later).alias("_s"), F.max(later).alias("_st"))
    d = d.where(F.col("_r").isNotNull())
    done = F.col("_st").isNotNull() & (F.col("_st") > F.col("_at"))
    kind = F.when(done, F.col("_s.kind")).otherwise("reserve")
    usd = F.when(kind == "settle", F.coalesce(F.col("_s.actual_usd"), F.lit(0.0))).when(kind == "release", 0.0).otherwise(
        F.coalesce(F.col("_r.usd_max"), F.lit(0.0)))
    return d.select("reservation_id", F.col("_r.ts").alias("ts"), F.col("_r.meter").alias("meter"), F.col("_r.period").alias("period"),
                    kind.alias("state"), usd.alias("usd"))


def billing_period(ts: Column, meter: Column, cycle_meter: str, cycle_day: int) -> Column:
    """Calendar month, except for the one meter billed from a fixed day of the month."""
    start = F.date_trunc("month", F.date_sub(ts.cast("date"), cycle_day - 1))
    return F.when(meter == cycle_meter, F.date_format(F.date_add(start.cast("date"), cycle_day - 1), "yyyy-MM-dd")).otherwise(
        F.date_format(ts, "yyyy-MM"))


def spend_by_period(folded: DataFrame, money_meters: Sequence[str]) -> DataFrame:
    counted = folded.where(F.col("meter").isin(*money_meters))
    return counted.groupBy("meter", "period").agg(
        F.round(F.sum("usd"), 4).alias("usd"), F.count_if(F.col("state") == "reserve").alias("unsettled"), F.count(F.lit(1)).alias("entries"))


def spend_gate(asked: Column, day_spent: Column, period_spent: Column, run_cap: float, day_cap: float, period_cap: float) -> Column:
    """First cap that refuses, in the order run, day, month; NULL means allowed."""
    return (F.when(asked > run_cap, "run").when(asked > F.greatest(F.lit(0.0), day_cap - day_spent), "day")
            .when(asked > F.greatest(F.lit(0.0), period_cap - period_spent), "month"))


# --- thread roots ------------------------------------------------------------

def thread_roots(posts: DataFrame) -> DataFrame:
    """Root of every post by pointer doubling; a cycle has none.

    posts: id, parent (NULL for a root). A parent that is not in the table is the root.
    Each round doubles the distance covered, so a chain of length n takes log2(n) rounds;
    only open rows are joined. The count of open rows falls in every round until only
    cycles are left, which is the stop rule.
    """
    ids = posts.select(F.col("id").alias("_i"), F.lit(1).alias("_known"))
    d = posts.select("id", F.col("parent").alias("ptr"))
    d = d.join(ids, F.col("ptr") == F.col("_i"), "left").select(
        "id", F.coalesce("ptr", "id").alias("ptr"), (F.col("ptr").isNull() | F.col("_known").isNull()).alias("done"))
    d = cut_lineage(d)
    left = d.where(~F.col("done")).count()
    while left:
        hop = d.select(F.col("id").alias("_i"), F.col("ptr").alias("_p"), F.col("done").alias("_d"))
        open_ = d.where(~F.col("done")).join(hop, F.col("ptr") == F.col("_i")).select("id", F.col("_p").alias("ptr"), F.col("_d").alias("done"))
        d = cut_lineage(d.where("done").unionByName(open_))
        now = d.where(~F.col("done")).count()
        if now == left:
            break
        left = now
    return d.select("id", F.when(F.col("done"), F.col("ptr")).alias("root"))


# --- clusters on a line ------------------------------------------------------

def gap_clusters(points: DataFrame, keys: Sequence[str], x: str, gap: float, min_support: int = 1,
                 block: int = 4096) -> DataFrame:
    """Clusters of a coordinate: a new one starts when the step is larger than ``gap``.

    Points of one cell of width ``gap`` always belong together, so a first aggregate keeps
    one row per occupied cell. Cells are cut into blocks; windows run inside blocks, and one
    summary row per block carries the open cluster to the next. No task sees a whole key.
    """
    cells = points.groupBy(*keys, F.floor(F.col(x) / gap).alias("_cell")).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.sum(x).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_b", F.floor(F.col("_cell") / block))
    inside = Window.partitionBy(*keys, "_b").orderBy("_cell")
    ends = cells.groupBy(*keys, "_b").agg(F.max("_hi").alias("_last"))
    chain = Window.partitionBy(*keys).orderBy("_b")
    ends = ends.withColumn("_before", F.lag("_last").over(chain)).drop("_last")
    d = cells.join(ends, [*keys, "_b"])
    prev = F.coalesce(F.lag("_hi").over(inside), F.col("_before"))
    d = d.withColumn("_start", F.when(prev.isNull() | (F.col("_lo") - prev > gap), F.col("_lo")))
    d = d.withColumn("_local", F.last("_start", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    carry = d.groupBy(*keys, "_b").agg(F.max("_start").alias("_s")).withColumn(
        "_carry", F.last("_s", True).over(chain.rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
    d = d.join(carry, [*keys, "_b"]).withColumn("cluster_start", F.coalesce("_local", "_carry"))
    return d.groupBy(*keys, "cluster_start").agg(
        F.max("_hi").alias("cluster_end"), (F.sum("_sum") / F.sum("_n")).alias("center"), F.sum("_n").alias("support")).where(
        F.col("support") >= min_support)


def nearest_center(points: DataFrame, centers: DataFrame, keys: Sequence[str], x: str, tol: float) -> DataFrame:
    """Nearest centre within ``tol`` per point (lower centre on a tie), by a grid of cell width ``tol``.

    A centre within reach lies in the point's cell or a neighbour, so three equality lookups
    replace the range join. Points without a centre keep NULL.
    """
    c = centers.select(*keys, F.col("center"), F.explode(F.array(*[F.floor(F.col("center") / tol) + i for i in (-1, 0, 1)])).alias("_cell"))
    p = points.withColumn("_cell", F.floor(F.col(x) / tol))
    # Within one cell only the centres of three cells compete; keep them as one short list.
    per_cell = c.groupBy(*keys, "_cell").agg(F.array_sort(F.collect_set("center")).alias("_cs"))
    d = p.join(per_cell, [*keys, "_cell"], "left")
    best = F.array_min(F.transform("_cs", lambda v: F.struct(F.abs(v - F.col(x)).alias("g"), v.alias("v"))))
    return d.withColumn("center", F.when(best["g"] <= tol, best["v"])).drop("_cs", "_cell")


# --- hulls -------------------------------------------------------------------

def _hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise from the leftmost-lowest point.

    Between two known vertices the point farthest outside their line is the next vertex; points inside are dropped,
    so each turn works on fewer. Of points equally far the one farthest along the line is an end, hence a vertex.
    """
    known = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(known) < 3:
        return known
    first, last = known[0], known[-1]

    def between(p: np.ndarray, q: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        away = (q[1] - p[1]) * (rest[:, 0] - p[0]) - (q[0] - p[0]) * (rest[:, 1] - p[1])
        rest, away = rest[away > 0], away[away > 0]
        if not len(rest):
            return []
        far = rest[away == away.max()]
        turn = far[np.argmax((far - p) @ (q - p))]
        return [*between(p, turn, rest), turn, *between(turn, q, rest)]

    return np.array([first, *between(first, last, known), last, *between(last, first, known)])


def district_hulls(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Convex hull per district in three steps.

    Every Arrow batch is reduced to its own hull vertices, these to the hulls of parts of the
    district, and only the parts' vertices meet in the task of a district.
    """
    schema = f"{key} {points.schema[key].dataType.simpleString()}, x double, y double"
    d = points.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")

    kind = points.schema[key].dataType.simpleString()

    def reduce(batches):
        for pdf in batches:
            for k, g in pdf.groupby(key, sort=False, dropna=False):
                hull = _hull(g[["x", "y"]].to_numpy())
                yield pd.DataFrame({key: [k] * len(hull), "x": hull[:, 0], "y": hull[:, 1]})

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(hull), "vertex": range(len(hull)), "x": hull[:, 0], "y": hull[:, 1]})

    parts = d.mapInPandas(reduce, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = parts.groupBy(key, "_part").applyInPandas(part, f"{key} {kind}, vertex int, x double, y double")
    return parts.groupBy(key).applyInPandas(part, f"{key} {kind}, vertex int, x double, y double")
