"""One-to-one nearest matching without replacement, cases in ascending order.

The rule is sequential: each case takes the nearest control still free. But m cases whose
nearest controls have positions a..b can only use positions a-(m-1)..b+(m-1), because a case
goes further only past taken ones. So cases are grouped until these ranges no longer
overlap, and every group is solved by itself. Groups, not strata, go to tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.operators import ordering as O
from tallyscope.session import cut_lineage


def merge_intervals(df: DataFrame, key: str, lo: str, hi: str, block: int = 4096) -> DataFrame:
    """Adds ``span``: the smallest start of the overlapping run each interval belongs to.

    Windows run inside blocks of start positions; one summary row per block carries the
    furthest end and the open run onwards.
    """
    d = df.withColumn("_b", F.floor(F.col(lo) / block))
    inside = Window.partitionBy(key, "_b").orderBy(lo, hi)
    chain = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(key, "_b").agg(F.max(hi).alias("_e")).withColumn("_far", F.max("_e").over(chain)).drop("_e")
    d = d.join(ends, [key, "_b"])
    reach = F.greatest(F.max(hi).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    d = d.withColumn("_start", F.when(reach.isNull() | (F.col(lo) > reach), F.col(lo)))
    d = d.withColumn("_local", F.last("_start", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    carry = d.groupBy(key, "_b").agg(F.max("_start").alias("_s")).withColumn("_carry", F.last("_s", True).over(chain)).drop("_s")
    return d.join(carry, [key, "_b"]).withColumn("span", F.coalesce("_local", "_carry")).drop(
        "_b", "_far", "_start", "_local", "_carry")


def _greedy(cases: pd.DataFrame, controls: pd.DataFrame) -> list[tuple[int, int]]:
    """The sequential rule on sorted cases and controls, near-linear: taken controls are deleted from two lists of links.

    ``after[i]`` leads to the first free control at or behind i, ``before[i]`` to the last free one ahead of i; links are
    shortened on the way (union-find), so each deletion is followed a few times only.
    """
    caps, ids = controls["cap"].to_numpy(), controls["cid"].to_numpy()
    n = len(caps)
    first = np.searchsorted(caps, caps)  # of equal capacities the first one goes first
    after, before = list(range(n + 1)), list(range(n + 1))

    def follow(links: list[int], i: int) -> int:
        end = i
        while links[end] != end:
            end = links[end]
        while links[i] != end:
            links[i], i = end, links[i]
        return end

    out = []
    for cid, cap, at in zip(cases["cid"], cases["cap"], np.searchsorted(caps, cases["cap"].to_numpy()).tolist()):
        high, low = follow(after, at), follow(before, at) - 1
        if low < 0 and high == n:
            break
        if low >= 0:
            low = follow(after, int(first[low]))
        best = low if high == n or low >= 0 and cap - caps[low] <= caps[high] - cap else high
        out.append((cid, ids[best]))
        after[best] = best + 1
        before[best + 1] = best
    return out


def match_without_replacement(cases: DataFrame, controls: DataFrame, stratum: str, id_col: str, capacity: str) -> DataFrame:
    """(stratum, case, control) pairs; equal distances go to the smaller capacity, then id."""
    pick = lambda d: d.select(F.col(stratum).alias("s"), F.col(id_col).cast("long").alias("cid"), F.col(capacity).cast("double").alias("cap")).where("cap is not null")
    case, ctrl = pick(cases), cut_lineage(O.row_number(pick(controls), F.col("cap"), F.col("cid"), ["s"], "j"))
    # Controls at or below each case, by one merged count.
    both = case.withColumn("w", F.lit(0).cast("long")).unionByName(ctrl.select("s", "cid", "cap").withColumn("w", F.lit(1).cast("long")))
    placed = O.tie_counts(both, F.col("cap"), ["s"], "_below", "_upto", "_n", weight=F.col("w")).where("w = 0")
    placed = cut_lineage(placed.select("s", "cid", "cap", "_upto", "_n").where("_n > 0"))
    spot = ctrl.groupBy("s", "cap").agg(F.min("j").alias("first"), F.max("j").alias("last"))
    low = spot.select("s", F.col("last").alias("_upto"), F.col("cap").alias("_lc"), F.col("first").alias("_lj"))
    high = spot.select("s", (F.col("first") - 1).alias("_upto"), F.col("cap").alias("_hc"), F.col("first").alias("_hj"))
    near = placed.join(low, ["s", "_upto"], "left").join(high, ["s", "_upto"], "left")
    lower = F.col("_lc").isNotNull() & (F.col("_hc").isNull() | (F.col("cap") - F.col("_lc") <= F.col("_hc") - F.col("cap")))
    near = near.select("s", "cid", "cap", F.when(lower, F.col("_lj")).otherwise(F.col("_hj")).alias("p"))
    near = cut_lineage(near)
    groups = near.groupBy("s", "p").agg(F.count(F.lit(1)).alias("m")).withColumns({"a": F.col("p"), "b": F.col("p")})
    members = groups.select("s", "p", F.col("p").alias("g"))
    runs = cut_lineage(groups.select("s", F.col("p").alias("g"), "m", "a", "b"))
    members = cut_lineage(members)
    count = runs.count()
    while True:
        wide = runs.withColumns({"lo": F.col("a") - F.col("m") + 1, "hi": F.col("b") + F.col("m") - 1})
        spans = cut_lineage(merge_intervals(wide, "s", "lo", "hi"))
        merged = spans.groupBy("s", "span").agg(F.sum("m").alias("m"), F.min("a").alias("a"), F.max("b").alias("b")).withColumnRenamed("span", "g")
        members = cut_lineage(members.join(spans.select("s", "g", "span"), ["s", "g"]).select("s", "p", F.col("span").alias("g")))
        runs = cut_lineage(merged)
        now = runs.count()
        if now == count:
            break
        count = now
    owned = runs.select("s", "g", F.explode(F.sequence(F.greatest(F.col("a") - F.col("m") + 1, F.lit(1)), F.col("b") + F.col("m") - 1)).alias("j"))
    pool = ctrl.join(owned, ["s", "j"]).select("s", "g", "j", "cid", "cap")
    todo = near.join(members, ["s", "p"]).select("s", "g", "cid", "cap")
    kind = cases.schema[stratum].dataType.simpleString()

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=["stratum", "case_id", "control_id"])
        pairs = _greedy(left.sort_values(["cap", "cid"]), right.sort_values("j"))
        return pd.DataFrame([(left["s"].iloc[0], a, b) for a, b in pairs], columns=["stratum", "case_id", "control_id"])

    return todo.groupBy("s", "g").cogroup(pool.groupBy("s", "g")).applyInPandas(
        solve, f"stratum {kind}, case_id long, control_id long")
