"""Robust comparison of an entity with its own cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import fixed
from tallyscope.operators import ordering as O
from tallyscope.session import counted_side, cut_lineage


def melt(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per present feature value; absent values leave no row."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                         F.col(f).cast("double").alias("value")) for f in features]))
    return (df.select(*keys, cells.alias("_c"))
            .select(*keys, "_c.feature", "_c.value").where(F.col("value").isNotNull()))


def cohort_scales(long: DataFrame, cohort: Sequence[str], **kw) -> DataFrame:
    """Median, MAD, hinges and robust scale per cohort of a long table.

    The table is read several times (positions, then deviations), so it is materialised
    once, and so is the one-row-per-cohort result of the first round.
    """
    value = F.col("value")
    long = cut_lineage(long.select(*cohort, "value"))
    stats = O.order_statistics(long, value, cohort, O.hinge_picks(), **kw)
    stats = (stats.withColumn("median", (F.col("_m1") + F.col("_m2")) / 2)
             .withColumn("q1", F.when(F.col("n") >= 4, (F.col("_a1") + F.col("_a2")) / 2))
             .withColumn("q3", F.when(F.col("n") >= 4, (F.col("_b1") + F.col("_b2")) / 2))
             .drop("_m1", "_m2", "_a1", "_a2", "_b1", "_b2"))
    stats = counted_side(stats)
    away = long.join(stats.select(*cohort, "median"), list(cohort))
    mads = O.medians(away.withColumn("_d", F.abs(value - F.col("median"))), F.col("_d"),
                     cohort, "mad", **kw).drop("n")
    spread = F.col("q3") - F.col("q1")
    return stats.join(mads, list(cohort)).withColumn("scale", F.greatest(
        F.when(F.col("mad") > 0, fixed.MAD_TO_SD * F.col("mad")),
        F.when(spread > 0, spread / fixed.IQR_TO_SD)))


def mad_z(long: DataFrame, cohort: Sequence[str], min_peers: int = fixed.MIN_PEERS_BUDGET,
          **kw) -> DataFrame:
    """MAD-only z; NULL under ``min_peers`` peers or without spread."""
    scales = counted_side(cohort_scales(long, cohort, **kw).select(*cohort, "n", "median", "mad"))
    z = F.when((F.col("n") >= min_peers) & (F.col("mad") > 0),
               (F.col("value") - F.col("median")) / (fixed.MAD_TO_SD * F.col("mad")))
    return long.join(scales, list(cohort)).withColumn("z", z)


def robust_z(long: DataFrame, cohort: Sequence[str], min_peers: int = fixed.MIN_PEERS,
             pool: Column | None = None, **kw) -> DataFrame:
    """Long table with z and cohort size; rows of small cohorts are left out.

    ``pool`` keeps ineligible rows out of the peer statistics while they are still
    scored against them.
    """
    peers = long if pool is None else long.where(pool)
    scales = counted_side(cohort_scales(peers, cohort, **kw).where(F.col("n") >= min_peers))
    return long.join(scales, list(cohort)).withColumn(
        "z", (F.col("value") - F.col("median")) / F.col("scale"))


def peer_scores(scored: DataFrame, row_keys: Sequence[str], top: int = 3) -> DataFrame:
    """Mean capped |z| per row, its largest contributions and the reportable ones.

    A row has at most one entry per feature, so the collected arrays stay small.
    """
    size = F.abs(F.col("z"))
    entry = F.struct((-size).alias("o"), F.col("feature").alias("feature"), F.col("z").alias("z"))
    ranked = F.array_sort(F.collect_list(F.when(F.col("z").isNotNull(), entry)))
    return (scored.groupBy(*row_keys)
            .agg(F.avg(F.least(size, F.lit(fixed.Z_CAP))).alias("score"),
                 F.count("z").alias("n_features"),
                 ranked.alias("_r"))
            .withColumn("contributions", F.transform(F.slice("_r", 1, top), lambda e: e["feature"]))
            .withColumn("anomalies", F.transform(
                F.filter("_r", lambda e: F.abs(e["z"]) >= fixed.Z_REPORT), lambda e: e["feature"]))
            .drop("_r"))


def yearly_changes(long: DataFrame, entity: str, year: str) -> DataFrame:
    """Change of every feature from the preceding available year of the whole panel.

    The window runs over the distinct years of the panel, a handful of rows; the change
    itself is an equality join on (entity, feature, earlier year).
    """
    years = long.select(F.col(year).alias("_z")).distinct().withColumn("_p", F.lag("_z").over(Window.orderBy("_z")))
    now = long.join(years.where(F.col("_p").isNotNull()), F.col(year) == F.col("_z")).drop("_z")
    earlier = long.select(F.col(entity).alias("_e"), F.col("feature").alias("_f"),
                          F.col(year).alias("_py"), F.col("value").alias("_pv"))
    return (now.join(earlier, (F.col(entity) == F.col("_e")) & (F.col("feature") == F.col("_f"))
                     & (F.col("_p") == F.col("_py")))
            .withColumn("value", F.col("value") - F.col("_pv"))
            .drop("_e", "_f", "_py", "_pv", "_p"))


def percentile_in_group(df: DataFrame, score: str, tie: Column, groups: Sequence[str],
                        **kw) -> DataFrame:
    """Rank by score (high first) and 100·(n−rank)/max(n−1,1) to one decimal."""
    ranked = O.row_number(df.where(F.col(score).isNotNull()), F.col(score), tie, groups,
                          out="rank_in_group", descending=True, size="n_ranked", **kw)
    return ranked.withColumn("percentile", F.bround(
        100.0 * (F.col("n_ranked") - F.col("rank_in_group"))
        / F.greatest(F.col("n_ranked") - 1, F.lit(1)), 1))
