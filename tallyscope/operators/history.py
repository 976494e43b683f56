"""Point-in-time features: everything seen strictly before an as-of date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C

COUNTS = ["n_penalties_prior", "total_fine_prior", "n_nonmonetary_prior",
          "n_responsible_prior", "n_individual_prior", "max_severity_prior",
          "sum_severity_prior", "n_severe_prior"]


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def penalty_history(pen: DataFrame, as_of: str, lookback_years: int | None = None,
                    responsible: str = "responsible", individual: str = "individual") -> DataFrame:
    """Sanction history per id before ``as_of``: one partial aggregate, one shuffle."""
    past = pen.where(F.col("date") < day(as_of))
    if lookback_years is not None:
        past = past.where(F.col("date") >= F.add_months(day(as_of), -12 * lookback_years))
    count_of = lambda cond: F.count_if(cond)
    return past.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_penalties_prior"),
        F.coalesce(F.sum("fine"), F.lit(0.0)).alias("total_fine_prior"),
        count_of(F.col("fine").isNull()).alias("n_nonmonetary_prior"),
        count_of(F.col("role") == responsible).alias("n_responsible_prior"),
        count_of(F.col("role") == individual).alias("n_individual_prior"),
        F.max("severity").alias("max_severity_prior"),
        F.sum("severity").alias("sum_severity_prior"),
        count_of(F.col("severity") >= 4).alias("n_severe_prior"),
        F.datediff(day(as_of), F.max("date")).alias("days_since_last_penalty"))


def fleet_features(assets: DataFrame, as_of: str, snapshot: str) -> DataFrame:
    """Active assets and the age of the oldest one.

    The register keeps only the latest state, so it says nothing about a date before
    it was taken: the result is then empty and the caller keeps NULL. An unknown build
    date counts, but has no age.
    """
    usable = day(as_of) >= day(snapshot)
    seen = assets.where(usable & (F.col("state") == "active") & (
        F.col("built").isNull() | (F.col("built") <= day(as_of))))
    return seen.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_assets"),
        C.years_between(day(as_of), F.min("built")).alias("oldest_asset_years"))


def latest_evaluation(ev: DataFrame, as_of: str, key: str = "id") -> DataFrame:
    """Newest evaluation before ``as_of`` with prior counts; equal dates go to the higher record."""
    seen = ev.where(F.col("date") < day(as_of))
    newest = F.max_by("partial", F.struct("date", "rec"))
    return seen.groupBy(key).agg(
        newest.alias("eval_partial"), F.max("date").alias("eval_date"),
        F.count(F.lit(1)).alias("n_evaluations_prior"),
        F.sum("partial").alias("n_partial_prior"),
        F.datediff(day(as_of), F.max("date")).alias("days_since_evaluation"))


def sibling_rates(inst: DataFrame, pen: DataFrame, as_of: str, role: str) -> DataFrame:
    """Operator rate without the row's own contribution; NULL without siblings.

    Counts are taken per (operator, parent) pair, and a row gives back exactly what its
    own pair put into the operator total.
    """
    past = (pen.where((F.col("date") < day(as_of)) & (F.col("role") == role))
            .groupBy("id").agg(F.count(F.lit(1)).alias("_n")))
    named = inst.where(F.col("operator").isNotNull() & (F.col("operator") != ""))
    pairs = (named.groupBy("operator", "parent").agg(F.min("id").alias("id"))
             .join(past, "id", "left").select("operator", "parent",
                                               F.coalesce("_n", F.lit(0)).alias("_own")))
    totals = pairs.groupBy("operator").agg(F.count(F.lit(1)).alias("_parks"),
                                           F.sum("_own").alias("_total"))
    out = named.join(pairs, ["operator", "parent"]).join(totals, "operator")
    siblings = F.col("_parks") - 1
    others = F.col("_total") - F.col("_own")
    return out.select("id", siblings.alias("op_siblings"), others.alias("op_sibling_penalties"),
                      C.ratio(others, siblings).alias("op_sibling_rate"))


def build_features(inst: DataFrame, pen: DataFrame, assets: DataFrame, ev: DataFrame, as_of: str,
                   snapshot: str, responsible: str, individual: str,
                   operator_rates: DataFrame | None = None) -> DataFrame:
    """One row per institution. Counts without history are 0; everything else stays NULL."""
    d = inst.join(penalty_history(pen, as_of, None, responsible, individual), "id", "left")
    d = d.join(fleet_features(assets, as_of, snapshot), "id", "left")
    if operator_rates is not None:
        d = d.join(operator_rates, "id", "left")
    d = d.join(latest_evaluation(ev, as_of), "id", "left")
    usable = day(as_of) >= day(snapshot)
    d = d.na.fill(0, COUNTS + ["n_evaluations_prior", "n_partial_prior"])
    return (d.withColumn("has_evaluation", F.col("eval_date").isNotNull().cast("int"))
            .withColumn("n_assets", F.when(usable, F.coalesce("n_assets", F.lit(0))))
            .withColumn("has_asset", F.when(usable, (F.col("n_assets") > 0).cast("int")))
            .withColumn("has_prior_penalty", (F.col("n_penalties_prior") > 0).cast("int")))


def future_label(ids: DataFrame, pen: DataFrame, start: str, end: str, min_severity: int = 1,
                 roles: Sequence[str] | None = None) -> DataFrame:
    """0/1 label: any sanction in [start, end) of at least the severity, in the roles."""
    hit = pen.where((F.col("date") >= day(start)) & (F.col("date") < day(end))
                    & (F.col("severity") >= min_severity))
    if roles is not None:
        hit = hit.where(F.col("role").isin(*roles))
    hit = hit.select("id").distinct().withColumn("_hit", F.lit(1))
    return ids.join(hit, "id", "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def event_summary(events: DataFrame, as_of: str, escalating: Sequence[str],
                  windows: Sequence[int] = (90, 365)) -> DataFrame:
    """Escalating events per window (inclusive) and the latest event of any type."""
    d = events.where(F.col("id").isNotNull() & (F.col("date") <= day(as_of)))
    loud = F.col("type").isin(*escalating)
    return d.groupBy("id").agg(
        *[F.count_if(loud & (F.col("date") >= F.date_sub(day(as_of), w))).alias(f"events_{w}d")
          for w in windows],
        F.max_by("type", F.struct("date", "rec")).alias("latest_event_type"),
        F.max("date").alias("latest_event_date"))


def recency_heat(items: DataFrame, as_of: str, routine: str, order: Sequence[str],
                 steps: Sequence[tuple[int, float]], tiers: Sequence[tuple[float, int]]) -> DataFrame:
    """Recency-weighted attention per id.

    Routine items do not count, items without a kind count and are reported, items after
    ``as_of`` or without a date are left out. The top category is the first in ``order``.
    """
    kind = F.coalesce("kind", F.lit(""))
    counted_kind = kind != routine
    age = F.datediff(day(as_of), F.col("date"))
    weight = F.when(age < 0, 0.0)
    for limit, w in steps:
        weight = weight.when(age <= limit, w)
    weight = F.when(counted_kind, F.coalesce(weight.otherwise(0.0), F.lit(0.0))).otherwise(0.0)
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    live = weight > 0
    agg = items.withColumn("_w", weight).withColumn("_p", F.when(live & (place > 0), place)).groupBy("id").agg(
        F.count_if(F.col("_w") > 0).alias("n"),
        F.round(F.sum("_w"), 2).alias("score"),
        F.count_if(kind == "").alias("unclassified"),
        F.count(F.lit(1)).alias("total"),
        F.max(F.when(F.col("_w") > 0, F.col("date"))).alias("latest"),
        F.min("_p").alias("_p"))
    tier = F.lit(None).cast("int")
    chain = F.when(F.col("score") >= tiers[0][0], tiers[0][1])
    for limit, level in tiers[1:]:
        chain = chain.when(F.col("score") >= limit, level)
    tier = chain.when(F.col("score") > 0, 1).otherwise(0)
    names = F.array(*[F.lit(c) for c in order])
    return (agg.withColumn("tier", tier)
            .withColumn("category", F.get(names, (F.col("_p") - 1).cast("int"))).drop("_p"))
