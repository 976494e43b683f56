"""Ranked review lists, tiers, district boards and ranking quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed
from tallyscope.operators import ordering as O
from tallyscope.session import cut_lineage


def priority_ranks(df: DataFrame, score: Column, tie: Column, kind: str, **kw) -> DataFrame:
    """Overall rank, rank within kind and decile of an ascending score.

    Ranking reads its input several times, so the scored table is materialised first.
    The decile needs the ascending position with ties in list order, which follows from
    the descending one and the tie counts without another pass.
    """
    d = O.row_number(cut_lineage(df), score, tie, (), "rank_overall", descending=True,
                     size="n_ranked", before="_above", upto="_upto", **kw)
    ascending = F.col("n_ranked") - F.col("_upto") + F.col("rank_overall") - F.col("_above")
    d = d.withColumn("decile", C.decile_of_rank(ascending, F.col("n_ranked")))
    return O.row_number(d.drop("n_ranked", "_above", "_upto"), score, tie, [kind],
                        "rank_within_kind", descending=True, **kw)


def usable_columns(features: Sequence[str], *frames: DataFrame) -> list[str]:
    """Features with at least one value in every frame: one aggregate row per frame."""
    keep = list(features)
    for frame in frames:
        row = frame.agg(*[F.count(f).alias(f) for f in features]).first()
        keep = [f for f in keep if row[f]]
    return keep


def review_reasons(df: DataFrame, top_k: int) -> DataFrame:
    """Ordered reasons, evidence tier and sufficiency text of a ranked row."""
    filed = F.col("years_checked") > 0
    why = F.concat_ws(
        "；",
        F.when(F.col("failed_high") > 0, "filing check failed (high)")
        .when(F.col("failed_total") > 0, "filing check failed"),
        F.when(F.col("recent_partial") == 1, "recent partial evaluation"),
        F.when(F.col("events_90d") > 0, "official event within 90 days"),
        F.when(F.col("rank_overall") <= top_k, f"score among the first {top_k}"))
    return (df.withColumn("evidence_tier", F.when(filed, "registry+sanctions+fees+filings")
                          .when(F.col("has_fees") == 1, "registry+sanctions+fees")
                          .otherwise("registry+sanctions"))
            .withColumn("data_sufficiency", F.when(filed, "filing checks possible")
                        .otherwise("insufficient data, not low risk"))
            .withColumn("review_reason", why)
            .withColumn("flagged", (why != "").cast("int")))


def district_board(points: DataFrame, k: int) -> DataFrame:
    """Indirectly standardised flag rate per district.

    Two aggregates: the base rate per kind (few rows), then observed and expected per
    district. Districts under the exposure gate keep NULL limits and no rank.
    """
    flag = F.when(F.col("rank_overall") <= k, 1).otherwise(0)
    base = points.groupBy("kind").agg(F.avg(flag).alias("_base"))
    cells = points.groupBy("town", "kind").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(flag).alias("_obs"),
        F.count_if(F.col("prior") > 0).alias("_pen")).join(base, "kind")
    rows = cells.groupBy("town").agg(
        F.sum("_n").alias("n"), F.sum("_obs").alias("observed"),
        F.sum(F.col("_n") * F.col("_base")).alias("_exp"), F.sum("_pen").alias("penalised"))
    low, high = C.byar_limits(F.col("observed"), F.col("_exp"))
    enough = F.col("_exp") >= fixed.MIN_EXPECTED
    sir = F.col("observed") / F.col("_exp")
    level = (F.when(~enough, 0).when(low > 1, 4).when(high < 1, 1).when(sir >= 1, 3).otherwise(2))
    out = rows.select(
        "town", "n", "observed", "penalised", F.round("_exp", 4).alias("expected"),
        F.when(enough, F.round(sir, 4)).alias("ratio"), F.when(enough, F.round(low, 4)).alias("low"),
        F.when(enough, F.round(high, 4)).alias("high"), level.alias("level"))
    # One row per district from here on: a few thousand rows at any data size.
    order = Window.orderBy((F.col("level") == 0), F.desc("level"), F.desc(F.coalesce("low", F.lit(0.0))),
                           F.desc("observed"), "town")
    return out.withColumn("rank", F.when(F.col("level") > 0, F.row_number().over(order)))


def district_summary(points: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return points.groupBy("town").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in kinds],
        F.count_if(F.col("filed") == 1).alias("filed"),
        F.round(100 * F.avg((F.col("filed") == 1).cast("int")), 1).alias("filed_pct"),
        F.count_if(F.col("prior") > 0).alias("penalised"))


def tiered_proposal(df: DataFrame, tiers: Sequence[Column], position: Column, tie: Column,
                    total: int) -> DataFrame:
    """Fill a proposal tier by tier: first true predicate, then rank; the first ``total`` rows."""
    tier = F.lit(len(tiers) + 1)
    for level in range(len(tiers), 0, -1):
        tier = F.when(tiers[level - 1], level).otherwise(tier)
    return df.withColumn("tier", tier).orderBy("tier", position, tie).limit(total)


def top_per_group(df: DataFrame, group: str, value: Column, tie: Column, n: int, **kw) -> DataFrame:
    """The first n rows of every group by descending value."""
    return O.row_number(df, value, tie, [group], "position", descending=True, **kw).where(
        F.col("position") <= n)


def quality_at(df: DataFrame, rank: str, label: str, ks: Sequence[int]) -> DataFrame:
    """Precision, recall and lift at each k from one aggregate."""
    picks = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"),
                 *[F.sum(F.when(F.col(rank) <= k, F.col(label))).alias(f"h{k}") for k in ks])
    hits = F.lit(None).cast("bigint")
    long = row.select("*", picks)
    for k in ks:
        hits = F.when(F.col("k") == k, F.col(f"h{k}")).otherwise(hits)
    depth = F.least(F.col("k"), F.col("n"))
    long = long.select("k", "n", "pos", hits.alias("hits"), depth.alias("_d"))
    return long.select("k", "hits", C.ratio(F.col("hits"), F.col("_d")).alias("precision"),
                       C.ratio(F.col("hits"), F.col("pos")).alias("recall"),
                       C.ratio(F.col("hits") / F.col("_d"), F.col("pos") / F.col("n")).alias("lift"))


def rank_auc(df: DataFrame, value: Column, label: str, groups: Sequence[str] = (), **kw) -> DataFrame:
    """Area under the curve from average ranks, with Mann-Whitney U and rank-biserial.

    NULL without both classes. The two-sided p uses the normal approximation with tie
    correction and continuity correction.
    """
    names = list(groups)
    d = O.tie_counts(df.where(value.isNotNull()), value, names, **kw)
    average = (F.col("n_below") + 1 + F.col("n_upto")) / 2
    same = F.col("n_upto") - F.col("n_below")
    agg = d.groupBy(*names).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"),
        F.sum(F.when(F.col(label) == 1, average)).alias("_r"),
        F.sum(same.cast("double") * same - 1).alias("_t"))
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = p + q
    u = F.col("_r") - p * (p + 1) / 2
    spread = F.sqrt(p * q / 12 * (n + 1 - F.col("_t") / (n * (n - 1))))
    both = (p > 0) & (q > 0)
    return (agg.withColumn("u", F.when(both, u)).withColumn("auc", F.when(both, u / (p * q)))
            .withColumn("rank_biserial", F.when(both, 2 * u / (p * q) - 1))
            .withColumn("z", F.when(both & (spread > 0), (F.abs(u - p * q / 2) - 0.5) / spread))
            .withColumn("p", F.least(F.lit(1.0), 2 * C.normal_tail(F.col("z"))))
            .drop("_r", "_t"))


def two_by_two(df: DataFrame, flag: str, label: str, groups: Sequence[str] = (),
               min_arm: int = 5) -> DataFrame:
    """Flagged against unflagged outcome rate with one-sided Fisher p (NULL under min_arm).

    The hypergeometric tail is a fold over the possible hits of the flagged arm,
    evaluated on the one counted row.
    """
    d = df.groupBy(*groups).agg(
        F.count_if(F.col(flag) == 1).alias("n"), F.count_if((F.col(flag) == 1) & (F.col(label) == 1)).alias("hits"),
        F.count_if(F.col(flag) == 0).alias("m"), F.count_if((F.col(flag) == 0) & (F.col(label) == 1)).alias("_hb"))
    enough = (F.col("n") >= min_arm) & (F.col("m") >= min_arm)
    rate, base = F.col("hits") / F.col("n"), F.col("_hb") / F.col("m")
    odds = C.ratio(F.col("hits") * (F.col("m") - F.col("_hb")), (F.col("n") - F.col("hits")) * F.col("_hb"))
    p = hypergeometric_tail(F.col("n") + F.col("m"), F.col("hits") + F.col("_hb"), F.col("n"), F.col("hits"))
    return d.where(enough).withColumn("rate", rate).withColumn("base", base).withColumn(
        "lift", C.ratio(rate, base)).withColumn("odds_ratio", odds).withColumn("p", p).drop("_hb")


def hypergeometric_tail(population: Column, marked: Column, drawn: Column, seen: Column) -> Column:
    """P(X >= seen) when ``drawn`` of ``population`` are taken and ``marked`` carry the mark.

    The tail on the far side of the mode is summed, outwards from ``seen``: its terms fall faster than a normal
    density's, so twelve deviations hold all that a double can show. Below the mode the answer is one less that tail.
    """
    low, top = F.greatest(drawn + marked - population, F.lit(0)), F.least(marked, drawn)
    n, m, k = population.cast("double"), marked.cast("double"), drawn.cast("double")
    deviation = F.coalesce(F.try_divide(k * m * (n - m) * (n - k), n * n * (n - 1)), F.lit(0.0))
    width = (12 * F.sqrt(F.greatest(deviation, F.lit(0.0))) + 60).cast("long")
    mode = F.floor((k + 1) * (m + 1) / (n + 2))
    total = C.log_choose(population, drawn)
    above = lambda i: (marked - i) * ((drawn - i) / ((i + 1.0) * (population - marked - drawn + i + 1.0)))
    below = lambda i: i * ((population - marked - drawn + i) / ((marked - i + 1.0) * (drawn - i + 1.0)))

    def outwards(first: Column, last: Column, step: int, ratio) -> Column:
        """Sum of the terms from ``first`` to ``last`` as a share of the whole."""
        start = C.log_choose(marked, first) + C.log_choose(population - marked, drawn - first) - total
        sums = F.aggregate(F.sequence(first, last, F.lit(step).cast("long")), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
                           lambda acc, i: F.struct((acc["s"] + acc["t"]).alias("s"), (acc["t"] * ratio(i)).alias("t")), lambda acc: acc["s"])
        return F.exp(start) * sums

    seen = seen.cast("long")
    right = outwards(seen, F.least(top.cast("long"), seen + width), 1, above)
    left = outwards(seen - 1, F.greatest(low.cast("long"), seen - 1 - width), -1, below)
    return (F.when(seen > top, 0.0).when(seen <= low, 1.0)
            .when(seen > mode, F.least(right, F.lit(1.0))).otherwise(F.greatest(1 - left, F.lit(0.0))))


def signal_verdict(name: Column, lift: Column, p: Column, scored: Sequence[str]) -> Column:
    """Verdict from the stratified numbers only."""
    return (F.when(lift.isNull() & p.isNull(), "unmeasured")
            .when(name.isin(*scored), "scored")
            .when((lift >= 1.5) & (p < 0.1), "candidate")
            .when(lift < 1.0, "disproven").otherwise("context"))


def class_medians(df: DataFrame, value: Column, label: str, groups: Sequence[str] = (), **kw) -> DataFrame:
    """Median of a feature for either class, next to each other."""
    names = list(groups)
    m = O.medians(df, value, [*names, label], "m", **kw)
    pick = lambda v: F.max(F.when(F.col(label) == v, F.col("m")))
    return m.groupBy(*names).agg(pick(1).alias("median_pos"), pick(0).alias("median_neg"))


def lead_time(findings: DataFrame, penalties: DataFrame) -> DataFrame:
    """Sanctions before and after each observable date, without pairing them one by one.

    The sanctions of an id are first counted per day; a running window per id then gives
    every observable date its counts and next date. The line of an id is as long as its
    days, not its records. findings: id, obs, ...; penalties: id, date
    """
    days = penalties.groupBy("id", "date").agg(F.count(F.lit(1)).alias("c"))
    marks = findings.groupBy("id", "obs").agg(F.lit(0).cast("long").alias("c")).select(
        "id", F.date_sub("obs", 1).alias("date"), "c", "obs")
    line = days.select("id", "date", "c", F.lit(None).cast("date").alias("obs")).unionByName(marks).withColumn("_d", F.unix_date("date"))
    step = Window.partitionBy("id").orderBy("_d")
    upto, after = step.rangeBetween(Window.unboundedPreceding, 0), step.rangeBetween(1, Window.unboundedFollowing)
    line = line.withColumns({
        "n_prior": F.sum("c").over(upto), "n_after": F.coalesce(F.sum("c").over(after), F.lit(0)),
        "first_after": F.min(F.when(F.col("obs").isNull(), F.col("date"))).over(after)})
    at = line.where(F.col("obs").isNotNull()).select("id", "obs", "n_prior", "n_after", "first_after")
    return findings.join(at, ["id", "obs"]).withColumn("lead_days", F.datediff("first_after", "obs"))


def filter_institutions(df: DataFrame, name: str | None = None, town: str | None = None, kind: str | None = None,
                        has_penalty: bool | None = None, has_financials: bool | None = None,
                        sort: str = "rank", limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(page, matched): conjunctive filters, one of three orders, and the count before the limit.

    df: id, title, town, kind, rank_overall, prior, years_checked, capacity
    """
    d = df
    if name is not None:
        d = d.where(F.col("title").contains(name))
    if town is not None:
        d = d.where(F.col("town") == town)
    if kind is not None:
        d = d.where(F.col("kind") == kind)
    if has_penalty is not None:
        d = d.where((F.col("prior") > 0) == F.lit(has_penalty))
    if has_financials is not None:
        d = d.where((F.col("years_checked") > 0) == F.lit(has_financials))
    orders = {"rank": [F.col("rank_overall")], "penalties": [F.desc("prior"), F.col("rank_overall")],
              "capacity": [F.desc_nulls_last("capacity"), F.col("rank_overall")]}
    return d.orderBy(*orders[sort], "id").limit(limit), d.agg(F.count(F.lit(1)).alias("matched"))


def resolve_scope(points: DataFrame, scope: str, district: str | None = None, top_n: int = 50,
                  ids: DataFrame | None = None) -> DataFrame:
    """Institutions of a scan scope; ``proposal`` and ``picked`` take their ids as a table.

    points: id, town, rank_overall, failed_total, recent_partial
    """
    if scope == "district":
        return points.where(F.col("town") == district)
    if scope in ("proposal", "picked"):
        return points.join(ids.select("id"), "id", "left_semi")
    if scope == "compliance_fail":
        return points.where(F.col("failed_total") > 0)
    if scope == "evaluation":
        return points.where(F.col("recent_partial") == 1)
    if scope == "top_risk":
        return points.where(F.col("rank_overall") <= max(1, top_n))
    if scope == "city":
        return points
    raise ValueError(f"unknown scope {scope!r}")


def scope_counts(points: DataFrame, ids: DataFrame, district: str, top_n: int = 50) -> DataFrame:
    """(scope, n) of every scan scope, and of requested ids that no institution has, from one pass over the points.

    points: id, town, rank_overall, failed_total, recent_partial; ids: id
    """
    asked = ids.select(F.col("id").alias("_asked")).distinct()
    d = points.join(asked, F.col("id") == F.col("_asked"), "full_outer")
    there = F.col("id").isNotNull()
    scopes = {"district": F.col("town") == district, "top_risk": F.col("rank_overall") <= max(1, top_n), "compliance_fail": F.col("failed_total") > 0,
              "evaluation": F.col("recent_partial") == 1, "city": F.lit(True), "picked": F.col("_asked").isNotNull()}
    counts = d.agg(*[F.count_if(there & c).alias(name) for name, c in scopes.items()], F.count_if(~there).alias("unknown"))
    return counts.unpivot([], [*scopes, "unknown"], "scope", "n")


def unknown_ids(ids: DataFrame, points: DataFrame) -> DataFrame:
    """Requested ids that no institution has."""
    return ids.select("id").distinct().join(points.select("id"), "id", "left_anti")


def assemble_priority_list(scored: DataFrame, compliance: DataFrame, events: DataFrame, evaluations: DataFrame,
                           fee_ids: DataFrame, top_k: int = 100) -> DataFrame:
    """The review list: the score orders, findings and events escalate beside it.

    Missing evidence never lowers a rank: count columns are filled with 0, and the tier and
    sufficiency columns say what was there. scored: id, kind, score, ...; compliance,
    events and evaluations: one row per id; fee_ids: id.
    """
    d = (scored.join(compliance, "id", "left").join(events, "id", "left").join(evaluations, "id", "left")
         .join(fee_ids.select("id").distinct().withColumn("has_fees", F.lit(1)), "id", "left"))
    d = d.na.fill(0, ["years_checked", "failed_total", "failed_high", "events_90d", "events_365d", "has_fees", "recent_partial"])
    return review_reasons(priority_ranks(d, F.col("score"), F.col("id"), "kind"), top_k)


def top_k_against_base(df: DataFrame, rank: str, label: str, ks: Sequence[int]) -> DataFrame:
    """Hits of the first k rows against the base rate, with the hypergeometric tail."""
    at = quality_at(df, rank, label, ks)
    totals = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("pos"))).scalar()
    d = at.withColumn("_t", totals)
    return d.select("k", "hits", "lift", hypergeometric_tail(
        F.col("_t.n"), F.col("_t.pos"), F.least(F.col("k").cast("long"), F.col("_t.n")), F.col("hits").cast("long")).alias("p"))


def backtest_metrics(rankings: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per year of a walk-forward: size, positives, base rate, AUC, precision and lift at each k.

    A live year has no hits yet, so its figures are NULL, not zero.
    """
    base = F.avg("hit")
    agg = rankings.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_institutions"), F.sum("hit").alias("n_positive"), base.alias("base_rate"),
        F.first("label_complete").alias("label_complete"), F.first("observed_fraction").alias("observed_fraction"),
        *[F.avg(F.when(F.col("rank") <= k, F.col("hit"))).alias(f"precision_{k}") for k in ks])
    auc = rank_auc(rankings.where(F.col("hit").isNotNull()), F.col("score"), "hit", ["year"]).select("year", "auc")
    d = agg.join(auc, "year", "left")
    return d.withColumns({f"lift_{k}": C.ratio(F.col(f"precision_{k}"), F.col("base_rate")) for k in ks})
