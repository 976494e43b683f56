"""The fitted ranking, its baselines and its year-by-year back-test."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.operators import ordering as O
from tallyscope.operators import peers as P
from tallyscope.operators import ranking as K
from tallyscope.session import cut_lineage


def column_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact median of every feature; one row per feature comes back."""
    long = P.melt(df, [], features)
    return {r["feature"]: r["median"] for r in O.medians(long, F.col("value"), ["feature"]).collect()}


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(v)) for f, v in values.items()})


def fit_ranking(train: DataFrame, label: str, features: Sequence[str], strength: float = 1.0,
                balanced: bool = False, kind: str = "logistic") -> Callable[[DataFrame], DataFrame]:
    """Median fill, scaling and a classifier; returns a scorer that adds ``score``.

    The penalty 1/(C·n) makes the mean-loss objective equal to the summed one; the factor (n - 1)/n makes it that of
    features scaled by the population's deviation, as the scaler divides by the sample's.
    """
    medians = column_medians(train, features)
    d = fill(train, medians)
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).first()
    n, pos = stats["n"], stats["p"] or 0
    weight = None
    if balanced and 0 < pos < n:
        d = d.withColumn("_weight", F.when(F.col(label) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))
        weight = "_weight"
    assembler = VectorAssembler(inputCols=list(features), outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True)
    if kind == "logistic":
        model = LogisticRegression(featuresCol="_features", labelCol=label, regParam=1.0 / (strength * n) * max(n - 1, 1) / n, elasticNetParam=0.0,
                                   standardization=False, maxIter=1000, **({"weightCol": weight} if weight else {}))
    else:
        model = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=20, maxDepth=3, seed=7,
                              **({"weightCol": weight} if weight else {}))
    fitted = Pipeline(stages=[assembler, scaler, model]).fit(d.withColumn(label, F.col(label).cast("double")))

    def score(frame: DataFrame) -> DataFrame:
        out = fitted.transform(fill(frame, medians))
        return out.withColumn("score", vector_to_array("probability")[1]).select(*frame.columns, "score")

    return score


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mean over positives of the precision at their score, ties taken together."""
    every = O.tie_counts(df.select((-F.col(score)).alias("s"), F.col(label).alias("y")), F.col("s"), (), "_b", "_n", "_all_rows")
    hits = O.tie_counts(every.where("y = 1").select("s", "_n"), F.col("s"), (), "_b", "_p", "_all_rows")
    return hits.agg(F.avg(F.col("_p") / F.col("_n")).alias("average_precision"))


def ranking_metrics(scored: DataFrame, label: str, tie: Column, ks: Sequence[int]) -> DataFrame:
    """AUC, average precision, and precision / recall / lift at each k."""
    d = cut_lineage(scored)
    ranked = O.row_number(d, F.col("score"), tie, (), "rank", descending=True)
    at = K.quality_at(ranked, "rank", label, ks)
    auc = K.rank_auc(d, F.col("score"), label).select("auc").scalar()
    ap = average_precision(d, "score", label).scalar()
    return at.withColumn("auc", auc).withColumn("average_precision", ap)


def backtest_point(train: DataFrame, test: DataFrame, label: str, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Fit on one snapshot, score another; only features present in both are used."""
    train, test = cut_lineage(train), cut_lineage(test)
    used = K.usable_columns(features, train, test)
    return fit_ranking(train, label, used)(test), used


def walk_forward(frame_at: Callable[[int], DataFrame], label_of: Callable[[DataFrame, int, int], DataFrame],
                 years: Sequence[int], features: Sequence[str], lag: int, data_end: str, label_years: int,
                 scorer: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rankings of every year, each trained ``lag`` years earlier on its own labels, or scored by ``scorer`` (train, test).

    The loop over years stays on the driver and is as short as the list; each year is a
    set of jobs over whole tables. A year whose label window reaches past the data is
    marked as incomplete; a year that starts after it has NULL hits.
    """
    out = None
    for year in years:
        train = label_of(frame_at(year - lag), year - lag, year)
        test = label_of(frame_at(year), year, year + label_years)
        scored = scorer(train, test) if scorer else backtest_point(train, test, "label", features)[0]
        start, end = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year + label_years}-01-01").cast("date")
        seen = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.datediff(F.lit(data_end).cast("date"), start) / F.datediff(end, start)))
        ranked = O.row_number(cut_lineage(scored.select("id", "score", "label", "n_penalties_prior")), F.col("score"), F.col("id"), (), "rank", descending=True)
        point = ranked.select(
            F.lit(year).alias("year"), F.lit(year - lag).alias("train_year"), "id", "rank", F.round("score", 4).alias("score"),
            F.when(seen > 0, F.col("label")).alias("hit"), F.col("n_penalties_prior").alias("prior"),
            (seen >= 0.999).alias("label_complete"), F.round(seen, 3).alias("observed_fraction"))
        out = point if out is None else out.unionByName(point)
    return out


def group_folds(df: DataFrame, group: str, label: str, features: Sequence[str], k: int, strength: float) -> DataFrame:
    """Out-of-fold scores with whole groups held out."""
    d = cut_lineage(df.withColumn("_fold", F.pmod(F.xxhash64(group), F.lit(k))))
    out = None
    for fold in range(k):
        rest = d.where(F.col("_fold") != fold)
        if rest.agg(F.count_distinct(label)).first()[0] < 2:
            continue
        part = fit_ranking(rest, label, features, strength, balanced=True)(d.where(F.col("_fold") == fold))
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


def poisson_weight(*keys: Column) -> Column:
    """Poisson(1) draw that depends on the keys only, by inverting the distribution at 53 random bits.

    Draws end at 19, beyond which less than one in 2^53 is left.
    """
    u = (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)
    total, term, weight = 0.0, 0.36787944117144233, F.lit(0)
    for i in range(19):
        total += term
        weight = weight + F.when(u > total, 1).otherwise(0)
        term /= i + 1
    return weight


def cluster_bootstrap_auc(df: DataFrame, group: str, score: str, label: str, replicates: int) -> DataFrame:
    """AUC per replicate with Poisson weights drawn per group; rows are counted per group and score before they are copied."""
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    counted = df.groupBy(group, F.col(score).alias("s"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("_c"))
    d = counted.select(group, "s", "y", "_c", reps)
    d = d.withColumn("w", poisson_weight(F.col(group), F.col("replicate")) * F.col("_c")).where("w > 0")
    d = d.groupBy("replicate", "s").agg(F.sum(F.when(F.col("y") == 1, F.col("w"))).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("w"))).alias("q"))
    d = d.na.fill(0, ["p", "q"])
    d = O.tie_counts(d, F.col("s"), ["replicate"], "b", "u", "total", weight=F.col("q"))
    g = d.groupBy("replicate").agg(F.sum(F.col("p") * (F.col("b") + F.col("u")) / 2).alias("_a"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    return g.where("_p > 0 and _q > 0").select("replicate", (F.col("_a") / (F.col("_p") * F.col("_q"))).alias("auc"))


def percentile_interval(values: DataFrame, column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Linear-interpolation percentiles of one short table of replicates."""
    return values.agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_p")).select(
        F.get("_p", F.lit(0)).alias("low"), F.get("_p", F.lit(1)).alias("high"))


def keyed_position(number: Column, key: Column, n: int, rounds: int = 4, walk: int = 64) -> Column:
    """Position of ``number`` in the ``key``-th pseudorandom permutation of 0 .. n-1, without making the others.

    A balanced network over pairs of digits below ceil(sqrt(n)) permutes their a * a pairs; a result of n or more is
    permuted again until it is below n, which few need. Whole-number arithmetic below 2^62 only.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    prime = 2147483647

    def mix(right: Column, i: Column) -> Column:
        x = F.aggregate(F.array((right * 7919 + key.cast("long") * 104729 + i * 1299709 + 12345) % prime), F.lit(0).cast("long"), lambda _, v: v * v % prime)
        return x * 48271 % prime

    def once(value: Column) -> Column:
        start = F.struct(F.floor(value / a).cast("long").alias("l"), (value % a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")), start,
                           lambda s, i: F.struct(s["r"].alias("l"), ((s["l"] + mix(s["r"], i)) % a).alias("r")), lambda s: s["l"] * a + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), number.cast("long"), lambda v, i: F.when((i == 1) | (v >= n), once(v)).otherwise(v))


def cluster_permutation(ranked: DataFrame, group: str, label: str, k: int, permutations: int) -> DataFrame:
    """Share of group-label permutations that put at least as many hits in the first k rows.

    Labels are shuffled between groups, not rows. Groups are numbered once, in their order; a group of the first k rows
    is marked in a permutation when its position in it is below the number of marked groups. Only those groups are
    copied per permutation, k at most, and none are sorted, so the result does not depend on partitions.
    """
    groups = ranked.groupBy(group).agg(F.max(label).alias("_y"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("_top"))
    groups = cut_lineage(O.row_number(groups, F.col(group), F.col(group), (), "_number"))
    n, marked, hit = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0)), F.coalesce(F.sum(F.col("_top") * F.col("_y")), F.lit(0))).first()
    d = groups.where("_top > 0").select("_number", "_top", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("p"))
    d = d.withColumn("_pos", keyed_position(F.col("_number") - 1, F.col("p"), n))
    seen = d.groupBy("p").agg(F.sum(F.when(F.col("_pos") < marked, F.col("_top")).otherwise(0)).alias("h"))
    return seen.agg(F.lit(hit).cast("long").alias("hits"), F.avg((F.col("h") >= hit).cast("int")).alias("p_value"))
