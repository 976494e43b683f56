import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import models as M
from tallyscope.operators import ranking as K


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    rows = [(i, f"g{i % 40}", round(rng.random(), 1), int(rng.random() < 0.3)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, g string, score double, label int"), rows


def test_auc_and_average_precision(scored):
    df, rows = scored
    s, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    ap = np.mean([y[s >= p].mean() for p in pos])
    assert K.rank_auc(df, F.col("score"), "label").first()["auc"] == pytest.approx(auc)
    assert M.average_precision(df, "score", "label").first()[0] == pytest.approx(ap)


def test_auc_without_both_classes_is_null(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "score double, label int")
    assert K.rank_auc(df, F.col("score"), "label").first()["auc"] is None


def test_fisher_tail(spark):
    df = spark.createDataFrame([(1, 1)] * 8 + [(1, 0)] * 25 + [(0, 1)] * 12 + [(0, 0)] * 87, "flag int, label int")
    p = sum(math.comb(20, k) * math.comb(112, 33 - k) for k in range(8, 21)) / math.comb(132, 33)
    got = K.two_by_two(df, "flag", "label").first()
    assert got["p"] == pytest.approx(p, rel=1e-9) and got["lift"] == pytest.approx((8 / 33) / (12 / 99))


def test_hypergeometric_tail_at_any_size(spark):
    cases = [(4000, 2000, 2000, 100), (100000, 50000, 20000, 5000), (50, 20, 10, 0), (50, 20, 10, 10), (50, 20, 10, 11), (50, 45, 10, 5), (50, 45, 10, 6), (1, 1, 1, 1), (500, 100, 100, 19),
             (500, 100, 100, 20), (500, 100, 100, 21), (500, 100, 100, 95), (10**6, 400000, 300000, 120000), (10**6, 400000, 300000, 121000), (2 * 10**6, 10**6, 5 * 10**5, 2 * 10**5)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, m long, k long, s long")
    got = [r.p for r in rows.withColumn("p", K.hypergeometric_tail(*[F.col(c) for c in "nmks"])).orderBy("i").collect()]
    for c, p in zip(cases, got):
        if c[0] <= 4000:
            n, m, k, s = c
            want = sum(math.comb(m, j) * math.comb(n - m, k - j) for j in range(max(s, 0), min(m, k) + 1) if k - j <= n - m) / math.comb(n, k)
            assert p == pytest.approx(want, rel=1e-8, abs=1e-305), c
    assert got[0] == 1.0 and got[1] == 1.0 and got[-1] == 1.0
    assert 0 < got[11] < 1e-60
    assert got[12] == pytest.approx(0.5, abs=2e-3) and 0 < got[13] < 1e-4


def test_small_arm_gives_nothing(spark):
    df = spark.createDataFrame([(1, 1)] * 4 + [(0, 0)] * 50, "flag int, label int")
    assert K.two_by_two(df, "flag", "label").count() == 0


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) * [1, 5] + [0, 3]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, label int")
    got = M.fit_ranking(df, "label", ["a", "b"])(df).orderBy("id").toPandas()["score"].to_numpy()
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(300)]
    w, reg = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + reg, z.T @ (p - y) + reg @ w)
    assert np.abs(got - 1 / (1 + np.exp(-z @ w))).max() < 1e-4


def test_poisson_weights(spark):
    w = spark.range(20000).select(M.poisson_weight(F.col("id")).alias("w")).agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert abs(w["m"] - 1) < 0.03 and abs(w["v"] - 1) < 0.05


def test_bootstrap_interval_holds_the_estimate(scored):
    df, _ = scored
    ci = M.percentile_interval(M.cluster_bootstrap_auc(df, "g", "score", "label", 60), "auc").first()
    auc = K.rank_auc(df, F.col("score"), "label").first()["auc"]
    assert ci["low"] <= auc <= ci["high"]


def test_walk_forward_protocol(spark, small):
    from tallyscope.plans.catalogue import PLANS
    d = PLANS["walk_forward_ranking"](spark, small).toPandas()
    assert (d["train_year"] < d["year"]).all()
    assert d[d.year == 1999]["label_complete"].all() and not d[d.year == 2001]["label_complete"].any()
    m = K.backtest_metrics(spark.createDataFrame(d), [10]).toPandas().set_index("year")
    for year, g in d.groupby("year"):
        assert m.loc[year, "precision_10"] == pytest.approx(g[g["rank"] <= 10]["hit"].mean())
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))


def test_live_point_has_no_hits(spark, small):
    from tallyscope.plans.models import frame_at, labelled
    from tallyscope.plans.registry import Tables
    t = Tables(spark, small)
    d = M.walk_forward(lambda y: frame_at(t, min(y, 2001)), lambda f, a, b: labelled(t, f, min(a, 1999), min(b, 2001)), [2002],
                       ["n_penalties_prior", "capacity"], 2, "2001-08-01", 2)
    assert d.where("hit is not null").count() == 0


def test_normal_tail_and_large_fisher(spark):
    from tallyscope.functions import columns as C
    zs = [-2.5, 0.0, 0.7, 3.1]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(C.normal_tail(F.col("z")).alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in zs], abs=1e-7)
    big = spark.createDataFrame([(10_000_000, 3_000_000, 2_000_000, 601_000)], "n long, m long, k long, x long")
    p = big.select(K.hypergeometric_tail(F.col("n"), F.col("m"), F.col("k"), F.col("x")).alias("p")).first()["p"]
    n, m, k, x = 10_000_000, 3_000_000, 2_000_000, 601_000
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    want, term = 0.0, math.exp(choose(m, x) + choose(n - m, k - x) - choose(n, k))
    while term > 1e-30:
        want += term
        term *= (m - x) * (k - x) / ((x + 1) * (n - m - k + x + 1))
        x += 1
    assert p == pytest.approx(want, rel=1e-6)


def placed(number, key, n):
    """The keyed permutation, step by step."""
    a, v, prime = max(1, math.isqrt(max(n - 1, 0)) + 1), number, 2147483647
    for step in range(64):
        if step and v < n:
            break
        left, right = divmod(v, a)
        for i in range(4):
            x = (right * 7919 + key * 104729 + i * 1299709 + 12345) % prime
            left, right = right, (left + x * x % prime * 48271 % prime) % a
        v = left * a + right
    return v


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 1000])
def test_keyed_positions_are_permutations(spark, n):
    d = spark.range(n).select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(77))).alias("k"))
    got = {(r.id, r.k): r.v for r in d.withColumn("v", M.keyed_position(F.col("id"), F.col("k"), n)).collect()}
    assert got == {(i, k): placed(i, k, n) for i in range(n) for k in (1, 2, 77)}
    for k in (1, 2, 77):
        assert sorted(v for (_, q), v in got.items() if q == k) == list(range(n))


def test_cluster_permutation_against_its_distribution(spark):
    """With one group per row the count of hits is hypergeometric."""
    rows = [(f"g{i:03}", i + 1, int(i % 5 == 0 or i < 4)) for i in range(60)]
    got = M.cluster_permutation(spark.createDataFrame(rows, "g string, rank int, label int"), "g", "label", 10, 3000).first()
    m, hit = sum(r[2] for r in rows), sum(r[2] for r in rows[:10])
    tail = sum(math.comb(m, h) * math.comb(60 - m, 10 - h) for h in range(hit, 11)) / math.comb(60, 10)
    assert got.hits == hit and got.p_value == pytest.approx(tail, abs=0.03)
    spread = spark.createDataFrame(rows, "g string, rank int, label int").repartition(7)
    assert M.cluster_permutation(spread, "g", "label", 10, 3000).first() == got
