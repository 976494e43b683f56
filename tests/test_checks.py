import pytest
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.operators import checks as K


def one(spark, expr, **cols):
    names = ", ".join(f"{k} double" for k in cols)
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in cols.values())], names).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("pa,pl,ca,cl,want", [
    (0, 1_200_000, 1_200_000, 3_400_000, ("one_year_lag", True)),
    (1_000_000, 2_000_000, 1_000_000, 2_000_000, ("stable", False)),
    (1_000_000, 2_000_000, 1_500_000, 4_000_000, ("widened", False)),
    (0, 2_000_000, 3_000_000, 3_500_000, ("narrowed", False)),
    (5, 5, 7, 7, (None, None)),
    (None, 5000, 0, 9000, (None, None)),
])
def test_reserve_gap(spark, pa, pl, ca, cl, want):
    v, lag = K.classify_gap(F.col("pa"), F.col("pl"), F.col("ca"), F.col("cl"))
    got = one(spark, F.struct(v.alias("v"), lag.alias("l")), pa=pa, pl=pl, ca=ca, cl=cl)
    assert (got["v"], got["l"]) == want


@pytest.mark.parametrize("a,b,opening,want", [
    (None, None, False, None), (None, 5.0, True, None), (None, 5.0, False, False), (5.0, 5.9, False, True), (5.0, 9.0, False, False)])
def test_matched_sides_three_states(spark, a, b, opening, want):
    assert one(spark, K.matched_sides(F.col("a"), F.col("b"), F.lit(opening)), a=a, b=b) is want


def test_unknown_is_never_pass(spark):
    d = spark.createDataFrame([(1, None, None)], "code int, severance_asset double, severance_liability double")
    for c in ("reserve_asset", "reserve_liability", "transfer", "revenue", "surplus", "personnel_budget", "personnel_actual",
              "total_budget", "total_actual", "disclosed", "payable"):
        d = d.withColumn(c, F.lit(None).cast("double"))
    d = d.withColumns({"opening": F.lit(False), "n_net_labels": F.lit(0), "n_equal_pairs": F.lit(1)})
    got = {r["rule"]: r["passed"] for r in K.run_rules(d, ["code"], K.policy_rules()).collect()}
    assert len(got) == 7 and all(v is None for v in got.values())


def test_transfer_cap_margin(spark):
    for transfer, want in ((19.0, True), (21.5, None), (23.0, False), (20.5, True)):
        rule = [r for r in K.policy_rules() if r.name == "transfer_cap"][0]
        assert one(spark, rule.passed, transfer=transfer, revenue=100.0) is want


def test_related_party_materiality(spark):
    rule = [r for r in K.policy_rules() if r.name == "related_party_payable"][0]
    for disclosed, payable, want in ((1000.0, 1099.0, True), (1000.0, 1101.0, False), (None, 5.0, None)):
        assert one(spark, rule.passed, disclosed=disclosed, payable=payable) is want


def test_half_year_basis_zero_is_missing(spark):
    for a, b, want in ((0, 7675, 15350), (7675, 7675, 15350), (None, None, None), (100, 0, 200)):
        assert one(spark, K.half_year_basis(F.col("a"), F.col("b")), a=a, b=b) == want


def test_decided_checks_are_not_reopened(spark):
    checks = spark.createDataFrame([(1, True), (2, None), (3, None)], "code int, passed boolean")
    ev = spark.createDataFrame([(1, None, "partial", False), (2, True, "gross_documented", True), (3, None, "single", False)],
                               "code int, passed boolean, state string, changed boolean")
    got = {r["code"]: (r["passed"], r["resolved"]) for r in K.apply_evidence(checks, ev, ["code"]).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (None, False)}


def test_periods(spark):
    d = spark.createDataFrame([("108年8月1日至112年7月31日（109年2月1日開園）", 112), ("111年2月1日至113年7月31日", 110), ("自110年8月起", 110)], "p string, y int")
    got = d.select(C.covers_school_year(F.col("p"), F.col("y")).alias("c"), C.opens_in_school_year(F.col("p"), F.col("y")).alias("o"),
                   C.months_covered(F.col("p")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(False, False, None), (True, True, None), (None, True, None)]
    got = spark.createDataFrame([("110.08.01-111.07.31",), ("110年8月1日至111年7月31日",)], "p string").select(C.months_covered(F.col("p")).alias("m")).collect()
    assert [r["m"] for r in got] == [12, 12]


def test_safe_ratio_and_execution(spark):
    assert one(spark, C.ratio(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, C.execution_rate(F.col("a"), F.col("b")), a=None, b=4) == 0.0
    assert one(spark, C.execution_rate(F.col("a"), F.col("b")), a=3, b=None) is None


def test_decile_edges(spark):
    d = spark.range(1, 1214).select(C.decile_of_rank(F.col("id"), F.lit(1213)).alias("d")).groupBy("d").count().collect()
    got = {r["d"]: r["count"] for r in d}
    assert got[1] == 122 and got[10] == 122 and sum(got.values()) == 1213 and set(got) == set(range(1, 11))


def test_log_choose(spark):
    import math
    got = one(spark, C.log_choose(F.col("n"), F.col("k")), n=5000, k=37)
    assert got == pytest.approx(math.lgamma(5001) - math.lgamma(38) - math.lgamma(4964), rel=1e-10)
    assert one(spark, C.log_choose(F.col("n"), F.col("k")), n=5, k=0) == 0.0


def test_log_factorial_against_lgamma(spark):
    import math
    values = [0, 1, 2, 3, 10, 19, 20, 21, 22, 50, 171, 1000, 10**6, 10**9]
    got = spark.createDataFrame([(v,) for v in values], "n long").select("n", C.log_factorial(F.col("n")).alias("x")).collect()
    for r in got:
        want = math.lgamma(r.n + 1)
        assert r.x == 0.0 if r.n <= 1 else abs(r.x - want) <= 1e-12 * want


def test_equal_amounts_without_labels_are_the_same_pairs(spark):
    """Positions decide where labels are missing; marks of fixed size are aggregated by hash."""
    rows = [(1, 5.0, "A", "r", 1), (1, 5.0, "B", "e", 2), (1, 6.0, "A", "r", 1), (2, 7.0, None, "r", 1), (2, 7.0, "A", "r", 2), (2, 7.0, "B", "e", 3),
            (3, 7.0, "A", "r", 1), (3, 7.0, None, "r", 2), (3, 7.0, "B", "e", 3), (4, 0.0, "A", "r", 1), (4, 0.0, "B", "e", 2), (5, None, "A", "r", 1),
            (None, 8.0, "A", "r", 1), (None, 8.0, "B", "e", 1), (None, 9.0, None, "e", 2), (None, 9.0, "A", "r", 3), (None, 9.0, "B", "e", 4), (1, 5.0, "A", "r", 1)]
    d = spark.createDataFrame(rows, "code long, amount double, label string, s string, pos int")
    side = F.when(F.col("s") == "e", "expense").otherwise("revenue")
    for some in (d, d.where("label is not null")):
        want = K.equal_amount_pairs(some, "code", side, "amount", "label", F.struct("pos")).select("code", "amount")
        got = K.equal_amount_pairs(some, "code", side, "amount", "label", F.struct("pos"), labels=False)
        assert got.columns == ["code", "amount"] and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_numbered_rules_quote_the_same_finding(spark):
    rows = [(c, 1990 + c % 3, r, p, s) for c in range(12) for r, p, s in (
        ("b", [True, False, None][c % 3], "high"), ("a", c % 2 == 0, "medium"), ("ä", c % 4 == 0, "medium"), ("B", c % 5 == 0, None), ("c", c % 7 != 1, "low"))] + [(3, None, "a", False, "high")]
    checks = spark.createDataFrame(rows, "code long, year int, rule string, passed boolean, severity string")
    targets = checks.select("code", "year", (F.col("code") % 4).alias("id"), (F.col("code") % 3 != 0).alias("matched")).distinct()
    want = K.compliance_summary(checks, targets)
    got = K.compliance_summary(checks, targets, rules=["c", "b", "a", "ä", "B"])
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
