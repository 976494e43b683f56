"""Rule check queries. A report is an order; its statement lines are its line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed
from tallyscope.operators import checks as K
from tallyscope.operators import peers as P
from tallyscope.plans import roles as R
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import scales_sql, with_

PAIRS = """pairs AS (SELECT code, amount, arg_min(CASE WHEN side = 'revenue' THEN label END, CASE WHEN side = 'revenue' THEN pos END) AS revenue_label,
    arg_min(CASE WHEN side = 'expense' THEN label END, CASE WHEN side = 'expense' THEN pos END) AS expense_label
    FROM (SELECT l_orderkey AS code, l_quantity AS amount, CASE WHEN l_returnflag = 'N' THEN 'expense' ELSE 'revenue' END AS side,
    l_returnflag || l_linestatus AS label, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem)
    GROUP BY code, amount HAVING count(*) FILTER (side = 'revenue') > 0 AND count(*) FILTER (side = 'expense') > 0)"""


def lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("code"), F.col("l_quantity").alias("amount"),
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.when(F.col("l_returnflag") == "N", "expense").otherwise("revenue").alias("side"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"))


@plan("R2", with_(more=PAIRS) + "SELECT * FROM pairs")
def equal_amount_pairs(t: Tables) -> DataFrame:
    return K.equal_amount_pairs(lines(t), "code", F.col("side"), "amount", "label", F.col("pos"))


STATEMENT = """st AS (SELECT o_orderkey AS code, year(o_orderdate) AS year, month(o_orderdate) <= 3 AS opening, a.*, o_totalprice AS revenue,
    a.total_actual - o_totalprice AS surplus, (SELECT count(*) FROM pairs WHERE pairs.code = o_orderkey) AS n_equal_pairs
    FROM orders JOIN (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS severance_asset,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS severance_liability,
    sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS reserve_asset, sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber END) AS reserve_liability,
    sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice * l_tax END) AS transfer,
    sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS personnel_budget,
    sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * (1 - l_discount) END) AS personnel_actual,
    sum(l_extendedprice) AS total_budget, sum(l_extendedprice * (1 - l_discount)) AS total_actual,
    max(l_quantity) AS disclosed, CASE WHEN count(*) > 1 THEN min(l_quantity) END AS payable FROM lineitem GROUP BY l_orderkey) a ON l_orderkey = o_orderkey)"""
POLICY = """ck AS (SELECT code, year, u.* FROM st, LATERAL (
    SELECT 'severance_asset_equals_liability' AS rule, CASE WHEN severance_asset IS NULL AND severance_liability IS NULL THEN NULL
      WHEN (severance_asset IS NULL OR severance_liability IS NULL) AND opening THEN NULL
      WHEN severance_asset IS NULL OR severance_liability IS NULL THEN false ELSE abs(severance_liability - severance_asset) <= 1 END AS passed,
      'medium' AS severity, CAST(severance_liability - severance_asset AS DOUBLE) AS evidence UNION ALL
    SELECT 'reserve_asset_equals_liability', CASE WHEN reserve_asset IS NULL AND reserve_liability IS NULL THEN NULL
      WHEN (reserve_asset IS NULL OR reserve_liability IS NULL) AND opening THEN NULL
      WHEN reserve_asset IS NULL OR reserve_liability IS NULL THEN false ELSE abs(reserve_liability - reserve_asset) <= 1 END,
      CASE WHEN (reserve_asset IS NULL OR reserve_liability IS NULL) AND (opening OR (reserve_asset IS NULL AND reserve_liability IS NULL)) THEN 'medium' ELSE 'high' END,
      reserve_liability - reserve_asset UNION ALL
    SELECT 'no_transfer_in_loss_year', CASE WHEN transfer IS NULL OR surplus IS NULL THEN NULL WHEN transfer <= 0 OR surplus >= 0 THEN true
      WHEN surplus + transfer >= 0 THEN NULL ELSE false END, 'high', surplus + transfer UNION ALL
    SELECT 'transfer_cap', CASE WHEN transfer IS NULL OR revenue IS NULL OR revenue = 0 THEN NULL WHEN transfer <= revenue * 0.2 + 1 THEN true
      WHEN transfer / revenue <= 0.22 THEN NULL ELSE false END, 'high', transfer / nullif(revenue, 0) UNION ALL
    SELECT 'no_personnel_outflow', CASE WHEN personnel_actual >= personnel_budget - 1 THEN true END, 'high', personnel_budget - personnel_actual UNION ALL
    SELECT 'related_party_payable', CASE WHEN disclosed IS NOT NULL AND payable IS NOT NULL THEN abs(payable - disclosed) <= greatest(1, abs(disclosed) * 0.1) END,
      'medium', payable - disclosed UNION ALL
    SELECT 'gross_recording', CASE WHEN n_equal_pairs > 0 THEN NULL ELSE true END, 'medium', n_equal_pairs) u)"""


def statements(t: Tables) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    of = lambda cond, x: F.sum(F.when(cond, x))
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("code")).agg(
        of(flag == "A", F.col("l_quantity")).alias("severance_asset"), of(flag == "R", F.col("l_quantity")).alias("severance_liability"),
        of(status == "F", F.col("l_linenumber")).alias("reserve_asset"), of(status == "O", F.col("l_linenumber")).alias("reserve_liability"),
        of(flag == "N", price * F.col("l_tax")).alias("transfer"),
        of(flag == "A", price).alias("personnel_budget"), of(flag == "A", price * (1 - disc)).alias("personnel_actual"),
        F.sum(price).alias("total_budget"), F.sum(price * (1 - disc)).alias("total_actual"),
        F.max("l_quantity").alias("disclosed"), F.when(F.count(F.lit(1)) > 1, F.min("l_quantity")).alias("payable"))
    pairs = K.equal_amount_pairs(lines(t), "code", F.col("side"), "amount", "label", F.col("pos"), labels=False).groupBy("code").agg(
        F.count(F.lit(1)).alias("n_equal_pairs"))
    o = t.orders.select(F.col("o_orderkey").alias("code"), F.year("o_orderdate").alias("year"),
                        (F.month("o_orderdate") <= 3).alias("opening"), F.col("o_totalprice").alias("revenue"))
    return (o.join(a, "code").join(pairs, "code", "left").withColumn("surplus", F.col("total_actual") - F.col("revenue"))
            .withColumn("n_equal_pairs", F.coalesce("n_equal_pairs", F.lit(0))).withColumn("n_net_labels", F.lit(0)))


def policy_checks(t: Tables) -> DataFrame:
    return K.run_rules(statements(t), ["code", "year"], K.policy_rules())


@plan("R1 R3", with_(more=",\n".join([PAIRS, STATEMENT, POLICY])) + "SELECT code, rule, passed, severity, round(evidence, 4) AS evidence FROM ck")
def policy_checks_long(t: Tables) -> DataFrame:
    return policy_checks(t).select("code", "rule", "passed", "severity", F.round("evidence", 4).alias("evidence"))


@plan("A31", with_(more=",\n".join([PAIRS, STATEMENT, POLICY])) + """SELECT rule, count(*) FILTER (passed) AS n_pass, count(*) FILTER (NOT passed) AS n_fail,
    count(*) FILTER (passed IS NULL) AS n_insufficient FROM ck GROUP BY rule""")
def rule_tally(t: Tables) -> DataFrame:
    return K.rule_tally(policy_checks(t))


@plan("A12", with_(more=",\n".join([PAIRS, STATEMENT, POLICY]) + """, tg AS (SELECT o_orderkey AS code, o_custkey AS id FROM orders UNION ALL SELECT o_orderkey, -1 - o_custkey FROM orders WHERE o_orderstatus = 'P')""") + """SELECT tg.id, count(DISTINCT year) AS years_checked, max(year) AS latest_year,
    count(*) FILTER (passed = false) AS failed_total, count(*) FILTER (passed = false AND severity = 'high') AS failed_high,
    arg_max(year || ' ' || rule, (year, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, tg.code, rule)) FILTER (passed = false) AS top_finding
    FROM ck JOIN tg ON tg.code = ck.code GROUP BY tg.id""")
def compliance_summary(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("code"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("id"), (F.col("o_orderstatus") != "P").alias("matched"))
    targets = o.unionByName(o.select("code", "year", (-1 - F.col("id")).alias("id"), F.lit(False).alias("matched")))
    return K.compliance_summary(policy_checks(t), targets, rules=[r.name for r in K.policy_rules()]).withColumn("latest_year", F.col("latest_year").cast("long"))


@plan("W9", with_("panel", more="""g AS (SELECT entity, year, open_qty * 100 AS asset, CASE WHEN n_lines > 90 THEN NULL ELSE qty * 50 END AS liability FROM panel),
    p AS (SELECT a.entity, a.year, b.asset AS pa, b.liability AS pl, a.asset AS ca, a.liability AS cl FROM g a JOIN g b ON a.entity = b.entity AND b.year + 1 = a.year)""")
      + """SELECT entity, year, CASE WHEN (cl - ca) - (pl - pa) < -1000 THEN 'narrowed' WHEN pl <> 0 AND abs(ca - pl) <= 0.05 * abs(pl) THEN 'one_year_lag'
    WHEN abs((cl - ca) - (pl - pa)) <= 1000 THEN 'stable' ELSE 'widened' END AS verdict, pl <> 0 AND abs(ca - pl) <= 0.05 * abs(pl) AS lag_match,
    round(pl - pa, 2) AS prev_gap, round(cl - ca, 2) AS gap FROM p WHERE pa + pl + ca + cl IS NOT NULL AND NOT (abs(pl - pa) <= 1000 AND abs(cl - ca) <= 1000)""")
def gap_classification(t: Tables) -> DataFrame:
    return reserve_gaps(t)


def reserve_gaps(t: Tables) -> DataFrame:
    g = R.panel(t).select("entity", "year", (F.col("open_qty") * 100).alias("asset"),
                          F.when(F.col("n_lines") <= 90, F.col("qty") * 50).alias("liability"))
    d = K.consecutive_years(g, "entity", "year", ["asset", "liability"])
    verdict, lag = K.classify_gap(F.col("prev_asset"), F.col("prev_liability"), F.col("asset"), F.col("liability"))
    return d.select("entity", "year", verdict.alias("verdict"), lag.alias("lag_match"),
                    F.round(F.col("prev_liability") - F.col("prev_asset"), 2).alias("prev_gap"),
                    F.round(F.col("liability") - F.col("asset"), 2).alias("gap")).where(F.col("verdict").isNotNull())


@plan("J21", with_("panel", more="""g AS (SELECT entity, year, open_qty * 100 AS asset, qty * 50 AS liability FROM panel),
    p AS (SELECT a.entity, a.year, b.liability - b.asset AS pg, a.liability - a.asset AS gap FROM g a JOIN g b ON a.entity = b.entity AND b.year + 1 = a.year)""")
      + """SELECT f.entity, f.year, p.year AS cured_in FROM (SELECT entity, year FROM g WHERE abs(liability - asset) > 1) f
    LEFT JOIN (SELECT * FROM p WHERE gap - pg < -1000 AND abs(gap) <= 1000 AND NOT (abs(pg) <= 1000)) p ON p.entity = f.entity AND p.year = f.year + 1""")
def cure_annotation(t: Tables) -> DataFrame:
    g = R.panel(t).select("entity", "year", (F.col("open_qty") * 100).alias("asset"), (F.col("qty") * 50).alias("liability"))
    failed = g.where(F.abs(F.col("liability") - F.col("asset")) > fixed.MONEY_TOL).select("entity", "year")
    d = K.consecutive_years(g, "entity", "year", ["asset", "liability"])
    verdict, _ = K.classify_gap(F.col("prev_asset"), F.col("prev_liability"), F.col("asset"), F.col("liability"))
    cured = d.where((verdict == "narrowed") & (F.abs(F.col("liability") - F.col("asset")) <= fixed.GAP_TOL)).select(
        "entity", (F.col("year") - 1).alias("year"), F.col("year").alias("cured_in"))
    return failed.join(cured, ["entity", "year"], "left")


REPORT = """rp AS (SELECT entity, year, gross AS tuition_income, CASE WHEN n_lines >= 100 THEN NULL ELSE qty END AS actual_enrolment,
    n_lines * 25.0 AS approved_capacity, n_lines * 2.0 AS educators, levy AS material_cost, n_lines * 25.0 + open_qty / 20 - 60 AS registry_capacity_max,
    qty * 3 AS registry_indoor_area, CASE WHEN year < 1998 THEN gross / qty * (0.9 + n_lines / 500.0) END AS filed_fee_per_child,
    rebate AS parent_fee, CASE WHEN n_lines <= 72 THEN NULL ELSE net END AS gov_subsidy, CASE WHEN year = 2001 THEN 11 ELSE 12 END AS period_months,
    rebate / qty / 12 * 1.02 * (n_lines / 86.0) AS registry_monthly FROM panel),
    m AS (SELECT *, tuition_income / nullif(actual_enrolment, 0) AS implied_fee_per_child, tuition_income / nullif(actual_enrolment, 0) / nullif(filed_fee_per_child, 0) AS fee_identity_ratio,
    actual_enrolment / educators AS staff_ratio, registry_capacity_max - approved_capacity AS capacity_gap, parent_fee / nullif(parent_fee + gov_subsidy, 0) AS parent_share,
    parent_fee / nullif(actual_enrolment, 0) / 12 AS parent_monthly_avg, period_months >= 12 AS full_year FROM rp)"""


def reports(t: Tables) -> DataFrame:
    n = F.col("n_lines")
    base = R.panel(t).select(
        "entity", "year", F.col("gross").alias("tuition_income"), F.when(n < 100, F.col("qty")).alias("actual_enrolment"),
        (n * 25.0).alias("approved_capacity"), (n * 2.0).alias("educators"), F.col("levy").alias("material_cost"),
        (n * 25.0 + F.col("open_qty") / 20 - 60).alias("registry_capacity_max"), (F.col("qty") * 3).alias("registry_indoor_area"),
        F.when(F.col("year") < 1998, F.col("gross") / F.col("qty") * (0.9 + n / 500.0)).alias("filed_fee_per_child"),
        F.col("rebate").alias("parent_fee"), F.when(n > 72, F.col("net")).alias("gov_subsidy"),
        F.when(F.col("year") == 2001, 11).otherwise(12).alias("period_months"),
        (F.col("rebate") / F.col("qty") / 12 * 1.02 * (n / 86.0)).alias("registry_monthly"))
    return K.nonprofit_metrics(base)


METRICS = ["implied_fee_per_child", "fee_identity_ratio", "enrolment_utilisation", "staff_ratio", "material_per_child", "capacity_gap",
           "implied_fee_annualised", "area_per_child_registry", "area_per_child_report", "fee_split_total", "parent_share",
           "parent_per_child", "gov_subsidy_per_child", "parent_monthly_avg"]


@plan("P17 P14", with_("panel", more=REPORT) + """SELECT entity, year, full_year, round(implied_fee_per_child, 6) AS implied_fee_per_child, round(fee_identity_ratio, 6) AS fee_identity_ratio,
    round(actual_enrolment / approved_capacity, 6) AS enrolment_utilisation, round(staff_ratio, 6) AS staff_ratio, round(material_cost / nullif(actual_enrolment, 0), 6) AS material_per_child,
    round(capacity_gap, 6) AS capacity_gap, round(implied_fee_per_child * 12 / period_months, 6) AS implied_fee_annualised, round(registry_indoor_area / nullif(registry_capacity_max, 0), 6) AS area_per_child_registry,
    round(registry_indoor_area / approved_capacity, 6) AS area_per_child_report, round(parent_fee + gov_subsidy, 4) AS fee_split_total, round(parent_share, 6) AS parent_share,
    round(parent_fee / nullif(actual_enrolment, 0), 6) AS parent_per_child, round(gov_subsidy / nullif(actual_enrolment, 0), 6) AS gov_subsidy_per_child, round(parent_monthly_avg, 6) AS parent_monthly_avg FROM m""")
def report_metrics(t: Tables) -> DataFrame:
    return reports(t).select("entity", "year", "full_year", *[F.round(c, 4 if c == "fee_split_total" else 6).alias(c) for c in METRICS])


PEER2 = """fe AS (SELECT entity, year, implied_fee_per_child AS value FROM m WHERE full_year AND implied_fee_per_child IS NOT NULL),
    sh AS (SELECT entity, year, parent_share AS value FROM m WHERE parent_share IS NOT NULL),
    """ + scales_sql("fe", "year", "fs") + ",\n" + scales_sql("sh", "year", "ss")


def with_peers(t: Tables) -> DataFrame:
    m = reports(t)
    keys = ["entity", "year", "full_year"]
    long = P.melt(m, keys, ["implied_fee_per_child", "parent_share"])
    pool = (F.col("feature") == "parent_share") | F.col("full_year")
    z = P.robust_z(long, ["year", "feature"], min_peers=1, pool=pool).groupBy("entity", "year").agg(
        *[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{c}_{s}")
          for f, s in (("implied_fee_per_child", "fee"), ("parent_share", "share")) for c in ("z", "n")])
    return m.join(z, ["entity", "year"], "left")


@plan("R6 A37", with_("panel", more=REPORT + ",\n" + PEER2 + """, j AS (SELECT m.*, (implied_fee_per_child - fs.median) / fs.scale AS zf, fs.n AS nf,
    (parent_share - ss.median) / ss.scale AS zs, ss.n AS ns FROM m LEFT JOIN fs ON m.year = fs.year LEFT JOIN ss ON m.year = ss.year)""") + """SELECT entity, year, u.* FROM j, LATERAL (
    SELECT 'fee_identity' AS rule, CASE WHEN filed_fee_per_child IS NULL OR fee_identity_ratio IS NULL OR period_months < 12 THEN NULL ELSE abs(fee_identity_ratio - 1) <= 0.05 END AS passed,
      CASE WHEN period_months >= 12 AND abs(fee_identity_ratio - 1) > 0.05 THEN 'high' ELSE 'medium' END AS severity UNION ALL
    SELECT 'capacity_agrees', abs(capacity_gap) <= 20, CASE WHEN abs(capacity_gap) >= 100 THEN 'high' ELSE 'medium' END UNION ALL
    SELECT 'staff_ratio_limit', staff_ratio < 13, CASE WHEN staff_ratio > 15 THEN 'high' ELSE 'medium' END UNION ALL
    SELECT 'implied_fee_peers', CASE WHEN NOT full_year OR implied_fee_per_child IS NULL OR nf < 8 THEN NULL ELSE NOT coalesce(abs(zf) >= 2, false) END, 'medium' UNION ALL
    SELECT 'parent_monthly_within_registered', CASE WHEN registry_monthly <> 0 THEN parent_monthly_avg <= registry_monthly END, 'medium' UNION ALL
    SELECT 'parent_share_peers', CASE WHEN parent_share IS NULL OR ns < 8 THEN NULL ELSE NOT coalesce(abs(zs) >= 2, false) END, 'medium') u""")
def nonprofit_cross_checks(t: Tables) -> DataFrame:
    return K.run_rules(with_peers(t), ["entity", "year"], K.nonprofit_rules()).drop("evidence")


@plan("R9", with_("panel", more=REPORT) + """SELECT entity, year, 'enrolment_over_capacity' AS guard FROM m WHERE actual_enrolment > approved_capacity UNION ALL
    SELECT entity, year, 'enrolment_over_registry' FROM m WHERE actual_enrolment > registry_capacity_max UNION ALL
    SELECT entity, year, 'split_not_income' FROM m WHERE abs(parent_fee + gov_subsidy - tuition_income) > 1""")
def guard_violations(t: Tables) -> DataFrame:
    e = F.col("actual_enrolment")
    return K.guards(reports(t), ["entity", "year"], {
        "enrolment_over_capacity": e > F.col("approved_capacity"), "enrolment_over_registry": e > F.col("registry_capacity_max"),
        "split_not_income": F.abs(F.col("fee_split_total") - F.col("tuition_income")) > fixed.MONEY_TOL})


BUDGET = """bd AS (SELECT p.entity, p.year, net AS fund_source, net - rebate AS gov_transfer, gross AS tuition_budget, net AS tuition_actual, levy * 1.1 AS capex_budget,
    CASE WHEN n_lines > 95 THEN NULL ELSE rebate END AS capex_actual, qty AS fund_use, n_lines * 1.0 AS staff_budget, open_qty / 13 AS staff_actual, net - gross * 0.951 AS surplus,
    rebate * 0.02 AS closing, levy AS opening_balance FROM panel p),
    br AS (SELECT *, gov_transfer / nullif(fund_source, 0) AS gov_dependency, coalesce(tuition_actual, 0) / nullif(tuition_budget, 0) AS tuition_execution,
    coalesce(capex_actual, 0) / nullif(capex_budget, 0) AS capex_execution, fund_use / nullif(staff_actual, 0) AS cost_per_staff, closing - opening_balance AS balance_change FROM bd)"""


def budgets(t: Tables) -> DataFrame:
    n = F.col("n_lines")
    return K.budget_ratios(R.panel(t).select(
        "entity", "year", F.col("net").alias("fund_source"), (F.col("net") - F.col("rebate")).alias("gov_transfer"),
        F.col("gross").alias("tuition_budget"), F.col("net").alias("tuition_actual"), (F.col("levy") * 1.1).alias("capex_budget"),
        F.when(n <= 95, F.col("rebate")).alias("capex_actual"), F.col("qty").alias("fund_use"), (n * 1.0).alias("staff_budget"),
        (F.col("open_qty") / 13).alias("staff_actual"), (F.col("net") - F.col("gross") * 0.951).alias("surplus"),
        (F.col("rebate") * 0.02).alias("closing"), F.col("levy").alias("opening_balance")))


@plan("P16", with_("panel", more=BUDGET) + """SELECT entity, year, round(gov_dependency, 6) AS gov_dependency, round(tuition_execution, 6) AS tuition_execution,
    round(capex_execution, 6) AS capex_execution, round(cost_per_staff, 6) AS cost_per_staff, round(balance_change, 4) AS balance_change FROM br""")
def budget_ratios(t: Tables) -> DataFrame:
    names = ["gov_dependency", "tuition_execution", "capex_execution", "cost_per_staff", "balance_change"]
    return budgets(t).select("entity", "year", *[F.round(c, 4 if c == "balance_change" else 6).alias(c) for c in names])


@plan("R8 W8", with_("panel", more=BUDGET + """, md AS (SELECT year, median(tuition_execution) AS med, count(*) AS n FROM br GROUP BY year),
    ma AS (SELECT b.year, median(abs(tuition_execution - med)) AS mad FROM br b JOIN md ON b.year = md.year GROUP BY b.year),
    j AS (SELECT br.*, md.n, CASE WHEN mad > 0 AND n >= 6 THEN (tuition_execution - med) / (1.4826 * mad) END AS z FROM br JOIN md ON br.year = md.year JOIN ma ON br.year = ma.year)""")
      + """SELECT entity, year, u.* FROM j, LATERAL (SELECT 'staff_gap' AS rule, staff_budget - staff_actual < 3 AS passed,
      CASE WHEN staff_budget - staff_actual >= 10 THEN 'high' ELSE 'medium' END AS severity UNION ALL
    SELECT 'tuition_execution_peers', CASE WHEN n >= 6 THEN NOT coalesce(z <= -2, false) END, 'medium' UNION ALL
    SELECT 'capex_execution', capex_execution BETWEEN 0.5 AND 1.5, CASE WHEN capex_execution > 1.5 THEN 'medium' ELSE 'low' END UNION ALL
    SELECT 'balance_depletion', NOT (surplus < 0 AND closing < -surplus), CASE WHEN surplus < 0 AND closing < -surplus THEN 'high' ELSE 'medium' END UNION ALL
    SELECT 'dependency', gov_dependency <= 0.95, 'low') u""")
def public_budget_checks(t: Tables) -> DataFrame:
    b = budgets(t)
    z = P.mad_z(P.melt(b, ["entity", "year"], ["tuition_execution"]), ["year"]).select(
        "entity", "year", F.col("z").alias("z_tuition"), F.col("n").alias("n_peers"))
    return K.run_rules(b.join(z, ["entity", "year"], "left"), ["entity", "year"], K.budget_rules()).drop("evidence")


@plan("P18 R7 J9 A5", with_("panel", "inst", more="""cap AS (SELECT c_nationkey AS k, sum(c_acctbal) / 40 AS capacity, count(*) AS branches FROM customer GROUP BY 1),
    pr AS (SELECT s_nationkey AS k, year, sum(gross) AS tuition, sum(net) AS gov, sum(qty) * 30 AS half, sum(levy) AS cost FROM panel JOIN supplier ON s_suppkey = entity GROUP BY 1, 2),
    f AS (SELECT a.*, CASE WHEN b.half IS NULL OR b.half = 0 THEN a.half * 2 WHEN a.half = 0 THEN b.half * 2 ELSE a.half + b.half END AS fee, c.capacity, c.branches
    FROM pr a LEFT JOIN pr b ON a.k = b.k AND b.year = a.year - 1 LEFT JOIN cap c ON a.k = c.k),
    q AS (SELECT *, tuition / nullif(fee, 0) AS implied FROM f),
    oc AS (SELECT k AS entity, year, implied / nullif(capacity, 0) AS value FROM q WHERE implied / nullif(capacity, 0) IS NOT NULL),
    gp AS (SELECT k AS entity, year, gov / nullif(implied, 0) AS value FROM q WHERE gov / nullif(implied, 0) IS NOT NULL),
    """ + scales_sql("oc", "year", "os") + ",\n" + scales_sql("gp", "year", "gs")) + """SELECT q.k AS entity, q.year, branches, round(fee, 2) AS fee_basis, round(implied, 6) AS implied,
    round(implied / nullif(capacity, 0), 6) AS occupancy, round(gov / nullif(implied, 0), 4) AS gov_per_child, round(cost / nullif(implied, 0), 4) AS cost_per_child,
    CASE WHEN os.n < 8 OR implied / nullif(capacity, 0) IS NULL THEN NULL ELSE NOT coalesce((implied / nullif(capacity, 0) - os.median) / os.scale <= -2, false) END AS occupancy_ok,
    CASE WHEN gs.n < 8 OR gov / nullif(implied, 0) IS NULL THEN NULL ELSE NOT coalesce((gov / nullif(implied, 0) - gs.median) / gs.scale >= 2, false) END AS gov_ok
    FROM q LEFT JOIN os ON os.year = q.year LEFT JOIN gs ON gs.year = q.year""")
def public_occupancy_checks(t: Tables) -> DataFrame:
    # Branches are rolled up to their parent before the join.
    cap = t.customer.groupBy(F.col("c_nationkey").alias("entity")).agg(
        (F.sum("c_acctbal") / 40).alias("capacity"), F.count(F.lit(1)).alias("branches"))
    pr = R.panel(t).join(t.supplier, F.col("entity") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("entity"), "year").agg(
        F.sum("gross").alias("tuition"), F.sum("net").alias("gov"), (F.sum("qty") * 30).alias("half"), F.sum("levy").alias("cost"))
    before = pr.select("entity", (F.col("year") + 1).alias("year"), F.col("half").alias("prev_half"))
    f = pr.join(before, ["entity", "year"], "left").join(cap, "entity", "left")
    q = f.withColumn("fee_basis", K.half_year_basis(F.col("prev_half"), F.col("half")))
    q = q.withColumn("implied", C.ratio(F.col("tuition"), F.col("fee_basis")))
    q = q.withColumns({"occupancy": C.ratio(F.col("implied"), F.col("capacity")),
                       "gov_per_child": C.ratio(F.col("gov"), F.col("implied")), "cost_per_child": C.ratio(F.col("cost"), F.col("implied"))})
    z = P.robust_z(P.melt(q, ["entity", "year"], ["occupancy", "gov_per_child"]), ["year", "feature"], min_peers=1).groupBy("entity", "year").agg(
        *[F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{c}_{f}") for f in ("occupancy", "gov_per_child") for c in ("z", "n")])
    d = q.join(z, ["entity", "year"], "left")
    ok = lambda f, bad: K.peer_verdict(F.col(f), F.col(f"z_{f}"), F.col(f"n_{f}"), bad)
    return d.select(
        "entity", "year", "branches", F.round("fee_basis", 2).alias("fee_basis"), F.round("implied", 6).alias("implied"),
        F.round("occupancy", 6).alias("occupancy"), F.round("gov_per_child", 4).alias("gov_per_child"), F.round("cost_per_child", 4).alias("cost_per_child"),
        ok("occupancy", F.col("z_occupancy") <= -fixed.PEER_Z).alias("occupancy_ok"),
        ok("gov_per_child", F.col("z_gov_per_child") >= fixed.PEER_Z).alias("gov_ok"))


SLACK = """sl AS (SELECT l_suppkey AS code, year(l_shipdate) AS year, l_returnflag || l_linestatus AS item, sum(l_extendedprice * 0.951) AS budget,
    sum(l_extendedprice * (1 - l_discount)) AS actual FROM lineitem GROUP BY 1, 2, 3),
    sk AS (SELECT code, year, max(CASE WHEN item = 'AF' THEN actual - budget END) AS d, coalesce(sum(CASE WHEN item <> 'AF' AND actual - budget > 1 THEN actual - budget END), 0) AS ov,
    coalesce(sum(CASE WHEN item <> 'AF' AND actual - budget < -1 THEN budget - actual END), 0) AS un FROM sl GROUP BY 1, 2),
    ss AS (SELECT *, CASE WHEN d IS NULL THEN 'no_protected_row' WHEN ov = 0 THEN 'no_overspend' WHEN ov <= un THEN 'absorbable' ELSE 'exceeds_slack' END AS state FROM sk)"""


@plan("R4", with_(more=SLACK) + "SELECT code, year, round(d, 3) AS protected_diff, round(ov, 3) AS total_over, round(un, 3) AS total_under, state FROM ss", wide="year")
def transfer_slack(t: Tables) -> DataFrame:
    return slack(t).select("code", "year", *[F.round(c, 3).alias(c) for c in ("protected_diff", "total_over", "total_under")], "state")


def slack(t: Tables) -> DataFrame:
    facts = t.lineitem.groupBy(F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("year"),
                               F.concat("l_returnflag", "l_linestatus").alias("item")).agg(
        F.sum(F.col("l_extendedprice") * 0.951).alias("budget"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual"))
    return K.transfer_slack(facts, ["code", "year"], "item", "budget", "actual", "AF")


PAIRED = """it AS (SELECT l_orderkey AS code, l_linestatus AS tab, l_linenumber AS item, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS r,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS p FROM lineitem GROUP BY 1, 2, 3),
    tb AS (SELECT code, tab, max(r) + max(p) AS b, count(*) FILTER (r = 1 AND p = 1) AS g, count(*) FILTER (r + p = 1) AS h FROM it GROUP BY 1, 2),
    rs AS (SELECT code, coalesce(sum(CASE WHEN b = 2 THEN g END), 0) AS gross_items, coalesce(sum(CASE WHEN b = 2 THEN h END), 0) AS partial_items FROM tb GROUP BY 1),
    pe AS (SELECT *, CASE WHEN gross_items > 0 AND partial_items = 0 THEN 'gross_documented' WHEN gross_items > 0 THEN 'partial_sides' ELSE 'single_sided_only' END AS state FROM rs)"""


def paired(t: Tables) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "A", "recv").when(F.col("l_returnflag") == "R", "pay").otherwise("")
    cells = t.lineitem.select(F.col("l_orderkey").alias("code"), F.col("l_linestatus").alias("tab"),
                              F.col("l_linenumber").alias("item"), side.alias("side"))
    return K.paired_columns(cells, ["code"], "tab", "item", "side")


@plan("R5", with_(more=PAIRED) + "SELECT code, CAST(gross_items AS BIGINT) AS gross_items, CAST(partial_items AS BIGINT) AS partial_items, state, CASE WHEN state = 'gross_documented' THEN true END AS passed FROM pe")
def paired_column_evidence(t: Tables) -> DataFrame:
    return paired(t).select("code", "gross_items", "partial_items", "state", "passed")


@plan("J20", with_(more=",\n".join([PAIRS, STATEMENT, POLICY, PAIRED])) + """SELECT ck.code, CASE WHEN ck.passed IS NULL AND state = 'gross_documented' THEN true ELSE ck.passed END AS passed,
    CASE WHEN ck.passed IS NULL THEN state END AS evidence_state, coalesce(ck.passed IS NULL AND state = 'gross_documented', false) AS resolved
    FROM ck LEFT JOIN pe ON pe.code = ck.code WHERE rule = 'gross_recording'""")
def evidence_resolution(t: Tables) -> DataFrame:
    open_checks = policy_checks(t).where(F.col("rule") == "gross_recording").select("code", "passed")
    return K.apply_evidence(open_checks, paired(t), ["code"])


@plan("A25", with_(more=",\n".join([PAIRS, STATEMENT])) + """SELECT cell, count(*) AS n, median(r) AS ratio_median, min(r) AS ratio_min, max(r) AS ratio_max FROM (
    SELECT CASE WHEN personnel_budget - personnel_actual > 0 AND transfer IS NOT NULL AND transfer <> 0 THEN 'conjunction'
    WHEN personnel_budget - personnel_actual > 0 THEN 'shortfall_only' ELSE 'no_shortfall' END AS cell,
    CASE WHEN personnel_budget - personnel_actual > 0 AND transfer <> 0 THEN round(transfer / (personnel_budget - personnel_actual), 3) END AS r
    FROM st WHERE personnel_budget IS NOT NULL) GROUP BY cell""")
def shortfall_transfer_cells(t: Tables) -> DataFrame:
    from tallyscope.operators import ordering as O
    short = F.col("personnel_budget") - F.col("personnel_actual")
    moved = F.coalesce(F.col("transfer") != 0, F.lit(False))
    d = statements(t).where(F.col("personnel_budget").isNotNull()).select(
        F.when((short > 0) & moved, "conjunction").when(short > 0, "shortfall_only").otherwise("no_shortfall").alias("cell"),
        F.when((short > 0) & moved, F.round(F.col("transfer") / short, 3)).alias("r"))
    counts = d.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("ratio_min"), F.max("r").alias("ratio_max"))
    return counts.join(O.medians(d, F.col("r"), ["cell"], "ratio_median").drop("n"), "cell", "left")
