"""Three-valued rule checks: true, false, or NULL for insufficient data.

Each rule is a column expression; a report row yields all its checks by one explode, so
any number of rules costs one pass. ``passed = false`` is the only form of failure.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed
from tallyscope.session import counted_side


@dataclasses.dataclass(frozen=True)
class Rule:
    """A named check: verdict expression, severity expression and evidence value."""

    name: str
    passed: Column
    severity: Column
    evidence: Column


def col(name: str) -> Column:
    return F.col(name)


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def run_rules(reports: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Long check rows, one per report and rule."""
    checks = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), r.passed.alias("passed"), r.severity.alias("severity"),
                 r.evidence.cast("double").alias("evidence")) for r in rules]))
    return reports.select(*keys, checks.alias("_c")).select(*keys, "_c.*")


def matched_sides(asset: Column, liability: Column, opening: Column) -> Column:
    """Asset equals liability; a missing side fails unless the report opens the series."""
    both_missing = asset.isNull() & liability.isNull()
    one_missing = asset.isNull() | liability.isNull()
    return (F.when(both_missing, unknown())
            .when(one_missing & opening, unknown())
            .when(one_missing, F.lit(False))
            .otherwise(F.abs(liability - asset) <= fixed.MONEY_TOL))


def policy_rules() -> list[Rule]:
    """The seven self-stated policy rules of a filed statement."""
    sa, sl = col("severance_asset"), col("severance_liability")
    ra, rl = col("reserve_asset"), col("reserve_liability")
    transfer, revenue, surplus = col("transfer"), col("revenue"), col("surplus")
    pb, pa, tb, ta = (col(c) for c in ("personnel_budget", "personnel_actual", "total_budget", "total_actual"))
    disclosed, payable = col("disclosed"), col("payable")
    share = C.ratio(transfer, revenue)
    limit = F.greatest(F.lit(fixed.MONEY_TOL), F.abs(disclosed) * fixed.RELATED_PARTY_MATERIALITY)
    loss = (F.when(transfer.isNull() | surplus.isNull(), unknown())
            .when(transfer <= 0, F.lit(True)).when(surplus >= 0, F.lit(True))
            .when(surplus + transfer >= 0, unknown()).otherwise(F.lit(False)))
    cap = (F.when(transfer.isNull() | revenue.isNull() | (revenue == 0), unknown())
           .when(transfer <= revenue * fixed.RESERVE_CAP + fixed.MONEY_TOL, F.lit(True))
           .when(share <= fixed.RESERVE_MARGIN, unknown()).otherwise(F.lit(False)))
    outflow = F.when((pb + pa + tb + ta).isNotNull() & (pa >= pb - fixed.MONEY_TOL), F.lit(True)).otherwise(unknown())
    related = F.when(disclosed.isNotNull() & payable.isNotNull(), F.abs(payable - disclosed) <= limit)
    gross = F.when((F.coalesce(col("n_net_labels"), F.lit(0)) > 0) | (F.coalesce(col("n_equal_pairs"), F.lit(0)) > 0),
                   unknown()).otherwise(F.lit(True))
    one_sided = ra.isNull() | rl.isNull()
    return [
        Rule("severance_asset_equals_liability", matched_sides(sa, sl, col("opening")), F.lit("medium"), sl - sa),
        Rule("reserve_asset_equals_liability", matched_sides(ra, rl, col("opening")),
             F.when(one_sided & (col("opening") | (ra.isNull() & rl.isNull())), "medium").otherwise("high"), rl - ra),
        Rule("no_transfer_in_loss_year", loss, F.lit("high"), surplus + transfer),
        Rule("transfer_cap", cap, F.lit("high"), share),
        Rule("no_personnel_outflow", outflow, F.lit("high"), pb - pa),
        Rule("related_party_payable", related, F.lit("medium"), payable - disclosed),
        Rule("gross_recording", gross, F.lit("medium"), col("n_equal_pairs")),
    ]


def equal_amount_pairs(lines: DataFrame, key: str, side: Column, amount: str, label: str,
                       position: Column, labels: bool = True) -> DataFrame:
    """Amounts that occur on the revenue and on the expense side of one report.

    One aggregate per (report, amount) keeps the first label of each side; no line is
    paired with another. Positions and texts can only be aggregated by sorting, so without
    ``labels`` the same rows come as (report, amount) from marks of fixed size, and only
    amounts with an unlabelled line go by positions.
    """
    d = lines.where(F.col(amount).isNotNull() & (F.col(amount) != 0)).withColumn("_side", side)
    if not labels:
        bare = F.col(label).isNull()
        marks = d.groupBy(key, amount).agg(F.bool_or(F.col("_side") == "revenue").alias("_r"),
                                           F.bool_or(F.col("_side") == "expense").alias("_e"), F.bool_or(bare).alias("_u"))
        sure = marks.where("_r and _e and not _u").select(key, amount)
        unlabelled = d.where(bare).select(F.col(key).alias("_k"), F.col(amount).alias("_a"))
        if unlabelled.head() is None:
            return sure
        some = d.join(counted_side(unlabelled.distinct()), F.col(key).eqNullSafe(F.col("_k")) & (F.col(amount) == F.col("_a")), "left_semi")
        return sure.unionByName(equal_amount_pairs(some, key, F.col("_side"), amount, label, position).select(key, amount))
    first = lambda s: F.min_by(F.when(F.col("_side") == s, F.col(label)),
                               F.when(F.col("_side") == s, position))
    return d.groupBy(key, amount).agg(first("revenue").alias("revenue_label"),
                                      first("expense").alias("expense_label")).where(
        F.col("revenue_label").isNotNull() & F.col("expense_label").isNotNull())


def classify_gap(prev_asset: Column, prev_liability: Column, asset: Column, liability: Column
                 ) -> tuple[Column, Column]:
    """(verdict, lag match) of a reserve gap over two consecutive years; NULL says nothing.

    The lag test comes before the size test: a fund topped up a year late has a steady gap
    that the asset side explains.
    """
    known = (prev_asset + prev_liability + asset + liability).isNotNull()
    before, now = prev_liability - prev_asset, liability - asset
    funded = (F.abs(before) <= fixed.GAP_TOL) & (F.abs(now) <= fixed.GAP_TOL)
    lag = (prev_liability != 0) & (F.abs(asset - prev_liability) <= fixed.LAG_TOL * F.abs(prev_liability))
    delta = now - before
    verdict = F.when(known & ~funded, F.when(delta < -fixed.GAP_TOL, "narrowed").when(lag, "one_year_lag")
                     .when(F.abs(delta) <= fixed.GAP_TOL, "stable").otherwise("widened"))
    return verdict, F.when(known & ~funded, lag)


def consecutive_years(df: DataFrame, entity: str, year: str, columns: Sequence[str]) -> DataFrame:
    """Rows joined to the same entity's row of exactly one year before."""
    before = df.select(F.col(entity).alias("_e"), (F.col(year) + 1).alias("_y"),
                       *[F.col(c).alias("prev_" + c) for c in columns])
    return df.join(before, (F.col(entity) == F.col("_e")) & (F.col(year) == F.col("_y"))).drop("_e", "_y")


def nonprofit_metrics(r: DataFrame) -> DataFrame:
    """Cross-source metrics of a filed report (ratios stay NULL when an input is missing)."""
    enrol, tui, cap = col("actual_enrolment"), col("tuition_income"), col("approved_capacity")
    edu, mat, months = col("educators"), col("material_cost"), col("period_months")
    reg, area, fee = col("registry_capacity_max"), col("registry_indoor_area"), col("filed_fee_per_child")
    parent, gov = col("parent_fee"), col("gov_subsidy")
    per = lambda a: C.ratio(a, enrol)
    implied, total = per(tui), parent + gov
    return r.withColumns({
        "implied_fee_per_child": implied,
        "fee_identity_ratio": C.ratio(implied, fee),
        "enrolment_utilisation": C.ratio(enrol, cap),
        "staff_ratio": C.ratio(enrol, edu),
        "material_per_child": per(mat),
        "capacity_gap": reg - cap,
        "full_year": months.isNull() | (months >= 12),
        "implied_fee_annualised": C.ratio(implied * 12, months),
        "area_per_child_registry": C.ratio(area, reg),
        "area_per_child_report": C.ratio(area, cap),
        "fee_split_total": total,
        "parent_share": C.ratio(parent, total),
        "parent_per_child": per(parent),
        "gov_subsidy_per_child": per(gov),
        "parent_monthly_avg": per(parent) / 12,
    })


def peer_verdict(value: Column, z: Column, n: Column, bad: Column) -> Column:
    """Peer rules: unknown without value or peers, otherwise pass unless ``bad``."""
    return F.when(value.isNull() | n.isNull() | (n < fixed.MIN_PEERS), unknown()).otherwise(
        ~F.coalesce(bad, F.lit(False)))


def nonprofit_rules() -> list[Rule]:
    """The six cross-source rules; peer rules read z and n of their two features."""
    ratio_, gap, staff = col("fee_identity_ratio"), col("capacity_gap"), col("staff_ratio")
    short = col("period_months").isNotNull() & (col("period_months") < 12)
    near = F.abs(ratio_ - 1) <= fixed.FEE_IDENTITY_TOL
    pm, reg = col("parent_monthly_avg"), col("registry_monthly")
    return [
        Rule("fee_identity", F.when(col("filed_fee_per_child").isNull() | ratio_.isNull() | short, unknown()).otherwise(near),
             F.when(~short & ratio_.isNotNull() & ~near, "high").otherwise("medium"), ratio_),
        Rule("capacity_agrees", F.when(gap.isNotNull(), F.abs(gap) <= fixed.CAPACITY_GAP_TOL),
             F.when(F.abs(gap) >= 100, "high").otherwise("medium"), gap),
        Rule("staff_ratio_limit", F.when(staff.isNotNull(), staff < fixed.STAFF_RATIO_WATCH),
             F.when(staff > fixed.STAFF_RATIO_LEGAL, "high").otherwise("medium"), staff),
        Rule("implied_fee_peers", F.when(col("full_year"), peer_verdict(
            col("implied_fee_per_child"), col("z_fee"), col("n_fee"), F.abs(col("z_fee")) >= fixed.PEER_Z)),
            F.lit("medium"), col("z_fee")),
        Rule("parent_monthly_within_registered", F.when(pm.isNotNull() & (reg != 0), pm <= reg), F.lit("medium"), pm),
        Rule("parent_share_peers", peer_verdict(col("parent_share"), col("z_share"), col("n_share"),
                                                F.abs(col("z_share")) >= fixed.PEER_Z), F.lit("medium"), col("z_share")),
    ]


def half_year_basis(prev: Column, cur: Column) -> Column:
    """Fee basis from two half years; zero counts as missing, one side is doubled."""
    a, b = F.when(prev != 0, prev), F.when(cur != 0, cur)
    return F.coalesce(a + b, a * 2, b * 2)


def budget_ratios(r: DataFrame) -> DataFrame:
    return r.withColumns({
        "gov_dependency": C.ratio(col("gov_transfer"), col("fund_source")),
        "tuition_execution": C.execution_rate(col("tuition_actual"), col("tuition_budget")),
        "capex_execution": C.execution_rate(col("capex_actual"), col("capex_budget")),
        "cost_per_staff": C.ratio(col("fund_use"), col("staff_actual")),
        "balance_change": col("closing") - col("opening_balance"),
    })


def budget_rules() -> list[Rule]:
    """Five rules over a public budget year; the tuition rule reads its cohort z."""
    gap = col("staff_budget") - col("staff_actual")
    te, ce, gd = col("tuition_execution"), col("capex_execution"), col("gov_dependency")
    sur, close = col("surplus"), col("closing")
    return [
        Rule("staff_gap", F.when(gap.isNotNull(), gap < fixed.STAFF_GAP_MIN),
             F.when(gap >= fixed.STAFF_GAP_HIGH, "high").otherwise("medium"), gap),
        Rule("tuition_execution_peers", F.when(te.isNotNull() & (col("n_peers") >= fixed.MIN_PEERS_BUDGET),
                                               ~F.coalesce(col("z_tuition") <= -fixed.PEER_Z, F.lit(False))),
             F.lit("medium"), col("z_tuition")),
        Rule("capex_execution", F.when(ce.isNotNull(), ce.between(fixed.CAPEX_UNDER, fixed.CAPEX_OVER)),
             F.when(ce > fixed.CAPEX_OVER, "medium").otherwise("low"), ce),
        Rule("balance_depletion", F.when(sur.isNotNull() & close.isNotNull(), ~((sur < 0) & (close < -sur))),
             F.when((sur < 0) & (close < -sur), "high").otherwise("medium"), close + sur),
        Rule("dependency", F.when(gd.isNotNull(), gd <= fixed.DEPENDENCY_HIGH), F.lit("low"), gd),
    ]


def guards(df: DataFrame, keys: Sequence[str], bounds: dict[str, Column]) -> DataFrame:
    """Violations only; an expression that is NULL raises nothing."""
    hits = F.explode(F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in bounds.items()]),
                              lambda g: g.isNotNull()))
    return df.select(*keys, hits.alias("guard"))


def verdict_state(passed: Column) -> Column:
    return F.when(passed, "pass").when(~passed, "fail").otherwise("insufficient")


def rule_tally(checks: DataFrame) -> DataFrame:
    """Checks per rule and state."""
    state = verdict_state(F.col("passed"))
    return checks.groupBy("rule").agg(*[F.count_if(state == s).alias(f"n_{s}") for s in ("pass", "fail", "insufficient")])


def apply_evidence(checks: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Let table evidence decide only checks that are still open; decided ones stay."""
    e = evidence.select(*keys, F.col("passed").alias("_p"), F.col("state").alias("evidence_state"),
                        F.col("changed").alias("_c"))
    d = checks.join(e, list(keys), "left")
    open_ = F.col("passed").isNull()
    taken = open_ & F.coalesce("_c", F.lit(False))
    return d.select(*keys, F.when(taken, F.col("_p")).otherwise(F.col("passed")).alias("passed"),
                    F.when(open_, F.col("evidence_state")).alias("evidence_state"),
                    taken.alias("resolved"))


def transfer_slack(facts: DataFrame, key: Sequence[str], item: str, budget: str, actual: str,
                   protected: str) -> DataFrame:
    """Can overspent categories be covered by underspent siblings? Never a pass.

    One aggregate per report over one row per category; the protected category itself is
    neither a source nor a use.
    """
    diff = F.col(actual) - F.col(budget)
    other = F.col(item) != protected
    over = F.sum(F.when(other & (diff > fixed.MONEY_TOL), diff))
    under = F.sum(F.when(other & (diff < -fixed.MONEY_TOL), -diff))
    d = facts.groupBy(*key).agg(
        F.max(F.when(~other, diff)).alias("protected_diff"),
        F.coalesce(over, F.lit(0.0)).alias("total_over"), F.coalesce(under, F.lit(0.0)).alias("total_under"))
    state = (F.when(F.col("protected_diff").isNull(), "no_protected_row")
             .when(F.col("total_over") == 0, "no_overspend")
             .when(F.col("total_over") <= F.col("total_under"), "absorbable").otherwise("exceeds_slack"))
    return d.withColumn("state", state)


def paired_columns(cells: DataFrame, key: Sequence[str], table: str, item: str, side: str) -> DataFrame:
    """Gross recording evidence: items of two-sided tables that show both sides.

    ``side`` is 'recv', 'pay' or NULL; only tables that carry both sides count.
    """
    items = cells.groupBy(*key, table, item).agg(
        F.max((F.col(side) == "recv").cast("int")).alias("_r"), F.max((F.col(side) == "pay").cast("int")).alias("_p"))
    tables = items.groupBy(*key, table).agg(
        (F.max("_r") + F.max("_p")).alias("_both"),
        F.count_if((F.col("_r") == 1) & (F.col("_p") == 1)).alias("_g"),
        F.count_if((F.col("_r") + F.col("_p")) == 1).alias("_h"))
    two = F.col("_both") == 2
    d = tables.groupBy(*key).agg(
        F.coalesce(F.sum(F.when(two, F.col("_g"))), F.lit(0)).alias("gross_items"),
        F.coalesce(F.sum(F.when(two, F.col("_h"))), F.lit(0)).alias("partial_items"))
    state = (F.when((F.col("gross_items") > 0) & (F.col("partial_items") == 0), "gross_documented")
             .when(F.col("gross_items") > 0, "partial_sides").otherwise("single_sided_only"))
    done = state == "gross_documented"
    return d.withColumn("state", state).withColumn("passed", F.when(done, F.lit(True))).withColumn("changed", done)


def identity_status(lhs: Column, rhs: Column, tol: float = fixed.MONEY_TOL, required: bool = False) -> Column:
    """passed / failed within tolerance, skipped when an operand is missing (failed if required)."""
    return (F.when(lhs.isNull() | rhs.isNull(), "failed" if required else "skipped")
            .when(F.abs(lhs - rhs) <= tol, "passed").otherwise("failed"))


def compliance_summary(checks: DataFrame, targets: DataFrame, prefer_matched: bool = True,
                       rules: Sequence[str] | None = None) -> DataFrame:
    """Per institution: years checked, latest year, failures, and the finding to quote.

    checks: code, year, rule, passed, severity; targets: code, year, id, matched. With
    ``prefer_matched`` a report with operator-matched ids counts for those only. The quoted
    finding is from the newest year that failed, the highest severity first. Checks are
    folded to one row per report before they meet the ids. ``rules`` names all rules that
    occur: they are then compared by number, which needs no sort of the checks.
    """
    failed = F.coalesce(~F.col("passed"), F.lit(False))
    weight = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    counts = [F.count_if(failed).alias("_f"), F.count_if(failed & (F.col("severity") == "high")).alias("_h")]
    if rules is None:
        report = checks.groupBy("code", "year").agg(*counts, F.max(F.when(failed, F.struct("year", weight.alias("w"), "code", "rule"))).alias("_top"))
    else:
        names = sorted(set(rules))
        number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("rule"))
        worst = weight * (len(names) + 1) + number
        report = checks.groupBy("code", "year").agg(*counts, F.max(F.when(failed, worst)).alias("_w"))
        rule = F.get(F.array(*[F.lit(n) for n in names]), (F.col("_w") % (len(names) + 1) - 1).cast("int"))
        report = report.withColumn("_top", F.when(F.col("_w").isNotNull(), F.struct(
            "year", F.floor(F.col("_w") / (len(names) + 1)).alias("w"), "code", rule.alias("rule")))).drop("_w")
    t = targets
    if prefer_matched:
        any_ = targets.groupBy("code", "year").agg(F.max(F.col("matched").cast("int")).alias("_any"))
        t = targets.join(any_, ["code", "year"]).where(F.col("matched") | (F.col("_any") == 0))
    return report.join(t, ["code", "year"]).groupBy("id").agg(
        F.count_distinct("year").alias("years_checked"), F.max("year").alias("latest_year"),
        F.sum("_f").alias("failed_total"), F.sum("_h").alias("failed_high"), F.max("_top").alias("_t")).withColumn(
        "top_finding", F.when(F.col("_t").isNotNull(), F.concat_ws(" ", "_t.year", "_t.rule"))).drop("_t")
