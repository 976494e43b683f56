"""Model, back-test and matching queries; fitted ones have no SQL equivalent and are tested by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import fixed
from tallyscope.operators import forest as W
from tallyscope.operators import history as H
from tallyscope.operators import identity as I
from tallyscope.operators import matching as G
from tallyscope.operators import models as M
from tallyscope.operators import ordering as O
from tallyscope.operators import ranking as K
from tallyscope.plans import roles as R
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import with_

FEATURES = ["n_penalties_prior", "sum_severity_prior", "max_severity_prior", "n_severe_prior", "days_since_last_penalty",
            "capacity", "n_assets", "has_asset", "is_private"]


def frame_at(t: Tables, year: int) -> DataFrame:
    as_of = f"{year}-01-01"
    d = H.build_features(R.institutions(t), R.sanctions(t), R.assets(t), R.evaluations(t), as_of, "1996-01-01", "O", "F")
    return d.select("id", "kind", "n_penalties_prior", "sum_severity_prior", "max_severity_prior", "n_severe_prior",
                    F.coalesce("days_since_last_penalty", F.lit(fixed.NEVER_DAYS)).alias("days_since_last_penalty"), "capacity", "n_assets",
                    "has_asset", (F.col("kind") == "BUILDING").cast("int").alias("is_private"))


def labelled(t: Tables, frame: DataFrame, start: int, end: int) -> DataFrame:
    return H.future_label(frame, R.sanctions(t).where(F.col("role") == "F"), f"{start}-01-01", f"{end}-01-01", 5)


@plan("M2 M4")
def walk_forward_ranking(t: Tables) -> DataFrame:
    return M.walk_forward(lambda y: frame_at(t, y), lambda d, a, b: labelled(t, d, a, b), [1999, 2000, 2001], FEATURES, 2, "2001-08-01", 2)


@plan("M4 M1", with_("inst", "pen") + """, ys AS (SELECT unnest([1999, 2000, 2001]) AS year),
    f AS (SELECT year, i.id, coalesce(sum(p.severity), 0) AS score, count(p.rec) AS prior FROM ys CROSS JOIN inst i LEFT JOIN pen p ON p.id = i.id AND p.date < make_date(year, 1, 1) GROUP BY 1, 2),
    h AS (SELECT DISTINCT year, id, 1 AS hit FROM ys JOIN pen ON role = 'F' AND severity >= 5 AND date >= make_date(year, 1, 1) AND date < make_date(year + 2, 1, 1)),
    s AS (SELECT year, least(1.0, greatest(0.0, date_diff('day', make_date(year, 1, 1), DATE '2001-08-01') / date_diff('day', make_date(year, 1, 1), make_date(year + 2, 1, 1)))) AS seen FROM ys)
    SELECT year, year - 2 AS train_year, id, row_number() OVER (PARTITION BY year ORDER BY score DESC, id) AS rank, CAST(score AS DOUBLE) AS score, CASE WHEN seen > 0 THEN coalesce(hit, 0) END AS hit, prior,
    seen >= 0.999 AS label_complete, round(seen, 3) AS observed_fraction FROM f LEFT JOIN h USING (year, id) JOIN s USING (year)""".lstrip(), wide="year train_year hit")
def walk_forward_by_history(t: Tables) -> DataFrame:
    """The back-test's dates, labels, censoring and ranks with the severity of past sanctions as the score."""
    return M.walk_forward(lambda y: frame_at(t, y), lambda d, a, b: labelled(t, d, a, b), [1999, 2000, 2001], FEATURES, 2, "2001-08-01", 2,
                          lambda train, test: test.withColumn("score", F.col("sum_severity_prior").cast("double")))


#: Nested blocks: what each adds to the one before.
BLOCKS = {"history": FEATURES[:5], "registry": ["capacity"], "operation": ["n_assets", "has_asset", "is_private"],
          "evaluation": ["has_evaluation", "eval_partial", "n_partial_prior", "days_since_evaluation"],
          "findings": ["has_cross_fail", "cross_fail", "cross_fail_high", "cross_rules_n"]}


def wide_frame_at(t: Tables, year: int) -> DataFrame:
    """The features of a date with evaluations, and with the findings that were observable by then."""
    as_of = f"{year}-01-01"
    d = H.build_features(R.institutions(t), R.sanctions(t), R.assets(t), R.evaluations(t), as_of, "1996-01-01", "O", "F")
    price = F.col("o_totalprice")
    found = t.orders.select(F.col("o_custkey").alias("code"), (F.year("o_orderdate") - 1911).alias("year"), F.when(F.col("o_orderstatus") == "F", "school").otherwise("fiscal").alias("kind"),
                            F.col("o_orderpriority").alias("rule"), F.when(price > 300000, False).when(price > 200000, True).alias("passed"), F.when(price > 450000, "high").otherwise("medium").alias("severity"))
    ids = found.select("code", "year").distinct().withColumn("ids_json", F.to_json(F.array(F.col("code").cast("string"))))
    cross = I.findings_as_of(found, ids, as_of).withColumn("id", F.col("id").cast("long")).withColumn("has_cross_fail", F.lit(1))
    d = d.join(cross, "id", "left").na.fill(0, BLOCKS["findings"])
    return d.select("id", *FEATURES[:4], F.coalesce("days_since_last_penalty", F.lit(fixed.NEVER_DAYS)).alias("days_since_last_penalty"), *FEATURES[5:8],
                    (F.col("kind") == "BUILDING").cast("int").alias("is_private"), *BLOCKS["evaluation"][:3],
                    F.coalesce("days_since_evaluation", F.lit(fixed.NEVER_DAYS)).alias("days_since_evaluation"), *BLOCKS["findings"])


@plan("M3 W2")
def nested_baselines(t: Tables) -> DataFrame:
    """Metrics of a random order, of five nested feature blocks, of trees on the third, and of institutions without history."""
    from tallyscope.session import cut_lineage
    train, test = cut_lineage(labelled(t, wide_frame_at(t, 1997), 1997, 1999)), cut_lineage(labelled(t, wide_frame_at(t, 1999), 1999, 2001))
    scored = {("none", "random", "all"): test.withColumn("score", F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003)}
    features = []
    for block, more in BLOCKS.items():
        features = features + more
        for kind in ("logistic", "trees") if block == "operation" else ("logistic",):
            scored[block, kind, "all"] = cut_lineage(M.fit_ranking(train, "label", features, balanced=True, kind=kind)(test))
    cold = scored["operation", "logistic", "all"].where(F.col("n_penalties_prior") == 0)
    out = None
    for (block, kind, population), d in {**scored, ("operation", "logistic", "cold_start"): cold}.items():
        m = M.ranking_metrics(d, "label", F.col("id"), [50, 100]).select(F.lit(block).alias("block"), F.lit(kind).alias("model"), F.lit(population).alias("population"), "*")
        out = m if out is None else out.unionByName(m)
    return out


@plan("M3 W2")
def decile_hit_rates(t: Tables) -> DataFrame:
    train, test = labelled(t, frame_at(t, 1997), 1997, 1999), labelled(t, frame_at(t, 1999), 1999, 2001)
    scored, _ = M.backtest_point(train, test, "label", FEATURES)
    d = K.priority_ranks(scored, F.col("score"), F.col("id"), "kind")
    return d.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("hit_rate"))


@plan("M8")
def isolation_scores(t: Tables) -> DataFrame:
    """Every entity and year of the panel by the number of random cuts that part it from the others."""
    d = R.panel_ratios(t).withColumn("key", F.concat_ws("/", "entity", "year"))
    return W.isolation_scores(d, W.fit_forest(d, "key", R.FEATURES), R.FEATURES).select("entity", "year", F.round("isolation", 6).alias("isolation"))


@plan("M8")
def group_fold_auc(t: Tables) -> DataFrame:
    d = labelled(t, frame_at(t, 1999), 1999, 2001).join(R.institutions(t).select("id", "operator"), "id")
    oof = M.group_folds(d, "operator", "label", FEATURES, 5, 0.1)
    from tallyscope.session import cut_lineage
    oof = cut_lineage(oof.select("id", "operator", "label", "score"))
    auc = K.rank_auc(oof, F.col("score"), "label").select("auc")
    ci = M.percentile_interval(M.cluster_bootstrap_auc(oof, "operator", "score", "label", 100), "auc")
    return ci.withColumn("auc", auc.scalar())


def network_sql(v: str, p: str, a: str) -> str:
    """The permutation network of ``keyed_position`` once, as an expression."""
    def mix(r: str, i: int) -> str:
        x = f"(({r} * 7919 + {p} * 104729 + {i * 1299709 + 12345}) % 2147483647)"
        return f"(({x} * {x} % 2147483647) * 48271 % 2147483647)"
    rounds = [("l0", f"{v} // {a}"), ("r0", f"{v} % {a}")]
    inner = f"(SELECT *, {rounds[0][1]} AS l0, {rounds[1][1]} AS r0 FROM todo)"
    for i in range(4):
        inner = f"(SELECT *, r{i} AS l{i + 1}, (l{i} + {mix(f'r{i}', i)}) % {a} AS r{i + 1} FROM {inner})"
    return inner


LABELLED = """lb AS (SELECT i.id, i.operator, coalesce((SELECT sum(severity) FROM pen WHERE pen.id = i.id AND date < DATE '1999-01-01'), 0) AS severity,
    CASE WHEN i.id IN (SELECT id FROM pen WHERE role = 'F' AND severity >= 5 AND date >= DATE '1999-01-01' AND date < DATE '2001-01-01') THEN 1 ELSE 0 END AS label FROM inst i)"""


@plan("M9", "WITH RECURSIVE" + with_("inst", "pen", more=LABELLED)[4:] + f""", rk AS (SELECT *, row_number() OVER (ORDER BY severity DESC, id) AS rank FROM lb),
    g AS (SELECT operator, max(label) AS y, count(*) FILTER (rank <= 50) AS top, row_number() OVER (ORDER BY operator) - 1 AS number FROM rk GROUP BY operator),
    c AS (SELECT count(*) AS n, sum(y) AS marked, sum(top * y) AS hits, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM g),
    todo AS (SELECT number, top, p, CAST(number AS BIGINT) AS v, 0 AS s, n, a FROM g, c, (SELECT unnest(range(1, 201)) AS p) WHERE top > 0
      UNION ALL SELECT number, top, p, CAST(l4 * a + r4 AS BIGINT), s + 1, n, a FROM {network_sql("v", "p", "a")} WHERE s = 0 OR (v >= n AND s < 64)),
    spot AS (SELECT p, number, any_value(top) AS top, arg_max(v, s) AS pos FROM todo GROUP BY p, number),
    h AS (SELECT p, sum(CASE WHEN pos < marked THEN top ELSE 0 END) AS h FROM spot, c GROUP BY p)
    SELECT CAST(any_value(hits) AS BIGINT) AS hits, avg(CASE WHEN h >= hits THEN 1 ELSE 0 END) AS p_value FROM h, c""")
def top_k_permutation(t: Tables) -> DataFrame:
    d = labelled(t, frame_at(t, 1999), 1999, 2001).join(R.institutions(t).select("id", "operator"), "id")
    ranked = O.row_number(d, F.col("sum_severity_prior"), F.col("id"), (), "rank", descending=True)
    return M.cluster_permutation(ranked, "operator", "label", 50, 200)


@plan("J23", """WITH RECURSIVE lab AS (SELECT c_custkey AS id, c_mktsegment AS kind, c_acctbal AS cap, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'
      AND o_orderdate >= DATE '1999-01-01' AND o_orderdate < DATE '2001-01-01') AS hit FROM customer),
    cs AS (SELECT kind, id, cap, row_number() OVER (PARTITION BY kind ORDER BY cap, id) AS i FROM lab WHERE hit), ct AS (SELECT kind, id, cap FROM lab WHERE NOT hit),
    r AS (SELECT DISTINCT kind, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS case_id, CAST(NULL AS BIGINT) AS control_id FROM cs
      UNION ALL SELECT r.kind, cs.i, list_append(any_value(r.used), arg_min(ct.id, (abs(ct.cap - cs.cap), ct.cap, ct.id))), cs.id, arg_min(ct.id, (abs(ct.cap - cs.cap), ct.cap, ct.id))
      FROM r JOIN cs ON cs.kind = r.kind AND cs.i = r.i + 1 JOIN ct ON ct.kind = r.kind AND NOT list_contains(r.used, ct.id) GROUP BY r.kind, cs.i, cs.id, cs.cap)
    SELECT kind AS stratum, case_id, control_id FROM r WHERE i > 0""")
def matched_controls(t: Tables) -> DataFrame:
    d = labelled(t, frame_at(t, 1999), 1999, 2001).select("id", "kind", "capacity", "label")
    return G.match_without_replacement(d.where("label = 1"), d.where("label = 0"), "kind", "id", "capacity")


@plan("J1 M2 W1 W2 P22 A12 A13")
def audit_priority_list(t: Tables) -> DataFrame:
    """The main product end to end: fitted score, compliance, events and evaluations in one ranked list."""
    from tallyscope.operators import checks as C
    from tallyscope.plans.checks import policy_checks
    scored, _ = M.backtest_point(labelled(t, frame_at(t, 1997), 1997, 1999), labelled(t, frame_at(t, 1999), 1999, 2001), "label", FEATURES)
    o = t.orders.select(F.col("o_orderkey").alias("code"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("id"), F.lit(True).alias("matched"))
    compliance = C.compliance_summary(policy_checks(t).where(F.col("year") < 1999), o, rules=[r.name for r in C.policy_rules()])
    events = H.event_summary(R.sanctions(t).withColumn("type", F.col("role")), "1999-01-01", ["F", "P"])
    ev = H.latest_evaluation(R.evaluations(t), "1999-01-01")
    recent = ev.select("id", "eval_date", ((F.col("eval_partial") == 1) & (F.col("days_since_evaluation") <= 730)).cast("int").alias("recent_partial"))
    fees = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_custkey").alias("id"))
    d = K.assemble_priority_list(scored, compliance, events, recent, fees, 100)
    return d.select("id", "kind", F.round("score", 6).alias("score"), "rank_overall", "rank_within_kind", "decile", "years_checked", "failed_total", "failed_high",
                    "top_finding", "events_90d", "events_365d", "latest_event_type", "evidence_tier", "data_sufficiency", "review_reason", "flagged")


@plan("M4 W19 W20")
def walk_forward_metrics(t: Tables) -> DataFrame:
    from tallyscope.session import cut_lineage
    return K.backtest_metrics(cut_lineage(walk_forward_ranking(t)), [50, 100])
