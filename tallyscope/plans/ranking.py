"""Ranking, district and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.operators import history as H
from tallyscope.operators import ordering as O
from tallyscope.operators import ranking as K
from tallyscope.plans import roles as R
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import AS_OF, with_

# Score of an institution: severity sum before the as-of date (ties broken by id).
SCORED = f"""sc AS (SELECT i.id, i.kind, i.town, i.capacity, coalesce(sum(p.severity), 0) AS score, count(p.id) AS prior
    FROM inst i LEFT JOIN pen p ON p.id = i.id AND p.date < DATE '{AS_OF}' GROUP BY 1, 2, 3, 4)"""
RANKED = "rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank_overall FROM sc)"
LABELLED = f"""lb AS (SELECT r.*, CASE WHEN f.id IS NULL THEN 0 ELSE 1 END AS label FROM rk r LEFT JOIN (SELECT DISTINCT id
    FROM pen WHERE date >= DATE '{AS_OF}' AND date < DATE '2000-07-01' AND severity >= 4) f ON r.id = f.id)"""


def scored(t: Tables) -> DataFrame:
    hist = H.penalty_history(R.sanctions(t), AS_OF).select(
        "id", F.col("sum_severity_prior").alias("score"), F.col("n_penalties_prior").alias("prior"))
    return (R.institutions(t).select("id", "kind", "town", "capacity").join(hist, "id", "left")
            .na.fill(0, ["score", "prior"]))


def ranked(t: Tables) -> DataFrame:
    return O.row_number(scored(t), F.col("score"), F.col("id"), (), "rank_overall", descending=True)


def labelled(t: Tables) -> DataFrame:
    return H.future_label(ranked(t), R.sanctions(t), AS_OF, "2000-07-01", 4)


@plan("W1 W2", with_("inst", "pen", more=SCORED) + """SELECT id, kind, CAST(score AS BIGINT) AS score,
    row_number() OVER (ORDER BY score DESC, id) AS rank_overall,
    row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS rank_within_kind,
    CAST(greatest(1, ceil((row_number() OVER (ORDER BY score, id) - 1) * 10 / (count(*) OVER () - 1))) AS INTEGER) AS decile FROM sc""")
def priority_ranks(t: Tables) -> DataFrame:
    return K.priority_ranks(scored(t), F.col("score"), F.col("id"), "kind").select(
        "id", "kind", "score", "rank_overall", "rank_within_kind", "decile")


@plan("A16", with_("inst", "pen", more=SCORED + ",\n" + RANKED + """,
    base AS (SELECT kind, avg(CASE WHEN rank_overall <= 150 THEN 1.0 ELSE 0.0 END) AS b FROM rk GROUP BY kind),
    g AS (SELECT town, count(*) AS n, count(*) FILTER (rank_overall <= 150) AS o, count(*) FILTER (prior > 0) AS penalised, sum(b) AS e
    FROM rk JOIN base USING (kind) GROUP BY town),
    l AS (SELECT *, greatest(0, CASE WHEN o = 0 THEN 0 ELSE o * pow(1 - 1/(9*o) - 1/(3*sqrt(o)), 3) / e END) AS lo,
    (o+1) * pow(1 - 1/(9*(o+1)) + 1/(3*sqrt(o+1)), 3) / e AS hi FROM g),
    v AS (SELECT *, CASE WHEN e < 1 THEN 0 WHEN lo > 1 THEN 4 WHEN hi < 1 THEN 1 WHEN o / e >= 1 THEN 3 ELSE 2 END AS level FROM l),
    x AS (SELECT town, n, o AS observed, penalised, round(e, 4) AS expected, CASE WHEN level > 0 THEN round(o / e, 4) END AS ratio,
    CASE WHEN level > 0 THEN round(lo, 4) END AS low, CASE WHEN level > 0 THEN round(hi, 4) END AS high, level FROM v)""")
      + """SELECT *, CASE WHEN level > 0 THEN row_number() OVER (ORDER BY (level = 0), level DESC, coalesce(low, 0) DESC, observed DESC, town)
    END AS rank FROM x""", wide="rank")
def district_standardised_ratio(t: Tables) -> DataFrame:
    return K.district_board(ranked(t), 150)


@plan("A15", with_("inst", "pen", more=SCORED) + """SELECT town, count(*) AS n, round(avg(capacity), 7) AS cx, round(avg(score), 7) AS cy,
    count(*) FILTER (kind = 'BUILDING') AS n_building, count(*) FILTER (kind = 'MACHINERY') AS n_machinery,
    count(*) FILTER (capacity > 5000) AS filed, round(100 * avg(CASE WHEN capacity > 5000 THEN 1 ELSE 0 END), 1) AS filed_pct,
    count(*) FILTER (prior > 0) AS penalised FROM sc GROUP BY town""")
def district_summary(t: Tables) -> DataFrame:
    points = scored(t).withColumns({"x": F.col("capacity"), "y": F.col("score"),
                                    "filed": (F.col("capacity") > 5000).cast("int")})
    return K.district_summary(points, ["BUILDING", "MACHINERY"]).withColumns(
        {c: F.round(c, 7) for c in ("cx", "cy")})


@plan("W17", with_("inst", "pen", more=SCORED + ",\n" + RANKED + """, tr AS (SELECT id, rank_overall, CASE WHEN capacity < 0 THEN 1
    WHEN kind = 'BUILDING' AND prior >= 8 THEN 2 ELSE 3 END AS tier FROM rk)""")
      + "SELECT id, tier, rank_overall FROM tr ORDER BY tier, rank_overall, id LIMIT 400")
def tier_proposal(t: Tables) -> DataFrame:
    tiers = [F.col("capacity") < 0, (F.col("kind") == "BUILDING") & (F.col("prior") >= 8)]
    return K.tiered_proposal(ranked(t), tiers, F.col("rank_overall"), F.col("id"), 400).select(
        "id", "tier", "rank_overall")


@plan("W18", with_("inst", "pen", more=SCORED + ",\n" + RANKED) + """SELECT town, id, position FROM (SELECT town, id,
    row_number() OVER (PARTITION BY town ORDER BY score DESC, id) AS position FROM rk) WHERE position <= 3""")
def per_town_topn(t: Tables) -> DataFrame:
    return K.top_per_group(scored(t), "town", F.col("score"), F.col("id"), 3).select("town", "id", "position")


@plan("W18", """SELECT DISTINCT o_orderkey AS requested FROM orders WHERE o_totalprice > 400000 AND o_custkey NOT IN
    (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def schedule_missing_ids(t: Tables) -> DataFrame:
    wanted = t.orders.where(F.col("o_totalprice") > 400000)
    known = t.customer.where(F.col("c_acctbal") > 0)
    return wanted.join(known, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(
        F.col("o_orderkey").alias("requested")).dropDuplicates()


@plan("W19", with_("inst", "pen", more=",\n".join([SCORED, RANKED, LABELLED])) + """SELECT k, hits,
    round(hits / least(k, n), 6) AS precision, round(hits / pos, 6) AS recall, round(hits / least(k, n) / (pos / n), 6) AS lift
    FROM (SELECT k, CAST(sum(CASE WHEN rank_overall <= k THEN label END) AS BIGINT) AS hits, count(*) AS n, sum(label) AS pos
    FROM lb, (VALUES (50), (100), (300)) v(k) GROUP BY k)""")
def precision_at_k(t: Tables) -> DataFrame:
    got = K.quality_at(labelled(t), "rank_overall", "label", [50, 100, 300])
    return got.select("k", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "lift")])


@plan("W20 M7", with_("inst", "pen", more=",\n".join([SCORED, RANKED, LABELLED])) + """SELECT kind, n_pos, n_neg, u, round(u / (n_pos * n_neg), 6) AS auc,
    round(2 * u / (n_pos * n_neg) - 1, 6) AS rank_biserial,
    round((abs(u - n_pos * n_neg / 2) - 0.5) / sqrt(n_pos * n_neg / 12 * (n + 1 - tie / (n * (n - 1)))), 6) AS z FROM (
    SELECT kind, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, CAST(count(*) AS DOUBLE) AS n,
    sum(CASE WHEN label = 1 THEN ar END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2 AS u,
    sum(CAST(cnt AS DOUBLE) * cnt - 1) AS tie FROM (SELECT kind, label, count(*) OVER (PARTITION BY kind, score) AS cnt,
    rank() OVER (PARTITION BY kind ORDER BY score) + (count(*) OVER (PARTITION BY kind, score) - 1) / 2 AS ar FROM lb) GROUP BY kind)""")
def univariate_separation(t: Tables) -> DataFrame:
    got = K.rank_auc(labelled(t), F.col("score"), "label", ["kind"])
    return got.select("kind", "n_pos", "n_neg", "u", *[F.round(c, 6).alias(c) for c in ("auc", "rank_biserial", "z")])


@plan("M7", with_("inst", "pen", more=",\n".join([SCORED, RANKED, LABELLED])) + """SELECT kind, median(score) FILTER (label = 1) AS median_pos, median(score) FILTER (label = 0) AS median_neg FROM lb GROUP BY kind""")
def class_medians(t: Tables) -> DataFrame:
    return K.class_medians(labelled(t), F.col("score"), "label", ["kind"])


@plan("W20", with_("inst", "pen", more=",\n".join([SCORED, RANKED, LABELLED])) + """SELECT n_pos, n_neg, round((r - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auc
    FROM (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(CASE WHEN label = 1 THEN ar END) AS r
    FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS ar FROM lb))""")
def rank_auc(t: Tables) -> DataFrame:
    return K.rank_auc(labelled(t), F.col("score"), "label").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


FISHER = """lf AS (SELECT list_sum([ln(i) FOR i IN range(1, x + 1)]) AS v, x FROM range(0, 1601) r(x)),
    t AS (SELECT kind, count(*) FILTER (prior >= 9) AS n, count(*) FILTER (prior >= 9 AND label = 1) AS hits,
    count(*) FILTER (prior < 9) AS m, count(*) FILTER (prior < 9 AND label = 1) AS hb FROM lb GROUP BY kind),
    s AS (SELECT t.*, k FROM t, range(0, 1601) r(k) WHERE k >= hits AND k <= least(n, hits + hb) AND n - k >= 0 AND n + m - hits - hb - n + k >= 0),
    pt AS (SELECT s.kind, sum(exp(coalesce(a.v,0) - coalesce(b.v,0) - coalesce(c.v,0) + coalesce(d.v,0) - coalesce(e.v,0) - coalesce(f.v,0)
    - coalesce(g.v,0) + coalesce(h.v,0) + coalesce(i.v,0))) AS p FROM s
    JOIN lf a ON a.x = hits + hb JOIN lf b ON b.x = k JOIN lf c ON c.x = hits + hb - k
    JOIN lf d ON d.x = n + m - hits - hb JOIN lf e ON e.x = n - k JOIN lf f ON f.x = n + m - hits - hb - n + k
    JOIN lf g ON g.x = n + m JOIN lf h ON h.x = n JOIN lf i ON i.x = m GROUP BY s.kind)"""


@plan("M5 M6", with_("inst", "pen", more=",\n".join([SCORED, RANKED, LABELLED, FISHER])) + """SELECT t.kind, n, hits, m,
    round(hits / n, 6) AS rate, round(hb / m, 6) AS base, round((hits / n) / nullif(hb / m, 0), 6) AS lift, round(hits * (m - hb) / nullif((n - hits) * hb, 0), 6) AS odds_ratio, round(p, 6) AS p,
    CASE WHEN (hits / n) / nullif(hb / m, 0) >= 1.5 AND p < 0.1 THEN 'candidate' WHEN (hits / n) / nullif(hb / m, 0) < 1 THEN 'disproven'
    ELSE 'context' END AS verdict FROM t JOIN pt ON t.kind = pt.kind WHERE n >= 5 AND m >= 5""")
def flagged_lift_fisher(t: Tables) -> DataFrame:
    d = labelled(t).withColumn("flag", (F.col("prior") >= 9).cast("int"))
    got = K.two_by_two(d, "flag", "label", ["kind"])
    got = got.withColumn("verdict", K.signal_verdict(F.lit("prior_9plus"), F.col("lift"), F.col("p"), ["new_school"]))
    return got.select("kind", "n", "hits", "m", *[F.round(c, 6).alias(c) for c in ("rate", "base", "lift", "odds_ratio", "p")], "verdict")


@plan("M9 W19", with_("inst", "pen", more=",\n".join([SCORED, RANKED, LABELLED]) + """, lf AS (SELECT list_sum([ln(i) FOR i IN range(1, x + 1)]) AS v, x FROM range(0, 1601) r(x)),
    q AS (SELECT k, CAST(sum(CASE WHEN rank_overall <= k THEN label END) AS BIGINT) AS hits, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM lb, (VALUES (20), (50), (100)) v(k) GROUP BY k),
    s AS (SELECT q.*, j FROM q, range(0, 1601) r(j) WHERE j >= hits AND j <= least(k, pos) AND n - pos - k + j >= 0),
    pt AS (SELECT s.k, sum(exp(coalesce(a.v,0) - coalesce(b.v,0) - coalesce(c.v,0) + coalesce(d.v,0) - coalesce(e.v,0) - coalesce(f.v,0) - coalesce(g.v,0) + coalesce(h.v,0) + coalesce(i.v,0))) AS p FROM s
    JOIN lf a ON a.x = pos JOIN lf b ON b.x = j JOIN lf c ON c.x = pos - j JOIN lf d ON d.x = n - pos JOIN lf e ON e.x = k - j JOIN lf f ON f.x = n - pos - k + j JOIN lf g ON g.x = n JOIN lf h ON h.x = k JOIN lf i ON i.x = n - k GROUP BY s.k)""")
      + "SELECT q.k, hits, round(hits / q.k / (pos / n), 6) AS lift, round(p, 6) AS p FROM q JOIN pt ON pt.k = q.k")
def top_k_against_base(t: Tables) -> DataFrame:
    return K.top_k_against_base(labelled(t), "rank_overall", "label", [20, 50, 100]).select("k", "hits", F.round("lift", 6).alias("lift"), F.round("p", 6).alias("p"))


@plan("A35", with_("inst", "pen", more=",\n".join([SCORED, RANKED, LABELLED])) + """SELECT town, count(*) AS n, CAST(sum(label) AS BIGINT) AS hit,
    round(100 * sum(label) / count(*), 4) AS rate FROM lb GROUP BY town HAVING count(*) >= 20 ORDER BY rate DESC, town LIMIT 10""")
def town_rates_top10(t: Tables) -> DataFrame:
    g = labelled(t).groupBy("town").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("hit"))
    return (g.where(F.col("n") >= 20).withColumn("rate", F.round(100 * F.col("hit") / F.col("n"), 4))
            .orderBy(F.desc("rate"), "town").limit(10))


@plan("M12", with_("inst", "pen", more=SCORED + ",\n" + RANKED + f""", nw AS (SELECT rank_overall FROM pen p JOIN rk r ON p.id = r.id
    WHERE p.date >= DATE '{AS_OF}' AND p.severity = 5)""") + """SELECT count(*) AS n, median(rank_overall) AS median_rank,
    count(*) FILTER (rank_overall <= 100) AS top100, count(*) FILTER (rank_overall <= 300) AS top300,
    round(count(*) FILTER (rank_overall <= 100) / (count(*) * 100 / (SELECT count(*) FROM rk)), 6) AS lift100 FROM nw""")
def forward_rank_check(t: Tables) -> DataFrame:
    r = ranked(t).select("id", "rank_overall")
    fresh = R.sanctions(t).where((F.col("date") >= H.day(AS_OF)) & (F.col("severity") == 5)).join(r, "id")
    fresh = fresh.withColumn("_g", F.lit(1))
    population = R.institutions(t).agg(F.count(F.lit(1)).alias("c"))
    counts = fresh.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank_overall") <= 100).alias("top100"),
        F.count_if(F.col("rank_overall") <= 300).alias("top300"))
    med = O.medians(fresh, F.col("rank_overall"), ["_g"], "median_rank").drop("n")
    size = population.scalar()
    return counts.join(med, "_g").select("n", "median_rank", "top100", "top300", F.round(
        F.col("top100") / (F.col("n") * 100 / size), 6).alias("lift100"))


@plan("P22", with_("inst", "pen", "ev", more=SCORED + ",\n" + RANKED + f""", e AS (SELECT id, arg_max(partial, (date, rec)) AS part, max(date) AS d FROM ev
    WHERE date < DATE '{AS_OF}' GROUP BY id), n AS (SELECT id, count(*) AS c FROM pen WHERE date <= DATE '{AS_OF}' AND date >= DATE '{AS_OF}' - 90 GROUP BY id)""")
      + f"""SELECT id, CASE WHEN capacity > 5000 THEN 'registry+sanctions+fees+filings' WHEN kind = 'BUILDING' THEN 'registry+sanctions+fees'
    ELSE 'registry+sanctions' END AS evidence_tier, CASE WHEN capacity > 5000 THEN 'filing checks possible' ELSE 'insufficient data, not low risk'
    END AS data_sufficiency, why AS review_reason, CASE WHEN why <> '' THEN 1 ELSE 0 END AS flagged FROM (SELECT r.*, concat_ws('；',
    CASE WHEN capacity > 9000 THEN 'filing check failed (high)' WHEN capacity > 8000 THEN 'filing check failed' END,
    CASE WHEN part = 1 AND date_diff('day', d, DATE '{AS_OF}') <= 730 THEN 'recent partial evaluation' END,
    CASE WHEN c > 0 THEN 'official event within 90 days' END, CASE WHEN rank_overall <= 100 THEN 'score among the first 100' END) AS why
    FROM rk r LEFT JOIN e ON r.id = e.id LEFT JOIN n ON r.id = n.id)""")
def review_reasons(t: Tables) -> DataFrame:
    ev = H.latest_evaluation(R.evaluations(t), AS_OF)
    recent = ev.select("id", ((F.col("eval_partial") == 1) & (F.col("days_since_evaluation") <= 730)).cast("int").alias("recent_partial"))
    events = H.event_summary(R.sanctions(t).withColumn("type", F.col("role")), AS_OF, ["O", "F", "P"]).select("id", "events_90d")
    d = ranked(t).join(recent, "id", "left").join(events, "id", "left").withColumns({
        "years_checked": (F.col("capacity") > 5000).cast("int"), "has_fees": (F.col("kind") == "BUILDING").cast("int"),
        "failed_high": (F.col("capacity") > 9000).cast("int"), "failed_total": (F.col("capacity") > 8000).cast("int")})
    return K.review_reasons(d, 100).select("id", "evidence_tier", "data_sufficiency", "review_reason", "flagged")


@plan("P31 W24", with_("inst", "pen", more=SCORED + ",\n" + RANKED) + """SELECT id, town, kind, rank_overall, matched FROM (SELECT rk.*, count(*) OVER () AS matched FROM rk JOIN inst USING (id)
    WHERE rk.kind = 'MACHINERY' AND prior > 0 AND contains(title, '#0000001') AND rk.capacity > 5000) ORDER BY prior DESC, rank_overall, id LIMIT 25""")
def institution_filter(t: Tables) -> DataFrame:
    d = ranked(t).join(R.institutions(t).select("id", "title"), "id").withColumn("years_checked", (F.col("capacity") > 5000).cast("int"))
    page, matched = K.filter_institutions(d, name="#0000001", kind="MACHINERY", has_penalty=True, has_financials=True, sort="penalties")
    return page.withColumn("matched", matched.scalar()).select("id", "town", "kind", "rank_overall", "matched")


@plan("P32", with_("inst", "pen", more=SCORED + ",\n" + RANKED) + """SELECT 'district' AS scope, count(*) AS n FROM rk WHERE town = 'NATION_3' UNION ALL
    SELECT 'top_risk', count(*) FROM rk WHERE rank_overall <= 50 UNION ALL SELECT 'compliance_fail', count(*) FROM rk WHERE capacity < 0 UNION ALL
    SELECT 'evaluation', count(*) FROM rk WHERE kind = 'BUILDING' AND prior > 3 UNION ALL SELECT 'city', count(*) FROM rk UNION ALL
    SELECT 'picked', count(*) FROM rk WHERE id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000) UNION ALL
    SELECT 'unknown', count(DISTINCT o_orderkey) FROM orders WHERE o_totalprice > 400000 AND o_orderkey NOT IN (SELECT id FROM rk)""")
def scan_scope_counts(t: Tables) -> DataFrame:
    r = ranked(t).withColumns({"failed_total": (F.col("capacity") < 0).cast("int"),
                               "recent_partial": ((F.col("kind") == "BUILDING") & (F.col("prior") > 3)).cast("int")})
    ids = t.orders.where(F.col("o_totalprice") > 400000).select(F.col("o_orderkey").alias("id"))
    return K.scope_counts(r, ids, "NATION_3", 50)


@plan("P21 D7", with_("pen") + """SELECT f AS feature FROM (SELECT 'fine' AS f, count(fine) FILTER (date < DATE '1998-07-01') AS a, count(fine) AS b FROM pen
    UNION ALL SELECT 'severity', count(severity) FILTER (date < DATE '1998-07-01'), count(severity) FROM pen
    UNION ALL SELECT 'late_fine', count(CASE WHEN date >= DATE '2000-01-01' THEN fine END) FILTER (date < DATE '1998-07-01'), count(fine) FROM pen) WHERE a > 0 AND b > 0""")
def usable_features(t: Tables) -> DataFrame:
    pen = R.sanctions(t).withColumn("late_fine", F.when(F.col("date") >= H.day("2000-01-01"), F.col("fine")))
    names = K.usable_columns(["fine", "severity", "late_fine"], pen.where(F.col("date") < H.day("1998-07-01")), pen)
    return t.spark.createDataFrame([(n,) for n in names], "feature string")


@plan("W22", with_("pen", more="""obs AS (SELECT id, role, make_date(year(date) + 1, 7, 1) AS obs FROM pen WHERE severity = 5),
    k AS (SELECT DISTINCT id, role, obs FROM obs WHERE obs <= DATE '2001-08-01')""") + """SELECT k.id, k.role, k.obs, count(*) FILTER (p.date < k.obs) AS n_prior,
    count(*) FILTER (p.date >= k.obs) AS n_after, min(CASE WHEN p.date >= k.obs THEN p.date END) AS first_after,
    date_diff('day', k.obs, min(CASE WHEN p.date >= k.obs THEN p.date END)) AS lead_days
    FROM k JOIN pen p ON p.id = k.id GROUP BY 1, 2, 3""", wide="lead_days")
def lead_days(t: Tables) -> DataFrame:
    pen = R.sanctions(t)
    findings = pen.where(F.col("severity") == 5).select(
        "id", "role", F.make_date(F.year("date") + 1, F.lit(7), F.lit(1)).alias("obs")).distinct()
    return K.lead_time(findings.where(F.col("obs") <= H.day("2001-08-01")), pen)


@plan("W10", with_("pen", more="y AS (SELECT id, year(date) AS yr, count(*) AS n, max(severity) AS sev FROM pen GROUP BY 1, 2)")
      + """SELECT id, max(yr) AS latest_year, arg_max(n, yr) AS latest_n, arg_max(sev, yr) AS latest_severity,
    string_agg(yr || ':' || n, ',' ORDER BY yr) AS history FROM y GROUP BY id""")
def latest_with_history(t: Tables) -> DataFrame:
    y = R.sanctions(t).groupBy("id", F.year("date").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), F.max("severity").alias("sev"))
    # One entry per year and id: the history is as short as the number of years.
    return y.groupBy("id").agg(
        F.max("yr").cast("long").alias("latest_year"), F.max_by("n", "yr").alias("latest_n"), F.max_by("sev", "yr").alias("latest_severity"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("yr", "n"))),
                                 lambda s: F.concat_ws(":", s["yr"], s["n"])), ",").alias("history"))


@plan("A10 A11", with_("inst", "pen", more=SCORED + ", o AS (SELECT operator, s.* EXCLUDE (kind, town, capacity) FROM inst JOIN sc s USING (id))")
      + """SELECT operator, count(*) AS parks, count(*) FILTER (prior > 0) AS penalised, CAST(sum(prior) AS BIGINT) AS records,
    round(count(*) FILTER (prior > 0) / count(*), 6) AS share FROM o GROUP BY operator""")
def operator_profile(t: Tables) -> DataFrame:
    o = R.institutions(t).select("id", "operator").join(scored(t), "id")
    return o.groupBy("operator").agg(
        F.count(F.lit(1)).alias("parks"), F.count_if(F.col("prior") > 0).alias("penalised"),
        F.sum("prior").alias("records"),
        F.round(C.ratio(F.count_if(F.col("prior") > 0), F.count(F.lit(1))), 6).alias("share"))


@plan("A11", with_("inst", "pen", more=SCORED) + """SELECT kind, count(*) AS entities, count(*) FILTER (hit) AS penalised,
    round(count(*) FILTER (hit) / count(*), 6) AS rate FROM (SELECT kind, town, CAST(round(capacity / 1000) AS BIGINT) AS site, bool_or(prior > 8) AS hit
    FROM sc GROUP BY 1, 2, 3) GROUP BY kind""")
def rates_by_physical_entity(t: Tables) -> DataFrame:
    e = scored(t).groupBy("kind", "town", F.round(F.col("capacity") / 1000).cast("long").alias("site")).agg(
        F.bool_or(F.col("prior") > 8).alias("hit"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("entities"), F.count_if("hit").alias("penalised"),
                                 F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("rate"))
