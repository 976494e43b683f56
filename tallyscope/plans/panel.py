"""Panel, peer and statement queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed
from tallyscope.operators import checks as K
from tallyscope.operators import ordering as O
from tallyscope.operators import peers as P
from tallyscope.operators import statements as S
from tallyscope.plans import roles as R
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import FEATURES, scales_sql, with_

SC = scales_sql("long", "year, feature")
Z = """z AS (SELECT l.entity, l.year, l.feature, l.value, s.n, s.median, s.mad, s.scale, (l.value - s.median) / s.scale AS z
    FROM long l JOIN sc s ON l.year = s.year AND l.feature = s.feature WHERE s.n >= 8)"""


def long_panel(t: Tables) -> DataFrame:
    return P.melt(R.panel_ratios(t), ["entity", "year"], FEATURES)


@plan("W3", with_("panel", "feat", "long", more=SC + ",\n" + Z) + """SELECT entity, year, feature, n, round(median, 6) AS median, round(mad, 6) AS mad,
    round(scale, 6) AS scale, round(z, 6) AS z FROM z""")
def peer_robust_z(t: Tables) -> DataFrame:
    z = P.robust_z(long_panel(t), ["year", "feature"])
    return z.select("entity", "year", "feature", "n", *[F.round(c, 6).alias(c) for c in ("median", "mad", "scale", "z")])


@plan("W4", with_("panel", "feat", "long") + """SELECT entity, year, feature, round(100 * cume_dist() OVER (PARTITION BY year, feature ORDER BY value), 6) AS percentile FROM long""")
def cume_percentile(t: Tables) -> DataFrame:
    d = O.tie_counts(long_panel(t), F.col("value"), ["year", "feature"])
    return d.select("entity", "year", "feature", F.round(100 * F.col("n_upto") / F.col("n_all"), 6).alias("percentile"))


SCORE = """s AS (SELECT entity, year, avg(least(abs(z), 8.0)) AS score, count(z) AS n_features,
    list(feature ORDER BY -abs(z), feature) FILTER (z IS NOT NULL) AS r, list(feature ORDER BY -abs(z), feature) FILTER (abs(z) >= 3.5) AS a FROM z GROUP BY 1, 2)"""


@plan("W5", with_("panel", "feat", "long", more=",\n".join([SC, Z, SCORE])) + """SELECT entity, year, round(score, 6) AS score, n_features,
    array_to_string(r[1:3], ',') AS contributions, coalesce(array_to_string(a, ','), '') AS anomalies FROM s""")
def peer_anomaly_score(t: Tables) -> DataFrame:
    d = P.peer_scores(P.robust_z(long_panel(t), ["year", "feature"]), ["entity", "year"])
    return d.select("entity", "year", F.round("score", 6).alias("score"), "n_features",
                    F.array_join("contributions", ",").alias("contributions"), F.array_join("anomalies", ",").alias("anomalies"))


@plan("W6", with_("panel", "feat", "long", more="""dl AS (SELECT a.entity, a.year, a.feature, a.value - b.value AS value FROM long a JOIN long b
    ON a.entity = b.entity AND a.feature = b.feature AND b.year = (SELECT max(y.year) FROM (SELECT DISTINCT year FROM long) y WHERE y.year < a.year)),
    """ + scales_sql("dl", "year, feature") + """, z AS (SELECT l.entity, l.year, l.feature, (l.value - s.median) / s.scale AS z
    FROM dl l JOIN sc s ON l.year = s.year AND l.feature = s.feature WHERE s.n >= 8)""") + """SELECT entity, year, round(avg(least(abs(z), 8.0)), 6) AS change_score,
    count(z) AS n_features FROM z GROUP BY 1, 2""")
def year_change_score(t: Tables) -> DataFrame:
    d = P.robust_z(P.yearly_changes(long_panel(t), "entity", "year"), ["year", "feature"])
    return P.peer_scores(d, ["entity", "year"]).select("entity", "year", F.round("score", 6).alias("change_score"), "n_features")


@plan("W7", with_("panel", "feat", "long", more=",\n".join([SC, Z, SCORE])) + """SELECT entity, year, rk AS rank_in_year,
    round_even(100.0 * (n - rk) / greatest(n - 1, 1), 1) AS percentile FROM (SELECT entity, year, row_number() OVER (PARTITION BY year ORDER BY score DESC, entity) AS rk,
    count(*) OVER (PARTITION BY year) AS n FROM s WHERE score IS NOT NULL)""")
def rank_percentile_in_year(t: Tables) -> DataFrame:
    d = P.peer_scores(P.robust_z(long_panel(t), ["year", "feature"]), ["entity", "year"])
    return P.percentile_in_group(d, "score", F.col("entity"), ["year"]).select(
        "entity", "year", F.col("rank_in_group").alias("rank_in_year"), "percentile")


EXQ = """e AS (SELECT year, count(*) AS n, list(unit_price ORDER BY unit_price) AS s, median(unit_price) AS med FROM feat WHERE unit_price IS NOT NULL GROUP BY year),
    q AS (SELECT year, n, med, s[j1] * (4 - d1) / 4 + s[j1 + 1] * d1 / 4 AS q1, s[j3] * (4 - d3) / 4 + s[j3 + 1] * d3 / 4 AS q3 FROM (
    SELECT *, least(greatest((n + 1) // 4, 1), n - 1) AS j1, (n + 1) - least(greatest((n + 1) // 4, 1), n - 1) * 4 AS d1,
    least(greatest(3 * (n + 1) // 4, 1), n - 1) AS j3, 3 * (n + 1) - least(greatest(3 * (n + 1) // 4, 1), n - 1) * 4 AS d3 FROM e))"""


@plan("A17", with_("panel", "feat", more=EXQ) + """SELECT q.year, q.n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
    count(*) FILTER (f.unit_price < q1 - 1.5 * (q3 - q1)) AS outliers FROM q JOIN feat f ON f.year = q.year GROUP BY ALL""")
def staffing_exclusive_quartiles(t: Tables) -> DataFrame:
    d = R.panel_ratios(t).where(F.col("unit_price").isNotNull())
    q = O.exclusive_quartiles(d, F.col("unit_price"), ["year"])
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    return (d.join(q, "year").groupBy("year", "n", "q1", "q2", "q3").agg(F.count_if(F.col("unit_price") < low).alias("outliers"))
            .select("year", "n", F.round("q1", 6).alias("q1"), F.round("q2", 6).alias("median"), F.round("q3", 6).alias("q3"), "outliers"))


@plan("A36", with_("panel", "feat", more=EXQ) + """SELECT entity, f.year, round(unit_price, 6) AS unit_price, CASE WHEN unit_price < q1 THEN 'below' WHEN unit_price > q3 THEN 'above' ELSE 'within' END AS position
    FROM feat f JOIN q ON q.year = f.year WHERE unit_price IS NOT NULL""")
def rows_against_benchmark(t: Tables) -> DataFrame:
    d = R.panel_ratios(t).where(F.col("unit_price").isNotNull())
    q = O.exclusive_quartiles(d, F.col("unit_price"), ["year"]).select("year", "q1", "q3")
    place = F.when(F.col("unit_price") < F.col("q1"), "below").when(F.col("unit_price") > F.col("q3"), "above").otherwise("within")
    return d.join(q, "year").select("entity", "year", F.round("unit_price", 6).alias("unit_price"), place.alias("position"))


@plan("A14", with_("panel", "feat") + """SELECT year, count(*) AS total, count(*) FILTER (levy_rate > 0.0401) AS filed, round(median(unit_price), 6) AS median_price,
    round(median(open_share), 6) AS median_open FROM feat GROUP BY year""")
def cohort_coverage(t: Tables) -> DataFrame:
    d = R.panel_ratios(t)
    g = d.groupBy("year").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("levy_rate") > 0.0401).alias("filed"))
    for name, out in (("unit_price", "median_price"), ("open_share", "median_open")):
        g = g.join(O.medians(d, F.col(name), ["year"], out).select("year", F.round(out, 6).alias(out)), "year")
    return g


@plan("A14", with_("panel", "feat", more="m AS (SELECT year, median(unit_price) AS p FROM feat GROUP BY year)")
      + "SELECT min(year) AS first_year, max(year) AS last_year, round(arg_max(p, year) / arg_min(p, year) - 1, 6) AS change FROM m")
def cohort_trend(t: Tables) -> DataFrame:
    m = O.medians(R.panel_ratios(t), F.col("unit_price"), ["year"], "p")
    return m.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                 F.round(F.max_by("p", "year") / F.min_by("p", "year") - 1, 6).alias("change"))


# --- fees -------------------------------------------------------------------

@plan("A4", """SELECT l_orderkey AS code, l_returnflag AS class, round(sum(l_extendedprice * (1 - l_discount)), 4) AS core, round(sum(l_extendedprice * l_tax), 4) AS addons,
    max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS declared, round(max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) - sum(l_extendedprice * (1 - l_discount)), 4) AS diff
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def fee_checksum(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("code"), F.col("l_returnflag").alias("class"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("core"), (F.col("l_extendedprice") * F.col("l_tax")).alias("addon"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("declared"))
    return S.fee_checksum(d, ["code", "class"]).select(
        "code", "class", "declared", *[F.round(c, 4).alias(c) for c in ("core", "addons", "diff")])


@plan("A5", """SELECT code, year, n_semesters, n_ages, y_A, y_N, y_R, CASE WHEN y_A IS NOT NULL OR y_R IS NOT NULL THEN round(coalesce(y_A, 0) + coalesce(y_R, 0), 4) END AS y_core FROM (
    SELECT l_suppkey AS code, year(l_shipdate) AS year, count(DISTINCT CASE WHEN month(l_shipdate) <= 6 THEN 'a' ELSE 'b' END) AS n_semesters, count(DISTINCT l_linenumber) AS n_ages,
    round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) * 2, 4) AS y_A, round(avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) * 2, 4) AS y_N,
    round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) * 2, 4) AS y_R FROM lineitem GROUP BY 1, 2)""", wide="year")
def fee_basis_year(t: Tables) -> DataFrame:
    fees = t.lineitem.select(
        F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("year"), F.when(F.month("l_shipdate") <= 6, "a").otherwise("b").alias("semester"),
        F.col("l_linenumber").alias("age"), F.col("l_returnflag").alias("item"), F.col("l_quantity").alias("amount"))
    d = S.fee_basis(fees, ["code", "year"], ["A", "N", "R"], {"core": ["A", "R"]})
    return d.withColumn("y_core", F.round("y_core", 4))


@plan("A6", """WITH s AS (SELECT l_suppkey AS code, year(l_shipdate) AS y, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1, 2)
    SELECT code, y, v AS fee, round(max(j) OVER (PARTITION BY code), 4) AS max_jump_pct FROM (
    SELECT a.code, a.y, a.v, (a.v - b.v) / b.v * 100 AS j FROM s a LEFT JOIN s b ON a.code = b.code AND b.y = a.y - 1)""")
def fee_max_jump(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("code"), F.year("l_shipdate").cast("long").alias("y")).agg(F.round(F.avg("l_extendedprice"), 4).alias("v"))
    d = S.yearly_jump(s, "code", "y", "v")
    years = [c for c in d.columns if c.startswith("fee_")]
    fees = F.filter(F.array(*[F.struct(F.lit(int(c[4:])).cast("long").alias("y"), F.col(c).alias("v")) for c in years]), lambda x: x["v"].isNotNull())
    return d.select("code", F.explode(fees).alias("f"), F.round("max_jump_pct", 4).alias("max_jump_pct")).select("code", "f.y", F.col("f.v").alias("fee"), "max_jump_pct")


POS = "(l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def position() -> Column:
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@plan("A7", f"""SELECT * FROM (SELECT l_orderkey AS code, arg_max(l_extendedprice, {POS}) FILTER (l_returnflag = 'A') AS parent, arg_max(l_extendedprice, {POS}) FILTER (l_returnflag = 'R') AS gov,
    arg_min(l_extendedprice, {POS}) FILTER (l_returnflag = 'N') AS subtotal FROM lineitem GROUP BY 1) WHERE parent IS NOT NULL AND gov IS NOT NULL""")
def split_extraction(t: Tables) -> DataFrame:
    part = F.when(F.col("l_returnflag") == "A", "parent").when(F.col("l_returnflag") == "R", "gov").otherwise("subtotal")
    d = t.lineitem.withColumns({"code": F.col("l_orderkey"), "part": part, "value": F.col("l_extendedprice")})
    return S.two_sided_split(d, ["code"], position())


@plan("A8", f"""SELECT code, year, round(sum(v), 4) AS total FROM (SELECT l_suppkey AS code, year(l_shipdate) AS year, l_linenumber, month(l_shipdate) AS m, arg_min(l_extendedprice, {POS.replace('(l_', '(l_orderkey, l_')}) AS v
    FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""", wide="year")
def agency_totals(t: Tables) -> DataFrame:
    d = t.lineitem.where(F.col("l_returnflag") == "N").select(
        F.col("l_suppkey").alias("code"), F.year("l_shipdate").alias("year"), "l_linenumber", F.month("l_shipdate").alias("m"), "l_extendedprice",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"))
    return S.total_once(d, ["l_linenumber", "m"], ["code", "year"], "l_extendedprice", F.col("pos")).withColumn("total", F.round("total", 4))


# --- page tables and facts --------------------------------------------------

def page_tables(t: Tables) -> DataFrame:
    full = F.array("l_quantity", "l_extendedprice", F.when(F.col("l_discount") != 0, F.col("l_discount")), "l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("section"),
        F.year("l_shipdate").alias("period"), F.array(*[F.lit(x) for x in ("qty", "price", "discount", "tax")]).alias("labels"),
        F.when(F.col("l_tax") == 0, F.slice(full, 1, 3)).otherwise(full).alias("cells"))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "section", "period"]
FACT = """fact AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag AS section, year(l_shipdate) AS period, u.* FROM lineitem, LATERAL (
    SELECT 'qty' AS item, l_quantity AS value UNION ALL SELECT 'price', l_extendedprice UNION ALL SELECT 'discount', CASE WHEN l_discount <> 0 THEN l_discount END
    UNION ALL SELECT 'tax', l_tax) u WHERE l_tax <> 0 AND u.value IS NOT NULL)"""


@plan("S7", with_(more=FACT) + "SELECT l_orderkey, l_linenumber, l_partkey, section, period, item, value FROM fact", wide="period")
def facts_long(t: Tables) -> DataFrame:
    return S.page_facts(page_tables(t), KEYS)[0].select("l_orderkey", "l_linenumber", "l_partkey", "section", "period", "item", "value")


@plan("S7 A22", with_(more=FACT) + """SELECT r.l_suppkey AS code, r.tables, r.refused, coalesce(f.valued, 0) AS valued, (r.tables - r.refused) * 4 - coalesce(f.valued, 0) AS blank,
    coalesce(n_a, 0) AS n_a, coalesce(n_n, 0) AS n_n, coalesce(n_r, 0) AS n_r FROM (SELECT l_suppkey, count(*) AS tables, count(*) FILTER (l_tax = 0) AS refused FROM lineitem GROUP BY 1) r LEFT JOIN (
    SELECT l_suppkey, count(*) AS valued, count(*) FILTER (section = 'A') AS n_a, count(*) FILTER (section = 'N') AS n_n, count(*) FILTER (section = 'R') AS n_r FROM fact GROUP BY 1) f ON f.l_suppkey = r.l_suppkey""")
def report_statistics(t: Tables) -> DataFrame:
    aligned = F.size("labels") == F.size("cells")
    valued = F.when(aligned, F.size(F.array_compact("cells"))).otherwise(0)
    return page_tables(t).groupBy(F.col("l_suppkey").alias("code")).agg(
        F.count(F.lit(1)).alias("tables"), F.count_if(~aligned).alias("refused"), F.sum(valued).alias("valued"),
        F.sum(F.when(aligned, F.size("cells") - valued).otherwise(0)).alias("blank"),
        *[F.sum(F.when(F.col("section") == s, valued).otherwise(0)).alias(f"n_{s.lower()}") for s in "ANR"])


@plan("A9", with_(more=FACT) + """SELECT l_suppkey AS code, period AS year, count(DISTINCT section) AS n_sections, arg_min(value, p) FILTER (item = 'qty') AS qty,
    arg_min(value, p) FILTER (item = 'discount') AS discount, arg_min(value, p) FILTER (item = 'tax') AS tax FROM (SELECT *, (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS p FROM fact) GROUP BY 1, 2""", wide="year")
def facts_wide(t: Tables) -> DataFrame:
    facts = S.page_facts(page_tables(t), KEYS)[0].withColumns({"code": F.col("l_suppkey"), "year": F.col("period")})
    return S.wide_facts(facts, ["code", "year"], ["qty", "discount", "tax"], F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


@plan("P19", """SELECT *, CASE WHEN coalesce(p_a,0) + coalesce(p_n,0) + coalesce(p_r,0) <> 0 THEN round(coalesce(p_a,0) + coalesce(p_n,0) + coalesce(p_r,0), 4) END AS pay_total,
    round(p_a / nullif(coalesce(p_a,0) + coalesce(p_n,0) + coalesce(p_r,0), 0), 6) AS share_a FROM (SELECT l_orderkey AS code,
    round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice * l_tax END), 4) AS p_a, round(sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice * l_tax END), 4) AS p_n,
    round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_tax END), 4) AS p_r FROM lineitem GROUP BY 1)""")
def wide_ratios(t: Tables) -> DataFrame:
    pay = F.col("l_extendedprice") * F.col("l_tax")
    d = t.lineitem.groupBy(F.col("l_orderkey").alias("code")).agg(
        *[F.round(F.sum(F.when(F.col("l_returnflag") == s, pay)), 4).alias(f"p_{s.lower()}") for s in "ANR"])
    total = C.any_sum(F.col("p_a"), F.col("p_n"), F.col("p_r"))
    return d.withColumn("pay_total", F.when(total != 0, F.round(total, 4))).withColumn("share_a", F.round(C.ratio(F.col("p_a"), total), 6))


LINE = """ln AS (SELECT l_orderkey AS code, l_returnflag || ' ' || l_linestatus AS label, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CASE WHEN l_tax <> 0 THEN l_extendedprice END AS budget,
    CASE WHEN l_discount <> 0 THEN l_extendedprice * (1 - l_discount) END AS actual FROM lineitem),
    fl AS (SELECT code,
    list({'b': budget, 'a': actual} ORDER BY pos) FILTER (label = 'A F') AS af, list({'b': budget, 'a': actual} ORDER BY pos) FILTER (label = 'A O') AS ao,
    list({'b': budget, 'a': actual} ORDER BY pos) FILTER (label = 'R F') AS rf, list({'b': budget, 'a': actual} ORDER BY pos) FILTER (label = 'N F') AS nf,
    sum(CASE WHEN budget IS NULL AND label NOT LIKE 'N%' THEN actual END) AS unb FROM ln GROUP BY code)"""


def statement_lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("code"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("label"), position().alias("pos"),
        F.when(F.col("l_tax") != 0, F.col("l_extendedprice")).alias("budget"),
        F.when(F.col("l_discount") != 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual"))


@plan("P13 J22", with_(more=LINE) + "SELECT code, af[1].b AS af_budget, round(af[1].a, 4) AS af_actual, nf[1].b AS nf_budget, round(nf[1].a, 4) AS nf_actual FROM fl")
def first_matching_line(t: Tables) -> DataFrame:
    d = S.first_lines(statement_lines(t), ["code"], F.col("label"), F.col("pos"), {"af": "AF", "nf": "NF"}, ["budget", "actual"])
    return d.select("code", *[(F.round(F.col(n)[v], 4) if v == "actual" else F.col(n)[v]).alias(f"{n}_{v}")
                              for n in ("af", "nf") for v in ("budget", "actual")])


@plan("P15 A23", with_(more=LINE + """, x AS (SELECT fl.*, o_totalprice AS cash, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice * 0.8 END AS prepaid, af[1].b AS ra, af[1].a AS rl,
    CASE WHEN af[1].b <> 0 THEN coalesce(af[1].a, 0) / af[1].b END AS e1, CASE WHEN ao[1].b <> 0 THEN coalesce(ao[1].a, 0) / ao[1].b END AS e2,
    CASE WHEN rf[1].b <> 0 THEN coalesce(rf[1].a, 0) / rf[1].b END AS e3 FROM fl JOIN orders ON o_orderkey = fl.code)""") + """SELECT code, round(cash / nullif(prepaid, 0), 6) AS prepaid_coverage,
    round(rl - ra, 4) AS reserve_funding_gap, round(e1, 6) AS af_execution, round(e2, 6) AS ao_execution, round(e3, 6) AS admin_execution,
    round(e3 - (coalesce(e1, 0) + coalesce(e2, 0)) / nullif((CASE WHEN e1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN e2 IS NULL THEN 0 ELSE 1 END), 0), 6) AS related_party_priority,
    round(CASE WHEN nf[1].a <> 0 THEN nf[1].a / 30 END, 6) AS cost_per_child, round(CASE WHEN unb <> 0 THEN unb END, 4) AS unbudgeted_spend FROM x""")
def forensic_signals(t: Tables) -> DataFrame:
    ln = statement_lines(t)
    d = S.first_lines(ln, ["code"], F.col("label"), F.col("pos"), {"af": "AF", "ao": "AO", "rf": "RF", "nf": "NF"}, ["budget", "actual"])
    loose = ln.groupBy("code").agg(S.unbudgeted(F.col("label"), F.col("budget"), F.col("actual"), ["N"]).alias("unbudgeted_spend"))
    o = t.orders.select(F.col("o_orderkey").alias("code"), F.col("o_totalprice").alias("cash"),
                        F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice") * 0.8).alias("prepaid"))
    d = d.join(loose, "code").join(o, "code").withColumns({
        "reserve_asset": F.col("af.budget"), "reserve_liability": F.col("af.actual"), "accumulated_surplus": F.lit(None).cast("double"),
        "current_surplus": F.col("cash"), "actual_enrolment": F.lit(30.0), "approved_capacity": F.lit(40.0), "educators": F.lit(3.0)})
    s = S.forensic_signals(d, ["af", "ao"], "rf", "nf")
    return s.select("code", *[F.round(c, 6).alias(c) for c in ("prepaid_coverage", "af_execution", "ao_execution", "admin_execution",
                                                               "related_party_priority", "cost_per_child")],
                    F.round("reserve_funding_gap", 4).alias("reserve_funding_gap"), F.round("unbudgeted_spend", 4).alias("unbudgeted_spend"))


# --- identities -------------------------------------------------------------

@plan("R10", """SELECT code, identity, CASE WHEN l IS NULL OR r IS NULL THEN 'skipped' WHEN abs(l - r) <= 5000 THEN 'passed' ELSE 'failed' END AS status FROM (
    SELECT o_orderkey AS code, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS total, p, q, a, b FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p, sum(l_extendedprice * (1 - l_discount)) AS q,
    sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS a, sum(CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) s,
    LATERAL (SELECT 'total_is_gross' AS identity, total AS l, p AS r UNION ALL SELECT 'total_is_net', total, q UNION ALL SELECT 'gross_is_parts', p, a + b) u""")
def accounting_identities(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("code")).agg(
        F.sum(price).alias("p"), F.sum(price * (1 - F.col("l_discount"))).alias("q"), F.sum(F.when(F.col("l_returnflag") == "A", price)).alias("a"),
        F.sum(F.when(F.col("l_returnflag") != "A", price)).alias("b"))
    d = t.orders.select(F.col("o_orderkey").alias("code"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("total")).join(a, "code", "left")
    c = F.col
    return S.nonempty_identities(d, {"total_is_gross": (c("total"), c("p")), "total_is_net": (c("total"), c("q")),
                                     "gross_is_parts": (c("p"), c("a") + c("b"))}, ["code"], 5000.0)


@plan("R12 R11", with_("panel", more="r AS (SELECT entity, year, gross AS closing, CASE WHEN n_lines > 75 THEN gross - net END AS opening, net AS surplus, levy AS remit FROM panel)") + """
    SELECT a.entity, a.year, CASE WHEN a.opening IS NULL THEN 'skipped' WHEN abs(a.closing - (a.opening + a.surplus - 0)) <= 1 THEN 'passed' ELSE 'failed' END AS roll_forward,
    CASE WHEN a.opening IS NULL OR b.closing IS NULL THEN 'skipped' WHEN abs(a.opening - b.closing) <= 1 THEN 'passed' ELSE 'failed' END AS opening_is_prior_closing FROM r a LEFT JOIN r b ON a.entity = b.entity AND b.year + 1 = a.year""")
def fund_roll_forward(t: Tables) -> DataFrame:
    r = R.panel(t).select("entity", "year", F.col("gross").alias("closing"),
                          F.when(F.col("n_lines") > 75, F.col("gross") - F.col("net")).alias("opening"), F.col("net").alias("surplus"))
    before = r.select("entity", (F.col("year") + 1).alias("year"), F.col("closing").alias("prior_closing"))
    d = r.join(before, ["entity", "year"], "left")
    return d.select("entity", "year", K.identity_status(F.col("closing"), F.col("opening") + F.col("surplus")).alias("roll_forward"),
                    K.identity_status(F.col("opening"), F.col("prior_closing")).alias("opening_is_prior_closing"))


@plan("R11", """SELECT a.l_orderkey AS code, CASE WHEN op IS NULL OR n IS NULL THEN 'skipped' WHEN abs(n - op) <= 0.01 THEN 'passed' ELSE 'failed' END AS row_sum,
    CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN abs(o_totalprice - n) <= 0.01 THEN 'passed' ELSE 'failed' END AS cash_equals_main FROM (SELECT l_orderkey,
    CASE WHEN count(*) FILTER (l_linestatus = 'O') = 1 THEN max(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) END AS n, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS op
    FROM lineitem GROUP BY 1) a JOIN orders ON o_orderkey = l_orderkey WHERE n IS NOT NULL""")
def supplement_reconciliation(t: Tables) -> DataFrame:
    price, is_net = F.col("l_extendedprice"), F.col("l_linestatus") == "O"
    d = t.lineitem.groupBy("l_orderkey").agg(
        F.when(F.count_if(is_net) == 1, F.max(F.when(is_net, price))).alias("n"), F.sum(F.when(~is_net, price)).alias("op"))
    d = d.where(F.col("n").isNotNull()).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    main = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return d.select(F.col("l_orderkey").alias("code"), K.identity_status(F.col("n"), F.col("op"), 0.01).alias("row_sum"),
                    K.identity_status(main, F.col("n"), 0.01, required=True).alias("cash_equals_main"))


@plan("R14", """SELECT l_orderkey, l_linenumber, l_partkey, '收入|數量' AS labels, l_extendedprice AS amount, l_quantity AS qty, l_discount AS amount_pct, l_tax AS qty_pct FROM lineitem""")
def percent_columns(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                          F.array(*[F.lit(x) for x in ("收入", "收入%", "數量", "數量(占比)％")]).alias("labels"),
                          F.array("l_extendedprice", "l_discount", "l_quantity", "l_tax").alias("cells"))
    s = S.spread_percent_columns(d)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("labels", "|").alias("labels"), F.get("cells", F.lit(0)).alias("amount"),
                    F.get("cells", F.lit(1)).alias("qty"), F.get("percents", F.lit(0)).alias("amount_pct"), F.get("percents", F.lit(1)).alias("qty_pct"))


# --- panel models -----------------------------------------------------------

@plan("M10", with_("panel", "feat", more="p AS (SELECT a.entity, a.year, a.unit_price, a.open_share, CASE WHEN b.levy_rate > 0.0401 THEN 1 ELSE 0 END AS y FROM feat a JOIN feat b ON a.entity = b.entity AND b.year = a.year + 1)")
      + "SELECT year, count(*) AS pairs, CAST(sum(y) AS BIGINT) AS positives, round(count(unit_price) / count(*), 6) AS coverage FROM p GROUP BY year")
def temporal_pairs(t: Tables) -> DataFrame:
    f = R.panel_ratios(t)
    nxt = f.select("entity", (F.col("year") - 1).alias("year"), (F.col("levy_rate") > 0.0401).cast("int").alias("y"))
    return f.join(nxt, ["entity", "year"]).groupBy("year").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("y").alias("positives"), F.round(F.count("unit_price") / F.count(F.lit(1)), 6).alias("coverage"))


@plan("M9", with_("panel", "feat", "long", more=",\n".join([SC, Z]) + """, dr AS (SELECT f.feature AS dropped, z.* FROM z, (SELECT DISTINCT feature FROM long) f WHERE z.feature <> f.feature),
    a AS (SELECT entity, year, avg(least(abs(z), 8.0)) AS s0 FROM z GROUP BY 1, 2), b AS (SELECT dropped, entity, year, avg(least(abs(z), 8.0)) AS s1 FROM dr GROUP BY 1, 2, 3),
    r AS (SELECT dropped, rank() OVER (PARTITION BY dropped ORDER BY s0) AS r0, rank() OVER (PARTITION BY dropped ORDER BY s1) AS r1,
    count(*) OVER (PARTITION BY dropped, s0) AS c0, count(*) OVER (PARTITION BY dropped, s1) AS c1 FROM a JOIN b USING (entity, year))""")
      + "SELECT dropped, round(corr(r0 + (c0 - 1) / 2, r1 + (c1 - 1) / 2), 6) AS spearman FROM r GROUP BY dropped")
def feature_drop_spearman(t: Tables) -> DataFrame:
    from tallyscope.session import cut_lineage
    z = cut_lineage(P.robust_z(long_panel(t), ["year", "feature"]).select("entity", "year", "feature", "z"))
    capped = F.least(F.abs(F.col("z")), F.lit(fixed.Z_CAP))
    base = z.groupBy("entity", "year").agg(F.avg(capped).alias("s0"))
    # Each row goes to every drop round but its own feature's: features - 1 copies.
    rounds = z.select("*", F.explode(F.array(*[F.lit(f) for f in FEATURES])).alias("dropped")).where(F.col("dropped") != F.col("feature"))
    d = rounds.groupBy("dropped", "entity", "year").agg(F.avg(capped).alias("s1")).join(base, ["entity", "year"])
    d = O.tie_counts(cut_lineage(d), F.col("s0"), ["dropped"], "b0", "u0", "n0")
    d = O.tie_counts(d, F.col("s1"), ["dropped"], "b1", "u1", "n1")
    return d.groupBy("dropped").agg(F.round(F.corr((F.col("b0") + 1 + F.col("u0")) / 2, (F.col("b1") + 1 + F.col("u1")) / 2), 6).alias("spearman"))
