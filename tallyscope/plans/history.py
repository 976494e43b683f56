"""Point-in-time feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed
from tallyscope.operators import history as H
from tallyscope.operators import ordering as O
from tallyscope.plans import roles as R
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import AS_OF, with_

HIST = f"""hist AS (SELECT id, count(*) AS n_penalties_prior, coalesce(sum(fine), 0) AS total_fine_prior,
    count(*) FILTER (fine IS NULL) AS n_nonmonetary_prior, count(*) FILTER (role = 'O') AS n_responsible_prior,
    count(*) FILTER (role = 'F') AS n_individual_prior, max(severity) AS max_severity_prior,
    sum(severity) AS sum_severity_prior, count(*) FILTER (severity >= 4) AS n_severe_prior,
    date_diff('day', max(date), DATE '{AS_OF}') AS days_since_last_penalty
    FROM pen WHERE date < DATE '{AS_OF}' GROUP BY id)"""
LATEST = f"""latest AS (SELECT id, arg_max(partial, (date, rec)) AS eval_partial, max(date) AS eval_date,
    count(*) AS n_evaluations_prior, sum(partial) AS n_partial_prior,
    date_diff('day', max(date), DATE '{AS_OF}') AS days_since_evaluation
    FROM ev WHERE date < DATE '{AS_OF}' GROUP BY id)"""
FLEET = f"""fleet AS (SELECT id, count(*) AS n_assets,
    round(date_diff('day', min(built), DATE '{AS_OF}') / 365.25, 2) AS oldest_asset_years
    FROM asset WHERE state = 'active' AND (built IS NULL OR built <= DATE '{AS_OF}') GROUP BY id)"""


@plan("A1", with_("pen") + "SELECT id, n_penalties_prior, round(total_fine_prior, 2) AS total_fine_prior, "
      "n_nonmonetary_prior, n_responsible_prior, n_individual_prior, max_severity_prior, "
      "CAST(sum_severity_prior AS BIGINT) AS sum_severity_prior, n_severe_prior, days_since_last_penalty "
      f"FROM ({HIST[9:-1]})", wide="days_since_last_penalty")
def penalty_history_asof(t: Tables) -> DataFrame:
    return H.penalty_history(R.sanctions(t), AS_OF, None, "O", "F").withColumn(
        "total_fine_prior", F.round("total_fine_prior", 2))


@plan("A1", with_("pen") + f"""SELECT id, count(*) AS n, round(coalesce(sum(fine), 0), 2) AS fines FROM pen
    WHERE date < DATE '{AS_OF}' AND date >= DATE '{AS_OF}' - INTERVAL 2 YEAR GROUP BY id""")
def penalty_history_lookback(t: Tables) -> DataFrame:
    return H.penalty_history(R.sanctions(t), AS_OF, 2, "O", "F").select(
        "id", F.col("n_penalties_prior").alias("n"), F.round("total_fine_prior", 2).alias("fines"))


@plan("M1", with_("inst", "pen") + """SELECT id, CASE WHEN id IN (SELECT id FROM pen WHERE date >= DATE '1999-07-01'
    AND date < DATE '2000-07-01' AND severity >= 3 AND role IN ('O', 'F')) THEN 1 ELSE 0 END AS label FROM inst""")
def future_penalty_label(t: Tables) -> DataFrame:
    return H.future_label(R.institutions(t).select("id"), R.sanctions(t), AS_OF, "2000-07-01", 3, ["O", "F"])


@plan("J2", with_("ev") + f"""SELECT id, eval_partial, eval_date, n_evaluations_prior,
    CAST(n_partial_prior AS BIGINT) AS n_partial_prior, days_since_evaluation FROM ({LATEST[11:-1]})""", wide="days_since_evaluation")
def latest_evaluation_asof(t: Tables) -> DataFrame:
    return H.latest_evaluation(R.evaluations(t), AS_OF)


@plan("A2", with_("asset") + f"SELECT * FROM ({FLEET[10:-1]})")
def fleet_features_asof(t: Tables) -> DataFrame:
    return H.fleet_features(R.assets(t), AS_OF, "1999-01-01")


@plan("A3", with_("inst", "pen", more=f"""cnt AS (SELECT id, count(*) AS n FROM pen WHERE date < DATE '{AS_OF}' AND role = 'O' GROUP BY id),
    pr AS (SELECT i.id, i.kind AS op, i.id AS parent, coalesce(c.n, 0) AS own FROM inst i LEFT JOIN cnt c ON i.id = c.id)""")
      + """SELECT id, count(*) OVER w - 1 AS op_siblings, CAST(sum(own) OVER w - own AS BIGINT) AS op_sibling_penalties,
    round((sum(own) OVER w - own) / nullif(count(*) OVER w - 1, 0), 6) AS op_sibling_rate
    FROM (SELECT p.id, i.operator, p.own FROM pr p JOIN inst i ON p.id = i.id) WINDOW w AS (PARTITION BY operator)""")
def leave_one_out_group_rate(t: Tables) -> DataFrame:
    inst = R.institutions(t).withColumn("parent", F.col("id"))
    return H.sibling_rates(inst, R.sanctions(t), AS_OF, "O").withColumn(
        "op_sibling_rate", F.round("op_sibling_rate", 6))


FEATURES_SQL = with_("inst", "pen", "ev", "asset", more=",\n".join([HIST, LATEST, FLEET]))


@plan("J1 A1 A2 J2 W1", FEATURES_SQL + """SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sum_severity_prior DESC, id)
    AS rank_in_kind FROM (SELECT i.id, i.kind, i.town, round(i.capacity, 2) AS capacity,
    coalesce(n_penalties_prior, 0) AS n_penalties_prior, round(coalesce(total_fine_prior, 0), 2) AS total_fine_prior,
    coalesce(n_nonmonetary_prior, 0) AS n_nonmonetary_prior, coalesce(max_severity_prior, 0) AS max_severity_prior,
    CAST(coalesce(sum_severity_prior, 0) AS BIGINT) AS sum_severity_prior, coalesce(n_severe_prior, 0) AS n_severe_prior,
    days_since_last_penalty, eval_partial, coalesce(n_evaluations_prior, 0) AS n_evaluations_prior,
    days_since_evaluation, CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS has_evaluation,
    coalesce(n_assets, 0) AS n_assets, oldest_asset_years,
    CASE WHEN n_penalties_prior > 0 THEN 1 ELSE 0 END AS has_prior_penalty
    FROM inst i LEFT JOIN hist h ON i.id = h.id LEFT JOIN latest l ON i.id = l.id LEFT JOIN fleet f ON i.id = f.id)""", wide="days_since_last_penalty days_since_evaluation")
def features_asof(t: Tables) -> DataFrame:
    d = H.build_features(R.institutions(t), R.sanctions(t), R.assets(t), R.evaluations(t), AS_OF,
                         "1999-01-01", "O", "F")
    d = d.select("id", "kind", "town", F.round("capacity", 2).alias("capacity"), "n_penalties_prior",
                 F.round("total_fine_prior", 2).alias("total_fine_prior"), "n_nonmonetary_prior",
                 "max_severity_prior", "sum_severity_prior", "n_severe_prior", "days_since_last_penalty",
                 "eval_partial", "n_evaluations_prior", "days_since_evaluation", "has_evaluation",
                 "n_assets", "oldest_asset_years", "has_prior_penalty")
    return O.row_number(d, F.col("sum_severity_prior"), F.col("id"), ["kind"], "rank_in_kind", descending=True)


@plan("A13 X4", with_("pen") + f"""SELECT id, count(*) FILTER (role IN ('F', 'P') AND date >= DATE '{AS_OF}' - 90) AS events_90d,
    count(*) FILTER (role IN ('F', 'P') AND date >= DATE '{AS_OF}' - 365) AS events_365d,
    arg_max(role, (date, rec)) AS latest_event_type, max(date) AS latest_event_date
    FROM pen WHERE date <= DATE '{AS_OF}' GROUP BY id""")
def event_summary(t: Tables) -> DataFrame:
    return H.event_summary(R.sanctions(t).withColumn("type", F.col("role")), AS_OF, ["F", "P"])


@plan("A18 X4", """WITH w AS (SELECT user_id AS id, CAST(ts AS DATE) AS d, CASE WHEN event_type = 'signup' THEN NULL
    ELSE event_type END AS kind, event_type AS cat, date_diff('day', CAST(ts AS DATE), DATE '2024-01-25') AS age FROM events),
    x AS (SELECT *, CASE WHEN coalesce(kind, '') = 'view' OR age < 0 THEN 0.0 WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.6
    WHEN age <= 90 THEN 0.3 WHEN age <= 365 THEN 0.1 ELSE 0.0 END AS wt FROM w),
    g AS (SELECT id, count(*) FILTER (wt > 0) AS n, CAST(round(sum(wt), 2) AS DOUBLE) AS score, count(*) FILTER (kind IS NULL) AS unclassified,
    count(*) AS total, max(CASE WHEN wt > 0 THEN d END) AS latest, min(CASE WHEN wt > 0 AND cat IN ('error', 'purchase', 'click')
    THEN CASE cat WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END END) AS p FROM x GROUP BY id)
    SELECT id, n, score, unclassified, total, latest, CASE WHEN score >= 2 THEN 3 WHEN score >= 0.6 THEN 2 WHEN score > 0 THEN 1
    ELSE 0 END AS tier, CASE p WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'click' END AS category FROM g""")
def recency_heat(t: Tables) -> DataFrame:
    items = t.events.select(
        F.col("user_id").alias("id"), F.to_date("ts").alias("date"), F.col("event_type").alias("category"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("kind"))
    return H.recency_heat(items, "2024-01-25", "view", ["error", "purchase", "click"],
                          fixed.RECENCY_STEPS, fixed.HEAT_TIERS)


@plan("P1 P20", with_("pen", more=f"h AS (SELECT id, max(severity) AS sev, max(date) AS last FROM pen "
                      f"WHERE date < DATE '{AS_OF}' GROUP BY id)") + f"""SELECT c_custkey AS id,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS is_private,
    coalesce(date_diff('day', last, DATE '{AS_OF}'), 9999) AS days_since_last_penalty FROM customer LEFT JOIN h ON id = c_custkey""", wide="days_since_last_penalty")
def prepared_frame(t: Tables) -> DataFrame:
    hist = H.penalty_history(R.sanctions(t), AS_OF, None, "O", "F").select("id", "days_since_last_penalty")
    return t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment").join(hist, "id", "left").select(
        "id", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("is_private"),
        F.coalesce("days_since_last_penalty", F.lit(fixed.NEVER_DAYS)).alias("days_since_last_penalty"))


@plan("P1", """SELECT o_orderkey AS rec, a.article, CASE a.article WHEN 33 THEN 5 WHEN 30 THEN 4 WHEN 32 THEN 4 WHEN 12 THEN 4
    WHEN 16 THEN 3 WHEN 17 THEN 3 WHEN 29 THEN 3 WHEN 26 THEN 3 WHEN 31 THEN 3 WHEN 41 THEN 1 WHEN 42 THEN 1 WHEN 48 THEN 1
    ELSE 2 END AS severity, CASE a.article WHEN 8 THEN '設立許可/負責人' WHEN 12 THEN '教保服務禁止規定' WHEN 15 THEN '教職員資料未報備查'
    WHEN 16 THEN '教保人員進用/資格' WHEN 17 THEN '未辦理停聘' WHEN 26 THEN '設施設備' WHEN 29 THEN '負責人/董監事資格'
    WHEN 30 THEN '安全管理規範未落實' WHEN 31 THEN '幼童專用車' WHEN 32 THEN '安全事件' WHEN 33 THEN '不當對待幼兒'
    WHEN 38 THEN '收費未報備查/超收' WHEN 41 THEN '其他行政義務' WHEN 42 THEN '未訂書面契約' WHEN 43 THEN '收費超收'
    WHEN 48 THEN '課後照顧違規' ELSE '其他' END AS category
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice / 10000) AS INTEGER) END AS article
    FROM orders) a""")
def article_taxonomy(t: Tables) -> DataFrame:
    article = F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 10000).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("rec"), article.alias("article")).select(
        "rec", "article", C.article_severity(F.col("article")).alias("severity"),
        C.article_category(F.col("article")).alias("category"))
