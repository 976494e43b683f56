"""Identity, attribution, crosswalk and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.functions import fixed
from tallyscope.operators import history as H
from tallyscope.operators import identity as I
from tallyscope.operators import reconcile as Q
from tallyscope.operators.containment import contains_pairs
from tallyscope.plans import roles as R
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import with_

# --- row-wise parsing of texts derived from orders and parts -----------------

PUNISH = """pu AS (SELECT o_orderkey AS rec, CASE o_orderstatus WHEN 'F' THEN '處' || CAST(round(o_totalprice) AS BIGINT) || ' 元罰鍰' WHEN 'O' THEN '停止招生6個月' ELSE '停辦1年' END AS punishment,
    CASE WHEN o_orderpriority LIKE '1%' THEN '負責人：' || o_custkey WHEN o_orderpriority LIKE '2%' THEN '行為人: ' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS actor,
    '幼照法第' || (o_custkey % 60) || '條' || CASE WHEN o_orderpriority LIKE '3%' THEN '第2項' ELSE '' END AS law, o_orderstatus, o_custkey, o_orderpriority FROM orders)"""


def punishments(t: Tables) -> DataFrame:
    status, who = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    prio = F.substring("o_orderpriority", 1, 1)
    return t.orders.select(
        F.col("o_orderkey").alias("rec"), "o_custkey",
        F.when(status == "F", F.concat(F.lit("處"), F.round("o_totalprice").cast("long").cast("string"), F.lit(" 元罰鍰")))
        .when(status == "O", "停止招生6個月").otherwise("停辦1年").alias("punishment"),
        F.when(prio == "1", F.concat(F.lit("負責人："), who)).when(prio == "2", F.concat(F.lit("行為人: "), who)).otherwise(who).alias("actor"),
        F.concat(F.lit("幼照法第"), (F.col("o_custkey") % 60).cast("string"), F.lit("條"), F.when(prio == "3", "第2項").otherwise("")).alias("law"))


@plan("P3 P4 P7", with_(more=PUNISH) + """SELECT rec, CASE o_orderstatus WHEN 'F' THEN 'fine' WHEN 'O' THEN 'stop_enrollment' ELSE 'operation_suspended' END AS form,
    CAST(nullif(regexp_extract(punishment, '([0-9,]+) *元', 1), '') AS BIGINT) AS amount, CASE WHEN o_orderpriority LIKE '1%' THEN '負責人' WHEN o_orderpriority LIKE '2%' THEN '行為人' ELSE 'unknown' END AS role,
    CAST(o_custkey AS VARCHAR) AS name, CAST(o_custkey % 60 AS VARCHAR) AS article, CASE WHEN o_orderpriority LIKE '3%' THEN '2' ELSE '' END AS paragraph FROM pu""")
def sanction_text_parse(t: Tables) -> DataFrame:
    role, name = C.actor_parts(F.col("actor"))
    article, paragraph = C.citation(F.col("law"))
    return punishments(t).select("rec", C.sanction_form(F.col("punishment")).alias("form"), C.fine_amount(F.col("punishment")).alias("amount"),
                                 role.alias("role"), name.alias("name"), article.alias("article"), paragraph.alias("paragraph"))


TITLE = """ti AS (SELECT p_partkey AS id, '新北市' || p_name || '幼兒園' || CASE p_type WHEN 'ECONOMY' THEN '德音分班' WHEN 'SMALL' THEN '（委託財團法人' || p_brand || '辦理）'
    WHEN 'LARGE' THEN '(社團法人 ' || p_brand || '申請辦理)' ELSE '' END AS title, p_name, p_type, p_brand, p_size FROM part)"""


def titles(t: Tables) -> DataFrame:
    kind = F.col("p_type")
    return t.part.select(
        F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size",
        F.concat(F.lit("新北市"), "p_name", F.lit("幼兒園"), F.when(kind == "ECONOMY", "德音分班")
                 .when(kind == "SMALL", F.concat(F.lit("（委託財團法人"), "p_brand", F.lit("辦理）")))
                 .when(kind == "LARGE", F.concat(F.lit("(社團法人 "), "p_brand", F.lit("申請辦理)"))).otherwise("")).alias("title"))


@plan("P5 P6", with_(more=TITLE) + """SELECT id, title, CASE p_type WHEN 'SMALL' THEN '財團法人' || p_brand WHEN 'LARGE' THEN '社團法人 ' || p_brand END AS operator,
    CASE WHEN p_type IN ('SMALL', 'LARGE') THEN p_brand ELSE '' END AS operator_core, '新北市' || p_name || '幼兒園' AS entity,
    CASE WHEN p_type IN ('SMALL', 'LARGE') THEN contains(p_brand, 'Brand#1') OR contains('Brand#1', p_brand) ELSE false END AS same_as_brand1 FROM ti""")
def title_parse(t: Tables) -> DataFrame:
    op = C.operator_in_title(F.col("title"))
    return titles(t).select("id", "title", op.alias("operator"), C.operator_core(op).alias("operator_core"), C.entity_key(F.col("title")).alias("entity"),
                            C.same_operator(op, F.lit("財團法人Brand#1")).alias("same_as_brand1"))


@plan("P8", """SELECT p_partkey AS id, CAST(floor(p_retailprice) AS DOUBLE) AS area, p_size > 20 AS has_shuttle, round(floor(p_retailprice) / nullif(p_size - 25, 0), 6) AS area_per_child FROM part""")
def area_parse(t: Tables) -> DataFrame:
    area = C.first_number(F.concat(F.format_number(F.floor("p_retailprice").cast("long"), 0), F.lit("平方公尺")))
    shuttle = F.trim(F.when(F.col("p_size") > 20, "有").otherwise("  ")) != ""
    return t.part.select(F.col("p_partkey").alias("id"), area.alias("area"), shuttle.alias("has_shuttle"),
                         F.round(C.ratio(area, F.col("p_size") - 25), 6).alias("area_per_child"))


@plan("P9 P10 P11 P12", """WITH d AS (SELECT o_orderkey AS rec, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 400 AS e, year(o_orderdate) - 1911 AS y, o_orderstatus FROM orders),
    x AS (SELECT *, (year(s) - 1911) * 12 + month(s) AS ms, (year(e) - 1911) * 12 + month(e) AS me FROM d)
    SELECT rec, CASE WHEN o_orderstatus <> 'P' THEN s END AS start, CASE WHEN o_orderstatus <> 'P' THEN e END AS finish,
    CASE WHEN o_orderstatus <> 'P' THEN ms <= (y + 1) * 12 + 7 AND me >= y * 12 + 8 END AS covers, ms BETWEEN y * 12 + 8 AND (y + 1) * 12 + 7 AS opening,
    CASE WHEN o_orderstatus <> 'P' AND me - ms + 1 BETWEEN 1 AND 24 THEN me - ms + 1 END AS months, month(s) = 8 AS own FROM x""", wide="months")
def period_parse(t: Tables) -> DataFrame:
    s, e = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 400)
    text = lambda d: F.concat((F.year(d) - 1911).cast("string"), F.lit("年 "), F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日"))
    period = F.when(F.col("o_orderstatus") == "P", text(s)).otherwise(F.concat(text(s), F.lit("至"), text(e), F.lit("（99年1月1日開園）")))
    d = t.orders.select(F.col("o_orderkey").alias("rec"), period.alias("period"), (F.year(s) - 1911).alias("y"))
    start, finish = C.minguo_period(F.col("period"))
    return d.select("rec", start.alias("start"), finish.alias("finish"), C.covers_school_year(F.col("period"), F.col("y")).alias("covers"),
                    C.opens_in_school_year(F.col("period"), F.col("y")).alias("opening"), C.months_covered(F.col("period")).alias("months"),
                    C.own_period(F.col("period"), F.col("y")).alias("own"))


@plan("P2", """SELECT CASE WHEN l_returnflag = 'N' THEN 'active' WHEN l_returnflag = 'A' THEN 'inactive' WHEN l_linestatus = 'O' THEN 'suspended' ELSE 'unknown' END AS state, count(*) AS n FROM lineitem GROUP BY 1""")
def asset_states(t: Tables) -> DataFrame:
    txn = F.when(F.col("l_returnflag") == "N", " 本區新領").when(F.col("l_returnflag") == "A", "繳銷").when(
        F.col("l_linestatus") == "O", "停用報停").otherwise("繳銷中")
    return t.lineitem.groupBy(C.asset_state(txn).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@plan("P28 P29 A29", """WITH d AS (SELECT o_custkey AS owner, '教幼字第' || (o_orderkey % 4000) || '號' AS doc, o_orderstatus, o_totalprice FROM orders),
    k AS (SELECT owner, doc, count(*) AS r FROM d GROUP BY 1, 2)
    SELECT owner, CAST(sum(r) AS BIGINT) AS n_rows, count(*) AS n_documents, CAST(sum(r) AS BIGINT) - count(*) AS surplus FROM k GROUP BY owner""")
def document_counts(t: Tables) -> DataFrame:
    return documents(t)[0]


def documents(t: Tables) -> tuple[DataFrame, DataFrame]:
    no = F.concat(F.when(F.col("o_orderstatus") == "F", "教幼字 字第").otherwise("教幼字第"), (F.col("o_orderkey") % 4000).cast("string"), F.lit("號"))
    d = t.orders.select(F.col("o_custkey").alias("owner"), no.alias("doc_no"), F.col("o_orderstatus").alias("content"), F.floor(F.col("o_totalprice") / 100000).alias("amount"))
    return Q.document_counts(d, "owner", C.document_number(F.col("doc_no")), ["content"], "amount")


@plan("A29", """SELECT l_suppkey AS owner, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows, round(sum((c - 1) * l_quantity), 4) AS overcounted FROM (
    SELECT l_suppkey, l_partkey, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2, 3) WHERE c > 1 GROUP BY 1""")
def duplicate_rows(t: Tables) -> DataFrame:
    d = t.lineitem.select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").cast("string").alias("doc"), F.col("l_quantity").alias("content"), F.col("l_quantity").alias("amount"))
    return Q.document_counts(d, "owner", C.document_number(F.col("doc")), ["content"], "amount")[1].withColumn("overcounted", F.round("overcounted", 4))


# --- crosswalk and ladders ---------------------------------------------------

XW = """rp AS (SELECT s_suppkey AS key, 'ION_' || s_nationkey AS short_name, 'C' || s_nationkey AS operator, s_nationkey AS y, s_acctbal AS cap FROM supplier),
    rg AS (SELECT n_nationkey AS id, n_name || '幼兒園' AS title, r_name || n_name AS entity, '財團法人C' || n_regionkey AS operator, n_nationkey * 400.0 AS cap FROM nation JOIN region ON n_regionkey = r_regionkey),
    cd AS (SELECT rp.key, rp.short_name, rg.*, contains('C' || substr(rp.operator, 2), replace(rg.operator, '財團法人', '')) OR contains(replace(rg.operator, '財團法人', ''), rp.operator) AS ok, abs(rg.cap - rp.cap) AS gap
    FROM rp JOIN rg ON contains(rg.title, rp.short_name)),
    ag AS (SELECT key, count(*) AS n_candidates, count(DISTINCT entity) AS n_entities, count(*) FILTER (ok) AS n_operator, min(entity) AS e, min(gap) AS capacity_gap FROM cd GROUP BY key),
    xs AS (SELECT rp.key, short_name, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_entities, 0) AS n_entities, coalesce(n_operator, 0) AS n_operator, CASE WHEN n_entities = 1 THEN e END AS entity,
    CASE WHEN y > 12 THEN true WHEN y > 5 THEN false END AS covered, capacity_gap FROM rp LEFT JOIN ag ON rp.key = ag.key),
    xx AS (SELECT *, CASE WHEN n_entities = 0 THEN 'no_entity' WHEN n_entities > 1 THEN 'ambiguous_entity' WHEN n_operator = 0 THEN 'operator_unmatched' WHEN NOT coalesce(covered, false) THEN 'contract_uncovered' ELSE 'matched' END AS status FROM xs)"""


def crosswalk_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    nk = F.col("s_nationkey")
    period = F.when(nk > 12, "110年8月1日至114年7月31日").when(nk > 5, "100年8月1日至104年7月31日").otherwise("110年8月1日起")
    rp = t.supplier.select(F.col("s_suppkey").alias("key"), F.concat(F.lit("ION_"), nk).alias("short_name"), F.concat(F.lit("C"), nk).alias("operator"),
                           period.alias("contract_period"), F.lit(112).alias("school_year"), F.col("s_acctbal").alias("capacity"))
    rg = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit("幼兒園")).alias("title"), F.concat("r_name", "n_name").alias("entity"),
        F.concat(F.lit("財團法人C"), "n_regionkey").alias("operator"), (F.col("n_nationkey") * 400.0).alias("capacity"))
    return I.crosswalk(rp, rg)


@plan("J3 R13", with_(more=XW) + "SELECT key, short_name, n_candidates, n_entities, n_operator, entity, covered, round(capacity_gap, 4) AS capacity_gap, status FROM xx")
def crosswalk_status(t: Tables) -> DataFrame:
    return crosswalk_parts(t)[0].withColumn("capacity_gap", F.round("capacity_gap", 4))


@plan("J4", with_(more=XW) + """SELECT problem, count(*) AS n FROM (SELECT 'not_matched' AS problem FROM xx WHERE status <> 'matched' UNION ALL
    SELECT 'inconsistent_siblings' FROM (SELECT e FROM (SELECT key, min(entity) AS e, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS s FROM cd GROUP BY key) GROUP BY e HAVING count(DISTINCT s) > 1)) GROUP BY 1""")
def crosswalk_problems(t: Tables) -> DataFrame:
    status, cand = crosswalk_parts(t)
    return I.crosswalk_problems(status, cand).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


LADDER = """rg AS (SELECT p_partkey AS id, p_name || p_brand || p_type AS title, p_name || p_brand AS entity, p_name AS core, p_type AS town FROM part),
    src AS (SELECT c_custkey AS key, CASE WHEN c_acctbal > 7000 THEN p_name || p_brand || p_type WHEN c_acctbal > 4000 THEN p_name || p_brand || 'x' WHEN c_acctbal > 0 THEN p_name || 'Brand#99' ELSE 'Z' || c_custkey END AS title,
    CASE WHEN c_acctbal > 4000 THEN p_name || p_brand WHEN c_acctbal > 0 THEN p_name || 'Brand#99' ELSE 'Z' END AS entity, CASE WHEN c_acctbal > 0 THEN p_name ELSE 'Z' END AS core,
    CASE WHEN c_acctbal > 2000 THEN p_type ELSE '' END AS town FROM customer JOIN part ON p_partkey = c_custkey)"""


@plan("J5", with_(more=LADDER) + """, bt AS (SELECT title, count(*) AS n, min(entity) AS e FROM rg GROUP BY 1), be AS (SELECT entity, count(*) AS n FROM rg GROUP BY 1),
    bc AS (SELECT core, town, count(*) AS n, count(DISTINCT entity) AS ne, min(entity) AS e FROM rg GROUP BY 1, 2), ba AS (SELECT core, count(*) AS n, count(DISTINCT entity) AS ne, min(entity) AS e FROM rg GROUP BY 1),
    j AS (SELECT s.key, s.entity, coalesce(bt.n, 0) AS n_title, bt.e AS e1, coalesce(be.n, 0) AS n_entity, coalesce(CASE WHEN s.town <> '' THEN bc.n ELSE ba.n END, 0) AS n_core,
    coalesce(CASE WHEN s.town <> '' THEN bc.ne ELSE ba.ne END, 0) AS nce, CASE WHEN s.town <> '' THEN bc.e ELSE ba.e END AS e3
    FROM src s LEFT JOIN bt ON bt.title = s.title LEFT JOIN be ON be.entity = s.entity LEFT JOIN bc ON bc.core = s.core AND bc.town = s.town LEFT JOIN ba ON ba.core = s.core)
    SELECT key, n_title, n_entity, n_core, CASE WHEN n_title = 1 THEN 'matched_exact_title' WHEN n_entity > 0 THEN 'matched_entity' WHEN nce = 1 THEN 'matched_unique_name_core' WHEN n_core > 0 THEN 'unresolved_ambiguous_name_core'
    ELSE 'unresolved_historical_institution' END AS status, CASE WHEN n_title = 1 THEN e1 WHEN n_entity > 0 THEN entity WHEN nce = 1 THEN e3 END AS matched_entity FROM j""")
def identity_ladder(t: Tables) -> DataFrame:
    p = t.part
    rg = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", "p_brand", "p_type").alias("title"), F.concat("p_name", "p_brand").alias("entity"),
                  F.col("p_name").alias("core"), F.col("p_type").alias("town"))
    b = F.col("c_acctbal")
    src = t.customer.join(p, F.col("p_partkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("key"),
        F.when(b > 7000, F.concat("p_name", "p_brand", "p_type")).when(b > 4000, F.concat("p_name", "p_brand", F.lit("x"))).when(b > 0, F.concat("p_name", F.lit("Brand#99")))
        .otherwise(F.concat(F.lit("Z"), F.col("c_custkey"))).alias("title"),
        F.when(b > 4000, F.concat("p_name", "p_brand")).when(b > 0, F.concat("p_name", F.lit("Brand#99"))).otherwise("Z").alias("entity"),
        F.when(b > 0, F.col("p_name")).otherwise("Z").alias("core"), F.when(b > 2000, F.col("p_type")).otherwise("").alias("town"))
    return I.identity_ladder(src, rg)


@plan("J6", with_("inst", more="g AS (SELECT operator AS entity, count(*) AS n_siblings, min(id) AS first_id, max(id) AS last_id FROM inst GROUP BY 1)")
      + "SELECT o_orderkey AS rec, g.* FROM orders JOIN inst ON id = o_custkey JOIN g ON g.entity = operator")
def sibling_expansion(t: Tables) -> DataFrame:
    reg = R.institutions(t).select("id", F.col("operator").alias("entity"))
    rows = t.orders.join(reg, F.col("o_custkey") == F.col("id")).select(F.col("o_orderkey").alias("rec"), "entity")
    return I.with_siblings(rows, reg).drop("fingerprint")


@plan("J6", with_("inst", more="cl AS (SELECT town AS key, operator AS entity, id FROM inst WHERE capacity > -900)")
      + "SELECT DISTINCT key, 'omitted_id' AS problem FROM cl WHERE entity IN (SELECT operator FROM inst WHERE capacity <= -900)")
def sibling_violations(t: Tables) -> DataFrame:
    reg = R.institutions(t).select("id", F.col("operator").alias("entity"), "town", "capacity")
    claimed = reg.where(F.col("capacity") > -900).select(F.col("town").alias("key"), "entity", "id")
    return I.sibling_violations(claimed, reg.select("id", "entity")).distinct()


@plan("J7", with_("inst", "pen", more="g AS (SELECT operator AS entity, count(*) AS n_candidates, min(rec) AS first_penalty, max(rec) AS last_penalty FROM pen JOIN inst USING (id) WHERE role <> 'P' GROUP BY 1)")
      + "SELECT p.rec AS action, g.* FROM pen p JOIN inst i ON i.id = p.id JOIN g ON g.entity = i.operator WHERE p.role = 'P'")
def candidate_links(t: Tables) -> DataFrame:
    inst = R.institutions(t).select("id", F.col("operator").alias("entity"))
    pen = R.sanctions(t)
    actions = pen.where(F.col("role") == "P").join(inst, "id").select(F.col("rec").alias("action"), "entity")
    return I.candidate_links(actions, pen.where(F.col("role") != "P").select("rec", "id"), inst)


@plan("J6", with_("inst") + "SELECT operator AS entity, id, row_number() OVER (PARTITION BY operator ORDER BY id) AS position, count(*) OVER (PARTITION BY operator) AS n_siblings FROM inst")
def sibling_ids(t: Tables) -> DataFrame:
    return I.sibling_members(R.institutions(t).select("id", F.col("operator").alias("entity"))).select("entity", "id", "position", "n_siblings")


@plan("J7", with_("inst", "pen") + """SELECT operator AS entity, rec, id, row_number() OVER (PARTITION BY operator ORDER BY rec) AS candidate_index, count(*) OVER (PARTITION BY operator) AS candidate_count
    FROM pen JOIN inst USING (id) WHERE role <> 'P'""")
def candidate_sanctions(t: Tables) -> DataFrame:
    inst = R.institutions(t).select("id", F.col("operator").alias("entity"))
    pen = R.sanctions(t).where(F.col("role") != "P").select("rec", "id")
    return I.candidate_sanctions(pen, inst).select("entity", "rec", "id", "candidate_index", "candidate_count")


@plan("J8", """WITH aw AS (SELECT o_orderkey AS award, o_custkey AS entity, CASE o_orderstatus WHEN 'F' THEN '財團法人Op' || (o_custkey % 7) WHEN 'O' THEN 'Op' || (o_custkey % 7) ELSE 'Op' END AS supplier,
    CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderpriority NOT LIKE '5%' THEN CAST(o_orderdate AS DATE) + 500 END AS e FROM orders),
    rp AS (SELECT DISTINCT o_custkey AS entity, year(o_orderdate) AS year, 'Op' || (o_custkey % 7) AS operator FROM orders)
    SELECT award, aw.entity, year, m AS method, CASE WHEN m NOT IN ('exact_name', 'normalised_legal_name') THEN 'supplier_operator_unconfirmed' WHEN e IS NULL THEN 'matched_operator_contract_unconfirmed'
    WHEN s < make_date(year + 1, 8, 1) AND e >= make_date(year, 8, 1) THEN 'matched_operator_contract_covered' ELSE 'matched_operator_contract_uncovered' END AS status
    FROM (SELECT aw.*, year, CASE WHEN supplier = operator THEN 'exact_name' WHEN replace(supplier, '財團法人', '') = operator THEN 'normalised_legal_name' ELSE 'weak_contains_unconfirmed' END AS m
    FROM aw JOIN rp ON rp.entity = aw.entity) aw""", wide="year")
def award_year_overlap(t: Tables) -> DataFrame:
    op = F.concat(F.lit("Op"), (F.col("o_custkey") % 7).cast("string"))
    status = F.col("o_orderstatus")
    aw = t.orders.select(F.col("o_orderkey").alias("award"), F.col("o_custkey").alias("entity"),
                         F.when(status == "F", F.concat(F.lit("財團法人"), op)).when(status == "O", op).otherwise("Op").alias("supplier"),
                         F.to_date("o_orderdate").alias("start"),
                         F.when(~F.col("o_orderpriority").startswith("5"), F.date_add(F.to_date("o_orderdate"), 500)).alias("end"))
    rp = t.orders.select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), op.alias("operator")).distinct()
    return I.award_year_status(aw, rp)


# --- attribution -------------------------------------------------------------

NAMES = """nm AS (SELECT p_name AS core, min(p_partkey) AS id, '新北市私立' || p_name || '幼兒園' AS title, min(p_brand) || '區' AS town FROM part GROUP BY p_name)"""
MENTION = NAMES + """, mt AS (SELECT o_orderkey AS text_id, CASE o_orderstatus || substr(o_orderpriority, 1, 1)
    WHEN 'F1' THEN '「' || p_name || '」遭裁罰' WHEN 'O1' THEN '新北市私立' || p_name || '幼兒園活動' WHEN 'P1' THEN '台北市「' || p_name || '」調查' WHEN 'P2' THEN '台北市「' || p_name || '」調查 ' || replace(town, '區', '')
    ELSE CASE o_orderstatus WHEN 'F' THEN p_name || ' 幼兒園 招生' WHEN 'O' THEN '報導 ' || p_name || ' 活動' ELSE '「' || p_name || '」與「red plate」' END END AS text
    FROM orders JOIN part ON p_partkey = o_custkey JOIN nm ON core = p_name),
    hi AS (SELECT text_id, id, town, text, contains(text, title) AS is_full FROM mt, nm WHERE contains(text, title) OR contains(text, core || '幼兒園') OR contains(text, core || ' 幼兒園') OR contains(text, '「' || core || '」'))"""


def names(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("core")).agg(F.min("p_partkey").alias("id"), F.concat(F.min("p_brand"), F.lit("區")).alias("town")).withColumn(
        "title", F.concat(F.lit("新北市私立"), "core", F.lit("幼兒園")))


def mentions(t: Tables) -> DataFrame:
    q = F.concat(F.lit("「"), "p_name", F.lit("」"))
    s, p = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    text = (F.when((s == "F") & (p == "1"), F.concat(q, F.lit("遭裁罰 - 新聞網")))
            .when((s == "O") & (p == "1"), F.concat(F.lit("新北市私立"), "p_name", F.lit("幼兒園活動")))
            .when((s == "P") & (p == "1"), F.concat(F.lit("台北市"), q, F.lit("調查")))
            .when((s == "P") & (p == "2"), F.concat(F.lit("台北市"), q, F.lit("調查 "), F.replace("town", F.lit("區"), F.lit(""))))
            .when(s == "F", F.concat("p_name", F.lit(" 幼兒園 招生"))).when(s == "O", F.concat(F.lit("報導 "), "p_name", F.lit(" 活動")))
            .otherwise(F.concat(q, F.lit("與「red plate」"))))
    town = names(t).select(F.col("core").alias("p_name"), "town")
    return t.orders.join(t.part.join(town, "p_name"), F.col("p_partkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("text_id"), text.alias("text"))


PLACES = ["臺北市", "台北市", "桃園"]


@plan("J15", with_(more=MENTION) + """SELECT m.text_id, CASE WHEN n = 1 AND (NOT contains(m.text, '台北市') OR contains(m.text, replace(town, '區', ''))) THEN id END AS institution_id,
    CASE WHEN n IS NULL THEN CASE WHEN contains(m.text, '台北市') THEN 'other_city' ELSE 'no_name' END WHEN n > 1 THEN 'ambiguous'
    WHEN contains(m.text, '台北市') AND NOT contains(m.text, replace(town, '區', '')) THEN 'other_city_uncorroborated' WHEN full_ THEN 'full_title' ELSE 'distinctive_name' END AS basis,
    coalesce(n = 1 AND contains(m.text, replace(town, '區', '')), false) AS town_corroborated
    FROM mt m LEFT JOIN (SELECT text_id, count(*) AS n, min(id) AS id, min(town) AS town, bool_and(is_full) AS full_ FROM hi GROUP BY 1) h ON h.text_id = m.text_id""")
def attribution(t: Tables) -> DataFrame:
    return I.attribute_texts(mentions(t), names(t), PLACES, "新北市", ["板橋"])


OTHER_TITLE = "CASE WHEN id % 7 = 0 THEN '新北市立淡水幼兒園' ELSE '新北市私立' || core || '幼兒園(委託社團法人某協會辦理)' END"


@plan("J15", with_(more=MENTION.replace("hi AS", "old AS")) + f""", n2 AS (SELECT id, town, core, {OTHER_TITLE} AS title, CASE WHEN id % 7 = 0 THEN '淡水' ELSE core END AS c2 FROM nm),
    m2 AS (SELECT mt.text_id, CASE WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN n2.title || '活動' ELSE mt.text END AS text, o_orderpriority LIKE '5%' AS anonymised
        FROM mt JOIN orders ON o_orderkey = text_id JOIN part ON p_partkey = o_custkey JOIN n2 ON n2.core = p_name),
    h2 AS (SELECT text_id, count(*) AS n, min(id) AS id, min(town) AS town, bool_or(contains(text, title)) AS full_ FROM m2, n2 WHERE contains(text, title) OR (c2 <> '淡水' AND
        (contains(text, c2 || '幼兒園') OR contains(text, c2 || ' 幼兒園') OR contains(text, '「' || c2 || '」'))) GROUP BY 1)
    SELECT m.text_id, CASE WHEN NOT anonymised AND n = 1 AND (NOT contains(m.text, '台北市') OR contains(m.text, replace(town, '區', ''))) THEN id END AS institution_id,
    CASE WHEN anonymised THEN 'anonymised' WHEN n IS NULL THEN CASE WHEN contains(m.text, '台北市') THEN 'other_city' ELSE 'no_name' END WHEN n > 1 THEN 'ambiguous'
    WHEN contains(m.text, '台北市') AND NOT contains(m.text, replace(town, '區', '')) THEN 'other_city_uncorroborated' WHEN full_ THEN 'full_title' ELSE 'distinctive_name' END AS basis,
    coalesce(NOT anonymised AND n = 1 AND contains(m.text, replace(town, '區', '')), false) AS town_corroborated FROM m2 m LEFT JOIN h2 ON h2.text_id = m.text_id""")
def attribution_by_title(t: Tables) -> DataFrame:
    """Institutions known by their official titles only: cores are derived, all districts and cities are known."""
    inst = names(t).withColumn("title", F.when(F.col("id") % 7 == 0, "新北市立淡水幼兒園").otherwise(F.concat(F.lit("新北市私立"), "core", F.lit("幼兒園(委託社團法人某協會辦理)"))))
    keys = t.orders.join(t.part, F.col("p_partkey") == F.col("o_custkey")).join(inst.select(F.col("core").alias("p_name"), "title"), "p_name") \
        .select(F.col("o_orderkey").alias("text_id"), "title", F.col("o_orderpriority").startswith("5").alias("is_anonymised"),
                ((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1")).alias("titled"))
    texts = mentions(t).join(keys, "text_id").select("text_id", F.when(F.col("titled"), F.concat("title", F.lit("活動"))).otherwise(F.col("text")).alias("text"), "is_anonymised")
    return I.attribute_texts(texts, inst.drop("core"))


@plan("J15", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def full_text_containment(t: Tables) -> DataFrame:
    return contains_pairs(t.spread("documents", "doc_id"), "doc_id", "text", t.benchmark.select("item_id", F.col("text").alias("name")), "item_id", "name")


@plan("J16 P27", with_(more=NAMES + ", sx AS (SELECT a.core, count(*) AS n FROM nm a JOIN nm b ON ends_with(a.core, b.core) GROUP BY 1)") + """SELECT post_id, CASE WHEN ok THEN id END AS institution_id,
    CASE WHEN ok THEN 'distinctive_name' ELSE 'no_name' END AS basis, CASE WHEN ok THEN 1 ELSE 0 END AS candidate FROM (SELECT o_orderkey AS post_id, id, o_orderstatus = 'O' OR (o_orderstatus = 'F' AND sx.n = 1) AS ok
    FROM orders JOIN part ON p_partkey = o_custkey JOIN nm ON core = p_name JOIN sx ON sx.core = p_name)""")
def candidate_cascade(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    text = (F.when(s == "F", F.concat(F.lit("#"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("\n"), "p_name", F.lit(" 幼兒園")))
            .when(s == "O", F.concat(F.lit("daily news\n「"), "p_name", F.lit("」"))).otherwise("nothing"))
    posts = t.orders.join(t.part, F.col("p_partkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("post_id"), text.alias("text"))
    cand = I.cascade_candidates(posts)
    return I.first_attribution(cand, I.attribute_texts(cand.select("text_id", "text"), names(t), PLACES, "新北市", []))


THREAD = """th AS (SELECT conv_id * 100 + turn AS post_id, conv_id * 100 AS root_id, conv_id, turn, role, text FROM conversations)"""


@plan("J17", with_(more=THREAD) + """SELECT r.post_id, r.root_id, coalesce(r.own, q.inst) AS institution_id, CASE WHEN r.own IS NOT NULL THEN 'own' WHEN q.inst IS NOT NULL THEN 'inherited' ELSE 'none' END AS source,
    coalesce(r.own <> q.inst, false) AS named_other FROM (SELECT post_id, root_id, CASE WHEN length(text) > 300 THEN length(text) END AS own FROM th WHERE turn > 0) r
    JOIN (SELECT root_id, CASE WHEN role = 'user' AND length(text) > 200 THEN conv_id END AS inst FROM th WHERE turn = 0 AND length(text) > 100) q ON q.root_id = r.root_id""")
def reply_inheritance(t: Tables) -> DataFrame:
    th = threads(t)
    size = F.length("text").cast("long")
    roots = th.where((F.col("turn") == 0) & (size > 100)).select("root_id", F.when((F.col("role") == "user") & (size > 200), F.col("conv_id")).alias("institution_id"))
    replies = th.where(F.col("turn") > 0).select("post_id", "root_id", F.when(size > 300, size).alias("own_id"))
    return I.inherit_from_root(replies, roots)


def threads(t: Tables) -> DataFrame:
    return t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("post_id"), (F.col("conv_id") * 100).alias("root_id"), "conv_id", "turn", "role", "text")


@plan("D2", """WITH b AS (SELECT o_custkey AS id, year(o_orderdate) AS year, CASE o_orderstatus WHEN 'F' THEN '第8條' WHEN 'O' THEN '第8條第1項' ELSE '第8條第2項' END AS law FROM orders),
    x AS (SELECT id, year, law, count(*) AS c FROM b GROUP BY 1, 2, 3), l AS (SELECT a.id, a.year, a.law, count(*) AS n, min(b.law) AS long FROM x a JOIN x b ON a.id = b.id AND a.year = b.year AND length(b.law) > length(a.law) AND starts_with(b.law, a.law) GROUP BY 1, 2, 3),
    g AS (SELECT x.id, x.year, CASE WHEN l.n = 1 THEN l.long ELSE x.law END AS target, x.law, x.c FROM x LEFT JOIN l ON x.id = l.id AND x.year = l.year AND x.law = l.law)
    SELECT id, year, target, CAST(sum(c) AS BIGINT) AS source_rows, count(*) AS variants, CAST(CASE WHEN count(*) = 1 THEN sum(c) ELSE 1 END AS BIGINT) AS records, arg_max(law, (length(law), law)) AS law FROM g GROUP BY 1, 2, 3""", wide="year")
def sanction_groups(t: Tables) -> DataFrame:
    law = F.when(F.col("o_orderstatus") == "F", "第8條").when(F.col("o_orderstatus") == "O", "第8條第1項").otherwise("第8條第2項")
    rows = t.orders.select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"), law.alias("law"))
    return I.merge_short_laws(rows, ["id", "year"], "law").drop("texts")


D2_KEY = "id, date, article, paragraph, punishment, role, actor"


@plan("D2", f"""WITH b AS (SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, '8' AS article, CASE o_orderstatus WHEN 'P' THEN '2' ELSE '1' END AS paragraph, o_orderpriority AS punishment,
        CASE WHEN o_totalprice > 300000 THEN 'responsible' ELSE 'individual' END AS role, 'a' || (o_orderkey % 2) AS actor,
        CASE o_orderstatus WHEN 'F' THEN '第8條第1項' WHEN 'O' THEN '第8條第1項第3款' ELSE '第8條第2項' END AS law FROM orders),
    x AS (SELECT {D2_KEY}, law, count(*) AS c FROM b GROUP BY ALL),
    l AS (SELECT {", ".join("a." + k.strip() for k in D2_KEY.split(","))}, a.law, count(*) AS n, min(b.law) AS long FROM x a JOIN x b USING ({D2_KEY}) WHERE length(b.law) > length(a.law) AND starts_with(b.law, a.law) GROUP BY ALL),
    g AS (SELECT {D2_KEY}, CASE WHEN l.n = 1 THEN l.long ELSE law END AS target, law AS one, x.c FROM x LEFT JOIN l USING ({D2_KEY}, law)),
    r AS (SELECT {D2_KEY}, target AS law, count(*) AS law_variants, string_agg(one, '|' ORDER BY one) AS law_texts, CAST(sum(c) AS BIGINT) AS source_row_count FROM g GROUP BY {D2_KEY}, target)
    SELECT *, md5(concat_ws('|', {D2_KEY})) AS penalty_group_id, row_number() OVER (PARTITION BY {D2_KEY} ORDER BY law) AS group_record_index, count(*) OVER (PARTITION BY {D2_KEY}) AS group_record_count FROM r""")
def sanction_records(t: Tables) -> DataFrame:
    """Records of one institution, date, article, paragraph, punishment, role and name, with all their law texts."""
    s = F.col("o_orderstatus")
    law = F.when(s == "F", "第8條第1項").when(s == "O", "第8條第1項第3款").otherwise("第8條第2項")
    rows = t.orders.select(F.col("o_custkey").alias("id"), F.trunc("o_orderdate", "month").alias("date"), F.lit("8").alias("article"), F.when(s == "P", "2").otherwise("1").alias("paragraph"),
                           F.col("o_orderpriority").alias("punishment"), F.when(F.col("o_totalprice") > 300000, "responsible").otherwise("individual").alias("role"),
                           F.concat(F.lit("a"), (F.col("o_orderkey") % 2).cast("string")).alias("actor"), law.alias("law"))
    return I.sanction_records(rows, [k.strip() for k in D2_KEY.split(",")], "law")


@plan("J12", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS s, CAST(year(o_orderdate) AS VARCHAR) AS a, o_orderpriority AS b, CAST(month(o_orderdate) AS VARCHAR) AS c, CAST(day(o_orderdate) AS VARCHAR) AS d FROM orders),
    n AS (SELECT o_orderkey + 1000000 AS k, o_custkey AS s, CAST(year(o_orderdate) AS VARCHAR) AS a, CASE WHEN o_totalprice > 250000 THEN o_orderpriority ELSE 'changed' END AS b, CAST(month(o_orderdate) AS VARCHAR) AS c,
    CASE WHEN o_totalprice > 100000 THEN CAST(day(o_orderdate) AS VARCHAR) ELSE '0' END AS d FROM orders WHERE o_totalprice < 420000),
    p AS (SELECT o.k AS old_key, n.k AS new_key FROM o JOIN n ON o.s = n.s WHERE CAST(o.a = n.a AS INT) + CAST(o.b = n.b AS INT) + CAST(o.c = n.c AS INT) + CAST(o.d = n.d AS INT) >= 3)
    SELECT old_key, new_key FROM (SELECT *, count(*) OVER (PARTITION BY old_key) AS x, count(*) OVER (PARTITION BY new_key) AS y FROM p) WHERE x = 1 AND y = 1""")
def rekey_pairs(t: Tables) -> DataFrame:
    base = t.orders
    y, m, d = (f("o_orderdate").cast("string") for f in (F.year, F.month, F.day))
    old = base.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("s"), y.alias("a"), F.col("o_orderpriority").alias("b"), m.alias("c"), d.alias("d"))
    price = F.col("o_totalprice")
    new = base.where(price < 420000).select(
        (F.col("o_orderkey") + 1000000).alias("k"), F.col("o_custkey").alias("s"), y.alias("a"), F.when(price > 250000, F.col("o_orderpriority")).otherwise("changed").alias("b"),
        m.alias("c"), F.when(price > 100000, d).otherwise("0").alias("d"))
    return I.three_of_four_pairs(old, new, "s", ["a", "b", "c", "d"], "k")


@plan("J12", """WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'R'), n AS (SELECT -(l_orderkey * 10 + l_linenumber) AS k, l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linestatus = 'O' OR l_returnflag = 'N')
    SELECT o.k AS old_key, n.k AS new_key, o.s AS supplier FROM (SELECT s, p, min(k) AS k FROM o GROUP BY 1, 2 HAVING count(*) = 1) o JOIN (SELECT s, p, min(k) AS k FROM n GROUP BY 1, 2 HAVING count(*) = 1) n ON n.s = o.s AND n.p = o.p""")
def rekey_by_plate(t: Tables) -> DataFrame:
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    old = t.lineitem.where(F.col("l_returnflag") != "R").select(key.alias("k"), F.col("l_suppkey").alias("supplier"), "l_partkey")
    new = t.lineitem.where((F.col("l_linestatus") == "O") | (F.col("l_returnflag") == "N")).select((-key).alias("k"), F.col("l_suppkey").alias("supplier"), "l_partkey")
    return I.unique_identity_pairs(old, new, ["supplier", "l_partkey"], "k").select("old_key", "new_key", "supplier")


# --- two versions ------------------------------------------------------------

@plan("J11", """WITH o AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS kind, c_acctbal AS cap FROM customer WHERE c_acctbal < 9000),
    n AS (SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN c_name || 'x' ELSE c_name END AS title, c_mktsegment AS kind, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS cap FROM customer WHERE c_acctbal > -500)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change_type,
    CASE WHEN o.id IS NULL OR n.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.title <> n.title THEN 'title' END, CASE WHEN o.cap <> n.cap THEN 'cap' END) END AS changed_fields
    FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.title <> n.title OR o.cap <> n.cap""")
def snapshot_diff(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("cap"), "c_nationkey")
    old = c.where(F.col("cap") < 9000)
    new = c.where(F.col("cap") > -500).withColumns({
        "title": F.when(F.col("c_nationkey") == 3, F.concat("title", F.lit("x"))).otherwise(F.col("title")),
        "cap": F.when(F.col("kind") == "BUILDING", F.col("cap") + 1).otherwise(F.col("cap"))})
    return Q.snapshot_changes(old, new, "id", ["title", "kind", "cap"]).select("id", "change_type", F.array_join("changed_fields", ",").alias("changed_fields"))


SNAP2 = """a AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders WHERE o_orderpriority NOT LIKE '1%'),
    b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice + 5 WHEN o_orderpriority LIKE '3%' AND o_orderstatus = 'O' THEN NULL WHEN o_orderpriority LIKE '4%' AND o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS v
    FROM orders WHERE o_orderpriority NOT LIKE '5%')"""


def two_sources(t: Tables) -> tuple[DataFrame, DataFrame]:
    p, s, v = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"), F.col("o_totalprice")
    a = t.orders.where(p != "1").select(F.col("o_orderkey").alias("k"), F.when(s != "P", v).alias("value"))
    b = t.orders.where(p != "5").select(F.col("o_orderkey").alias("k"), F.when(p == "2", v + 5).when((p == "3") & (s == "O"), F.lit(None))
                                        .when((p == "4") & (s == "P"), F.lit(0.0)).otherwise(v).alias("value"))
    return a, b


@plan("J10", with_(more=SNAP2) + """SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, a.v AS old_value, b.v AS new_value, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN CASE WHEN abs(a.v - b.v) <= 0.5 THEN 'match' ELSE 'differ' END
    WHEN a.v IS NOT NULL THEN 'old_only' WHEN b.v IS NOT NULL THEN 'new_only' END AS verdict FROM a FULL JOIN b ON a.k = b.k) WHERE verdict IS NOT NULL""")
def reconcile_sources(t: Tables) -> DataFrame:
    a, b = two_sources(t)
    return Q.reconcile(a, b, ["k"], "value", 0.5)


@plan("J13", with_(more=SNAP2) + """SELECT state, count(*) AS n FROM (SELECT CASE WHEN a.v IS NULL AND b.v IS NULL THEN NULL WHEN a.v IS NULL THEN CASE WHEN b.v = 0 THEN 'false_zero' ELSE 'spurious' END WHEN b.v IS NULL THEN 'missing'
    WHEN abs(b.v - a.v) <= 1 THEN 'correct' ELSE 'wrong_value' END AS state FROM a FULL JOIN b ON a.k = b.k) WHERE state IS NOT NULL GROUP BY 1""")
def cell_scores(t: Tables) -> DataFrame:
    a, b = two_sources(t)
    return Q.score_cells(a, b, ["k"], 1.0).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@plan("D3", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS occurrence FROM documents")
def occurrence_keys(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return Q.occurrence_keys(d, ["h"], "doc_id").select("doc_id", "occurrence")


@plan("J14", """WITH s AS (SELECT DISTINCT doc_id, replace(unnest(regexp_extract_all(text, '\\d[\\d,]*')), ',', '') AS digits FROM documents),
    n AS (SELECT doc_id, CAST(n_chars * 1000 + 7 AS VARCHAR) AS value FROM documents UNION ALL SELECT doc_id, arg_max(digits, (length(digits), digits)) FROM s GROUP BY 1)
    SELECT n.doc_id, n.value, s.digits IS NOT NULL AS confirmed FROM n LEFT JOIN s ON s.doc_id = n.doc_id AND s.digits = n.value WHERE length(n.value) >= 4""")
def page_digits_confirmed(t: Tables) -> DataFrame:
    d = t.documents
    longest = Q.digit_runs(d, "doc_id", fixed.DIGIT_RUN).groupBy("doc_id").agg(F.max_by("digits", F.struct(F.length("digits"), "digits")).alias("digits"))
    claims = d.select("doc_id", (F.col("n_chars") * 1000 + 7).cast("string").alias("digits")).unionByName(longest)
    return Q.digits_confirmed(claims, d, "doc_id", fixed.DIGIT_RUN).select("doc_id", F.col("digits").alias("value"), "confirmed")


@plan("J27 S9", """WITH h AS (SELECT sha256(text) AS h, min(doc_id) AS first_doc FROM documents GROUP BY 1) SELECT doc_id, first_doc, first_doc = doc_id AS is_first FROM documents JOIN h ON h = sha256(text)""")
def first_observed(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first_doc")), "h").select("doc_id", "first_doc", (F.col("first_doc") == F.col("doc_id")).alias("is_first"))


@plan("J28 J29", """SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000) GROUP BY 1""")
def retired_institutions(t: Tables) -> DataFrame:
    known = t.customer.where(F.col("c_acctbal") > 1000).select(F.col("c_custkey").alias("id"))
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(known, "id", "left_anti")


@plan("D5", """SELECT o_custkey AS tender, count(*) AS revisions, arg_max(o_orderkey, (o_orderdate, o_orderpriority, o_orderkey)) AS winner, arg_max(o_totalprice, (o_orderdate, o_orderpriority, o_orderkey)) AS amount FROM orders GROUP BY 1""")
def latest_revision(t: Tables) -> DataFrame:
    d = t.orders.select(F.col("o_custkey").alias("tender"), "o_orderdate", "o_orderpriority", F.col("o_orderkey").alias("winner"), F.col("o_totalprice").alias("amount"))
    return Q.latest_revision(d, ["tender"], ["o_orderdate", "o_orderpriority", "winner"], ["winner", "amount"])


@plan("D6", """WITH l AS (SELECT o_custkey AS url, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s AS (SELECT o_custkey AS url, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT coalesce(l.url, s.url) AS url, coalesce(l.v, s.v) AS v, CASE WHEN l.url IS NOT NULL THEN 0 ELSE 1 END AS source_rank FROM l FULL JOIN s ON l.url = s.url""")
def live_over_snapshot(t: Tables) -> DataFrame:
    side = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("url")).agg(F.max("o_orderkey").alias("v"))
    return Q.union_by_priority(side("F"), side("O"), "url", ["v"])


@plan("D8", """SELECT o_orderkey AS rec, 'new' AS kind FROM orders WHERE o_orderdate > DATE '2001-06-30' UNION ALL SELECT o_orderkey, 'retroactive' FROM orders WHERE o_orderdate <= DATE '1995-02-01' AND o_orderstatus = 'P'""")
def additions_since(t: Tables) -> DataFrame:
    pen = R.sanctions(t)
    fresh = pen.where(F.col("date") > H.day("2001-06-30")).select("rec", F.lit("new").alias("kind"))
    early = pen.where(F.col("date") <= H.day("1995-02-01")).select("rec")
    back = early.exceptAll(early.join(pen.where(F.col("role") != "P").select("rec"), "rec", "left_semi")).select("rec", F.lit("retroactive").alias("kind"))
    return fresh.unionByName(back)


@plan("D9", "SELECT DISTINCT p_brand AS unit, p_size AS job FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND contains(p_name, 'red') AND (contains(p_name, 'rod') OR contains(p_name, 'plate'))")
def tender_discovery(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.where(F.col("p_type").isin("ECONOMY", "SMALL") & name.contains("red") & (name.contains("rod") | name.contains("plate"))).select(
        F.col("p_brand").alias("unit"), F.col("p_size").alias("job")).dropDuplicates()


@plan("D10", """SELECT id, CASE WHEN v = 1 THEN 'duplicate' ELSE 'conflict' END AS problem FROM (SELECT o_custkey AS id, count(*) AS n, count(DISTINCT o_orderpriority) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) WHERE n > 1""")
def listing_conflicts(t: Tables) -> DataFrame:
    g = t.orders.where(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct("o_orderpriority")).alias("v"))
    return g.where(F.col("n") > 1).select("id", F.when(F.col("v") == 1, "duplicate").otherwise("conflict").alias("problem"))
