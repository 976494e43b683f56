"""Evidence queries: issues, observability, map points, lookups, audits, passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.operators import identity as I
from tallyscope.operators import ordering as O
from tallyscope.operators import textual as X
from tallyscope.plans.ranking import RANKED, SCORED, ranked
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import with_
from tallyscope.streaming.streams import fingerprint


@plan("A24", """SELECT l_orderkey AS code, l_linenumber AS page, issue, issue = 'no tax' AS unresolved FROM (SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_tax = 0 THEN 'no tax' END, CASE WHEN l_discount = 0 THEN 'no discount' END,
    CASE WHEN l_quantity = 50 THEN 'large' END], lambda x: x IS NOT NULL)) AS issue FROM lineitem)""")
def issues_table(t: Tables) -> DataFrame:
    found = F.array_compact(F.array(F.when(F.col("l_tax") == 0, "no tax"), F.when(F.col("l_discount") == 0, "no discount"), F.when(F.col("l_quantity") == 50, "large")))
    d = t.lineitem.select(F.col("l_orderkey").alias("code"), F.col("l_linenumber").alias("page"), F.explode(found).alias("issue"))
    return d.withColumn("unresolved", F.col("issue") == "no tax").orderBy(F.desc("unresolved"), "code", "page")


FIND = """fi AS (SELECT o_custkey AS code, CAST(year(o_orderdate) - 1911 AS INTEGER) AS year, CASE WHEN o_orderstatus = 'F' THEN 'school' ELSE 'fiscal' END AS kind, o_orderpriority AS rule,
    CASE WHEN o_totalprice > 300000 THEN false WHEN o_totalprice > 200000 THEN true END AS passed, CASE WHEN o_totalprice > 450000 THEN 'high' ELSE 'medium' END AS severity FROM orders)"""


@plan("M11 J19", with_(more=FIND + """, ob AS (SELECT code, year, rule, count(*) AS n, count(*) FILTER (severity = 'high') AS h FROM fi WHERE passed = false AND year <= CASE WHEN kind = 'school' THEN 1999 - 1911 - 2 ELSE 1999 - 1911 - 2 END GROUP BY 1, 2, 3),
    xw AS (SELECT DISTINCT code, year, unnest(['A' || (code % 50), 'B' || (code // 10)]) AS id FROM fi)""") + """SELECT id, CAST(sum(n) AS BIGINT) AS cross_fail, CAST(sum(h) AS BIGINT) AS cross_fail_high, count(DISTINCT rule) AS cross_rules_n FROM ob JOIN xw USING (code, year) GROUP BY id""")
def findings_as_of(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    fi = t.orders.select(F.col("o_custkey").alias("code"), (F.year("o_orderdate") - 1911).alias("year"), F.when(F.col("o_orderstatus") == "F", "school").otherwise("fiscal").alias("kind"),
                         F.col("o_orderpriority").alias("rule"), F.when(p > 300000, False).when(p > 200000, True).alias("passed"), F.when(p > 450000, "high").otherwise("medium").alias("severity"))
    ids = F.to_json(F.array(F.concat(F.lit("A"), (F.col("code") % 50).cast("string")), F.concat(F.lit("B"), F.floor(F.col("code") / 10).cast("string"))))
    xw = fi.select("code", "year").distinct().withColumn("ids_json", ids)
    return I.findings_as_of(fi, xw, "1999-03-15")


@plan("M11", """SELECT o_orderkey AS rec, CASE WHEN o_orderstatus = 'F' THEN make_date(year(o_orderdate) + 2, 1, 1) ELSE make_date(year(o_orderdate) + 1, 7, 1) END AS observable_from FROM orders""")
def observable_dates(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "school").otherwise("fiscal")
    return t.orders.select(F.col("o_orderkey").alias("rec"), C.observable_from(F.year("o_orderdate") - 1911, kind).alias("observable_from"))


@plan("J29", with_("inst", "pen", more=SCORED + ",\n" + RANKED) + """SELECT kind, count(*) FILTER (capacity > 0) AS mapped, count(*) FILTER (capacity <= 0) AS dropped, min(CASE WHEN capacity > 0 THEN rank_overall END) AS best_mapped FROM rk GROUP BY kind""")
def map_points(t: Tables) -> DataFrame:
    coords = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("lon"))
    d = ranked(t).select("id", "kind", "rank_overall").join(coords, "id", "left")
    return d.groupBy("kind").agg(F.count("lon").alias("mapped"), F.count_if(F.col("lon").isNull()).alias("dropped"),
                                 F.min(F.when(F.col("lon").isNotNull(), F.col("rank_overall"))).alias("best_mapped"))


@plan("J22", """WITH k AS (SELECT p_partkey AS title, p_retailprice AS fee FROM part WHERE p_size > 30), l AS (SELECT o_orderkey AS rec, unnest([o_custkey + 1, o_custkey + 2, o_custkey]) AS title, generate_subscripts([1, 2, 3], 1) AS pos FROM orders)
    SELECT rec, arg_min(fee, pos) AS fee, arg_min(l.title, pos) AS used_title FROM l JOIN k USING (title) GROUP BY rec""")
def first_listed_fee(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    lists = t.orders.select(F.col("o_orderkey").alias("rec"), F.array(c + 1, c + 2, c).alias("titles"))
    known = t.part.where(F.col("p_size") > 30).select(F.col("p_partkey").alias("title"), F.col("p_retailprice").alias("fee"))
    return I.first_listed(lists, "rec", "titles", known, "title", "fee")


@plan("W23", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (turn <> 0), length(text), turn) AS position FROM conversations")
def thread_order(t: Tables) -> DataFrame:
    d = t.conversations.withColumn("_o", F.when(F.col("turn") == 0, -1).otherwise(F.length("text")))
    return O.row_number(d, F.col("_o"), F.col("turn"), ["conv_id"], "position").select("conv_id", "turn", "position")


@plan("R13", """SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE contains('Op' || (o_custkey % 13), 'Op' || (o_orderkey % 13)) OR contains('Op' || (o_orderkey % 13), 'Op' || (o_custkey % 13)) END AS operator_match,
    o_orderpriority NOT LIKE '1%' AS period_ok, o_orderpriority LIKE '2%' AS opening_year, o_totalprice / nullif(o_custkey, 0) AS assets_per_place,
    CASE WHEN o_orderpriority NOT LIKE '2%' AND o_custkey <> 0 THEN o_totalprice / o_custkey BETWEEN 100 AND 1000 END AS magnitude_ok FROM orders""")
def identity_audit(t: Tables) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    period = F.when(p == "1", "100年1月1日至101年7月31日").when(p == "2", "110年9月1日至114年7月31日").otherwise("108年8月1日至112年7月31日（109年2月1日開園）")
    op = lambda c: F.concat(F.lit("財團法人 Op"), (F.col(c) % 13).cast("string"))
    d = t.orders.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") != "P", op("o_custkey")).alias("operator"), op("o_orderkey").alias("registry_operator"),
                        period.alias("contract_period"), F.lit(110).alias("school_year"), F.col("o_totalprice").alias("total_assets"), F.col("o_custkey").alias("registry_capacity"))
    return I.identity_audit(d, 100.0, 1000.0)


@plan("T2", """SELECT doc_id, generate_subscripts(l, 1) - 1 AS passage, unnest(l) AS body FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)""", wide="passage")
def passages(t: Tables) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: C.strip(s)), lambda s: s != "")
    return t.documents.select("doc_id", F.posexplode(lines).alias("passage", "body"))


@plan("X8", """SELECT first_event, requests FROM (SELECT min(event_id) AS first_event, count(*) AS requests FROM events GROUP BY event_type, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER)) WHERE requests > 1""")
def duplicate_requests(t: Tables) -> DataFrame:
    f = fingerprint(F.col("event_type"), F.col("user_id"), F.get_json_object("props", "$.k").alias("k"))
    g = t.events.groupBy(f.alias("f")).agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("requests"))
    return g.where(F.col("requests") > 1).select("first_event", "requests")


@plan("T3", """WITH h AS (SELECT doc_id, strpos(lower(text), 'token') AS p, text FROM documents WHERE contains(lower(text), 'token'))
    SELECT doc_id, substr(text, CAST(greatest(p - 24, 1) AS BIGINT), CAST(least(p - 1, 24) AS BIGINT)) || '⟦' || substr(text, p, 5) || '⟧' || substr(text, p + 5, 24) AS snippet FROM h""")
def search_snippets(t: Tables) -> DataFrame:
    hits = t.documents.where(F.lower("text").contains("token"))
    return hits.select("doc_id", X.snippet(F.col("text"), F.lit("token")).alias("snippet"))
