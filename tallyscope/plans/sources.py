"""Source and sink queries on texts that Spark derives from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.sources import readers as D
from tallyscope.sources import sinks as W
from tallyscope.plans.registry import Tables, plan


def raw_sanctions(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderpriority").startswith("5"), "n/a").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("date"),
        F.when(s == "F", F.floor("o_totalprice").cast("string")).when(s == "O", "").alias("fine"),
        F.when((s == "F") | F.col("o_orderpriority").startswith("1"), "1").otherwise("0").alias("is_monetary"),
        F.when(F.col("o_orderpriority").startswith("2") & (s == "P"), "other").otherwise("fine").alias("sanction_type"), F.lit("x").alias("actor_role"))


S1 = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority NOT LIKE '5%' THEN CAST(o_orderdate AS DATE) END AS date, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END AS fine,
    (o_orderstatus <> 'F' AND o_orderpriority LIKE '1%') OR (o_orderpriority LIKE '2%' AND o_orderstatus = 'P') AS bad FROM orders)"""


@plan("S1", "WITH " + S1 + " SELECT CAST(id AS VARCHAR) AS id, date, fine FROM r WHERE NOT bad")
def sanction_table_typed(t: Tables) -> DataFrame:
    return D.typed_sanctions(raw_sanctions(t))[0].select("id", "date", "fine")


@plan("S1", "WITH " + S1 + " SELECT CAST(id AS VARCHAR) AS id FROM r WHERE bad")
def sanction_table_contradictions(t: Tables) -> DataFrame:
    return D.typed_sanctions(raw_sanctions(t))[1].select("id")


@plan("S2", """SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(l_orderkey AS VARCHAR) AS plate_no, CASE l_returnflag WHEN 'N' THEN 'active' WHEN 'A' THEN 'inactive' ELSE 'unknown' END AS state,
    CASE WHEN l_linestatus = 'O' THEN CAST(date_trunc('month', l_shipdate) AS DATE) END AS built FROM lineitem""")
def assets_flattened(t: Tables) -> DataFrame:
    rec = F.struct(F.col("l_orderkey").cast("string").alias("plate_no"), F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyyMM")).otherwise("?").alias("on_production_date"),
                   F.when(F.col("l_returnflag") == "N", "本區新領 ").when(F.col("l_returnflag") == "A", "繳銷").otherwise("待查").alias("txn_name"))
    raw = t.lineitem.select(F.to_json(F.create_map(F.col("l_suppkey").cast("string"), F.array(rec))).alias("value"))
    return D.flatten_assets(raw).select("id", "plate_no", "state", "built")


@plan("S3", """SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderstatus || '：' || o_orderkey AS actor FROM orders""")
def actors_inverted(t: Tables) -> DataFrame:
    rec = F.struct(F.col("o_custkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("第8條").alias("law"), F.lit("停辦").alias("punishment"))
    raw = t.orders.select(F.to_json(F.create_map(F.concat("o_orderstatus", F.lit("："), "o_orderkey"), F.array(rec))).alias("value"))
    return D.invert_actors(raw).select("id", "date", "actor")


@plan("S4", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS lon, CASE WHEN c_acctbal > 0 THEN CAST(c_nationkey AS DOUBLE) END AS lat FROM customer""")
def feature_points(t: Tables) -> DataFrame:
    xy = F.when(F.col("c_acctbal") > 0, F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")))
    f = F.struct(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title")).alias("properties"), F.struct(xy.alias("coordinates")).alias("geometry"))
    raw = t.customer.select(F.to_json(F.struct(F.array(f).alias("features"))).alias("value"))
    return D.feature_points(raw, "id:string,title:string")


@plan("S5", """SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 1) AS url_lang, regexp_extract(html, 'lang="([a-z]+)"', 1) AS page_lang,
    regexp_extract(url, '^https?://[^/]+/([a-z]+)/([0-9]+)', 1) = regexp_extract(html, 'lang="([a-z]+)"', 1) AS agrees FROM pages""")
def page_identity(t: Tables) -> DataFrame:
    url = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/([0-9]+)", 1)
    own = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    return t.pages.select("page_id", url.alias("url_lang"), own.alias("page_lang"), (url == own).alias("agrees"))


@plan("S6", """SELECT l_orderkey, 'age' || l_linenumber AS age_group, CASE WHEN month(l_shipdate) < 7 THEN '上學期' ELSE '下學期' END AS semester, l_returnflag AS class_type, l_linestatus AS item,
    l_extendedprice AS unit_price, CASE WHEN l_tax <> 0 THEN l_quantity END AS subtotal FROM lineitem WHERE l_tax <> 0 OR l_extendedprice > 50000""")
def fee_slip_lines(t: Tables) -> DataFrame:
    d = t.lineitem.where((F.col("l_tax") != 0) | (F.col("l_extendedprice") > 50000) | (F.col("l_discount") >= 0))
    shown = (F.col("l_tax") != 0) | (F.col("l_extendedprice") > 50000)
    cell = F.struct(F.when(shown, F.format_string("%,.2f", "l_extendedprice")).otherwise("").alias("單價"), F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("string")).otherwise("").alias("小計"))
    block = F.struct(F.lit("6").alias("months"), F.create_map("l_returnflag", F.create_map("l_linestatus", cell)).alias("class"))
    slip = F.create_map(F.concat(F.lit("age"), "l_linenumber"), F.create_map(F.when(F.month("l_shipdate") < 7, "上學期").otherwise("下學期"), block))
    raw = d.select("l_orderkey", F.to_json(F.struct(slip.alias("slip"))).alias("payload"))
    return D.fee_lines(raw, ["l_orderkey"]).select("l_orderkey", "age_group", "semester", "class_type", "item", "unit_price", "subtotal")


@plan("S8", """SELECT CASE WHEN event_type = 'error' THEN 'e' || event_id ELSE event_type || event_id END AS text, CASE WHEN event_type = 'view' THEN NULL ELSE 'u' || user_id END AS url, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
    CAST(user_id AS VARCHAR) AS author FROM events WHERE event_type <> 'signup'""")
def feed_records(t: Tables) -> DataFrame:
    e, day = F.col("event_type"), F.date_format("ts", "yyyy-MM-dd")
    author = F.col("user_id").cast("string")
    url = F.concat(F.lit("u"), author)
    text = F.concat(e, F.col("event_id").cast("string"))
    plain = F.to_json(F.struct(F.lit("").alias("text"), text.alias("content"), url.alias("permalink"), day.alias("createdAt"), author.alias("username")))
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("text")).alias("title"), url.alias("link"), day.alias("date"), author.alias("author"))).alias("items")))
    bare = F.to_json(F.array(F.struct(text.alias("body"), day.alias("timestamp"), author.alias("user"))))
    empty = F.to_json(F.struct(url.alias("url"), day.alias("date")))
    value = F.when(e == "error", nested).when(e == "view", bare).when(e == "signup", empty).otherwise(plain)
    return D.feed_rows(t.events.select(value.alias("value")))


@plan("S9", """SELECT doc_id, CASE WHEN source = 'src3' THEN 'mismatch' WHEN source = 'src4' THEN 'missing_hash' ELSE 'ok' END AS state FROM documents""")
def content_against_manifest(t: Tables) -> DataFrame:
    listed = F.when(F.col("source") == "src3", F.sha2(F.concat("text", F.lit("x")), 256)).when(F.col("source") != "src4", F.sha2("text", 256))
    manifest = t.documents.select("doc_id", listed.alias("sha256"), F.octet_length("text").alias("bytes"))
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.octet_length("text").alias("b")).join(manifest, "doc_id")
    return d.select("doc_id", F.when(F.col("sha256").isNull(), "missing_hash").when((F.col("h") != F.col("sha256")) | (F.col("b") != F.col("bytes")), "mismatch").otherwise("ok").alias("state"))


@plan("S11 S10", """SELECT sha256(text) AS key, min(doc_id) AS doc_id FROM documents WHERE source <> 'src1' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src1') GROUP BY 1""")
def append_only_new(t: Tables) -> DataFrame:
    d = t.documents.select(F.sha2("text", 256).alias("key"), "doc_id", "source")
    return W.new_rows(d.where(F.col("source") == "src1"), d.where(F.col("source") != "src1"), "key", ["doc_id"]).select("key", "doc_id")


@plan("S12 X2", "SELECT event_id FROM events WHERE event_type <> 'error' AND user_id <> 7 AND ts >= TIMESTAMP '2024-01-10'")
def fresh_rows(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    d = t.events.select("event_id", F.when(F.col("user_id") != 7, F.col("user_id")).alias("k"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"))
    return D.fresh_rows(d, F.col("k"), F.col("at"), F.to_timestamp(F.lit("2024-01-10"))).select("event_id")


@plan("S14", r"""SELECT page_id, generate_subscripts(l, 1) - 1 AS position, regexp_extract(unnest(l), 'href="([^"]*)"', 1) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>') AS l FROM pages)""", wide="position")
def page_links(t: Tables) -> DataFrame:
    return D.page_records(t.pages, "page_id").select("page_id", "position", "href")


@plan("S14", r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@plan("S15", """SELECT o_orderstatus AS family, 'orders' AS output, count(*) AS records, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1""")
def lineage_rows(t: Tables) -> DataFrame:
    return W.lineage(t.orders, "orders", "o_orderkey", F.col("o_orderstatus")).drop("fingerprint")
