"""Event, ledger, thread, section and geometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.operators import events as E
from tallyscope.operators import statements as S
from tallyscope.plans import roles as R
from tallyscope.plans.registry import Tables, plan
from tallyscope.plans.roles import with_

UNION = """eu AS (SELECT 'sanction:' || rec AS event_id, 'sanction' AS family, role AS event_type, NULL AS parent_event_id, id AS registry_id, date AS event_date, fine AS amount, severity, NULL AS lifecycle FROM pen
    UNION ALL SELECT 'evaluation:' || rec, 'evaluation', CAST(partial AS VARCHAR), NULL, id, date, NULL, NULL, NULL FROM ev
    UNION ALL SELECT 'notice:' || s_suppkey, 'notice', 'bureau', NULL, NULL, NULL, NULL, NULL, 'published' FROM supplier
    UNION ALL SELECT 'action:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || CAST(round(l_extendedprice * 100) AS BIGINT), 'action', l_returnflag, 'notice:' || CASE WHEN l_quantity = 50 THEN -1 ELSE l_suppkey END, NULL, CAST(l_shipdate AS DATE), NULL, NULL,
      CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 7 THEN 'done' ELSE 'ordered' END FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT 'award:' || o_orderkey, 'award', o_orderpriority, NULL, o_custkey, CAST(o_orderdate AS DATE), o_totalprice, NULL, 'awarded' FROM orders WHERE o_orderstatus = 'F')"""


def all_events(t: Tables) -> DataFrame:
    c = F.col
    pen, ev = R.sanctions(t), R.evaluations(t)
    key = lambda prefix, *cols: F.concat(F.lit(prefix + ":"), F.concat_ws(":", *cols))
    action = key("action", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(c("l_extendedprice") * 100).cast("long"))
    return E.union_events([
        E.to_event_schema(pen, event_id=key("sanction", "rec"), family=F.lit("sanction"), event_type=c("role"), registry_id=c("id"), event_date=c("date"), amount=c("fine"), severity=c("severity")),
        E.to_event_schema(ev, event_id=key("evaluation", "rec"), family=F.lit("evaluation"), event_type=c("partial"), registry_id=c("id"), event_date=c("date")),
        E.to_event_schema(t.supplier, event_id=key("notice", "s_suppkey"), family=F.lit("notice"), event_type=F.lit("bureau"), lifecycle=F.lit("published")),
        E.to_event_schema(t.lineitem.where(c("l_returnflag") == "R"), event_id=action, family=F.lit("action"), event_type=c("l_returnflag"),
                          parent_event_id=F.concat(F.lit("notice:"), F.when(c("l_quantity") == 50, F.lit(-1).cast("long")).otherwise(c("l_suppkey"))), event_date=F.to_date("l_shipdate"),
                          lifecycle=F.when((c("l_linestatus") == "F") & (c("l_linenumber") == 7), "done").otherwise("ordered")),
        E.to_event_schema(t.orders.where(c("o_orderstatus") == "F"), event_id=key("award", "o_orderkey"), family=F.lit("award"), event_type=c("o_orderpriority"),
                          registry_id=c("o_custkey"), event_date=F.to_date("o_orderdate"), amount=c("o_totalprice"), lifecycle=F.lit("awarded"))])


@plan("D1 W21", with_("pen", "ev", more=UNION) + "SELECT event_id, family, event_type, parent_event_id, registry_id, event_date, amount, severity, lifecycle FROM eu")
def event_union(t: Tables) -> DataFrame:
    return all_events(t).select("event_id", "family", "event_type", "parent_event_id", "registry_id", "event_date", "amount", "severity", "lifecycle").orderBy(*E.timeline_order())


@plan("D1", with_("pen", "ev", more=UNION) + """SELECT event_id, 'unknown_parent' AS problem FROM eu WHERE family = 'action' AND parent_event_id NOT IN (SELECT event_id FROM eu WHERE family = 'notice')
    UNION ALL SELECT event_id, 'overstated' FROM eu WHERE family = 'action' AND lifecycle <> 'ordered' UNION ALL SELECT event_id, 'duplicate_id' FROM eu GROUP BY 1 HAVING count(*) > 1""")
def event_problems(t: Tables) -> DataFrame:
    return E.event_problems(all_events(t), {"action": "notice"})


AWARD = "o_custkey * 100 + month(o_orderdate)"


def award_rows(t: Tables) -> DataFrame:
    """Report rows of awards: a customer's orders of one calendar month, whatever the year."""
    return t.orders.select((F.col("o_custkey") * 100 + F.month("o_orderdate")).alias("award"), "o_orderkey", "o_orderstatus", F.year("o_orderdate").cast("long").alias("year"))


@plan("D4", f"""SELECT award, n_reports, o_orderstatus, first_year, last_year FROM (SELECT {AWARD} AS award, count(*) AS n_reports, min(o_orderstatus) AS o_orderstatus, max(o_orderstatus) AS m, min(year(o_orderdate)) AS first_year,
    max(year(o_orderdate)) AS last_year FROM orders GROUP BY 1) WHERE o_orderstatus = m""")
def collapsed_awards(t: Tables) -> DataFrame:
    good, _ = E.collapse_awards(award_rows(t), "award", ["o_orderstatus"], ["year"])
    return good.select("award", "n_reports", "o_orderstatus", F.col("first_report.year").alias("first_year"), F.col("last_report.year").alias("last_year"))


@plan("D4", f"""SELECT {AWARD} AS award, 'o_orderstatus' AS varying FROM orders GROUP BY 1 HAVING min(o_orderstatus) <> max(o_orderstatus)""")
def award_violations(t: Tables) -> DataFrame:
    return E.collapse_awards(award_rows(t), "award", ["o_orderstatus"], ["year"])[1].select("award", F.array_join("varying", ",").alias("varying"))


@plan("D4", f"""WITH r AS (SELECT {AWARD} AS award, o_orderkey, year(o_orderdate) AS year, o_orderstatus FROM orders)
    SELECT award, o_orderkey, year, row_number() OVER (PARTITION BY award ORDER BY year, o_orderkey) AS position FROM r WHERE award IN (SELECT award FROM r GROUP BY 1 HAVING min(o_orderstatus) = max(o_orderstatus))""", wide="position")
def award_reports(t: Tables) -> DataFrame:
    rows = award_rows(t)
    good, _ = E.collapse_awards(rows, "award", ["o_orderstatus"], ["year"])
    return E.award_reports(rows, good, "award", "year", "o_orderkey", []).select("award", "o_orderkey", "year", "position")


LEDGER = """lg AS (SELECT event_id AS entry, ts, CASE event_type WHEN 'signup' THEN 'reserve' WHEN 'purchase' THEN 'settle' WHEN 'error' THEN 'release' ELSE 'note' END AS kind,
    CASE WHEN event_type <> 'click' THEN user_id || '-' || (CAST(json_extract_string(props, '$.k') AS INTEGER) // 10) END AS rid, CASE WHEN value < 30 THEN 'feed' WHEN value < 60 THEN 'maps' ELSE 'free' END AS meter, value AS usd_max, value / 2 AS actual FROM events),
    rv AS (SELECT rid, max(entry) FILTER (kind = 'reserve') AS re, max(entry) FILTER (kind IN ('settle', 'release')) AS le FROM lg WHERE rid IS NOT NULL GROUP BY rid HAVING re IS NOT NULL),
    fo AS (SELECT rv.rid, r.ts, r.meter, CASE WHEN r.meter = 'feed' THEN strftime(CASE WHEN day(r.ts) >= 8 THEN date_trunc('month', r.ts) + INTERVAL 7 DAY ELSE date_trunc('month', r.ts) - INTERVAL 1 MONTH + INTERVAL 7 DAY END, '%Y-%m-%d')
      ELSE strftime(r.ts, '%Y-%m') END AS period, CASE WHEN le > re THEN l.kind ELSE 'reserve' END AS state, CASE WHEN le > re THEN CASE l.kind WHEN 'settle' THEN l.actual ELSE 0 END ELSE r.usd_max END AS usd
      FROM rv JOIN lg r ON r.entry = re LEFT JOIN lg l ON l.entry = le)"""


def ledger_log(t: Tables) -> DataFrame:
    return ledger_columns(t.events)


def ledger_columns(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "reserve").when(F.col("event_type") == "purchase", "settle").when(F.col("event_type") == "error", "release").otherwise("note")
    meter = F.when(F.col("value") < 30, "feed").when(F.col("value") < 60, "maps").otherwise("free")
    k = F.get_json_object("props", "$.k").cast("int")
    rid = F.when(F.col("event_type") != "click", F.concat_ws("-", "user_id", F.floor(k / 10)))
    return events.select(F.col("event_id").alias("entry"), "ts", kind.alias("kind"), rid.alias("reservation_id"), meter.alias("meter"),
                         E.billing_period(F.col("ts"), meter, "feed", 8).alias("period"), F.col("value").alias("usd_max"), (F.col("value") / 2).alias("actual_usd"))


@plan("A26", with_(more=LEDGER) + "SELECT rid AS reservation_id, meter, period, state, round(usd, 4) AS usd FROM fo")
def ledger_fold(t: Tables) -> DataFrame:
    return E.fold_ledger(ledger_log(t)).select("reservation_id", "meter", "period", "state", F.round("usd", 4).alias("usd"))


@plan("A26 X5", with_(more=LEDGER) + """SELECT meter, period, round(sum(usd), 4) AS usd, count(*) FILTER (state = 'reserve') AS unsettled, count(*) AS entries FROM fo WHERE meter IN ('feed', 'maps') GROUP BY 1, 2""")
def spend_by_period(t: Tables) -> DataFrame:
    return E.spend_by_period(E.fold_ledger(ledger_log(t)), ["feed", "maps"])


@plan("A27", with_(more=LEDGER) + """, dy AS (SELECT CAST(ts AS DATE) AS d, sum(usd) AS day_spent FROM fo WHERE meter IN ('feed', 'maps') GROUP BY 1), mo AS (SELECT period, sum(usd) AS s FROM fo WHERE meter = 'maps' GROUP BY 1)
    SELECT event_id, CASE WHEN value > 120 THEN 'run' WHEN value > greatest(0, 1500 - coalesce(day_spent, 0)) THEN 'day' WHEN value > greatest(0, 22000 - coalesce(s, 0)) THEN 'month' END AS cap
    FROM events LEFT JOIN dy ON d = CAST(ts AS DATE) LEFT JOIN mo ON period = strftime(ts, '%Y-%m') WHERE event_type = 'view'""")
def spend_gate(t: Tables) -> DataFrame:
    live = E.fold_ledger(ledger_log(t)).where(F.col("meter").isin("feed", "maps"))
    day = live.groupBy(F.to_date("ts").alias("d")).agg(F.sum("usd").alias("day_spent"))
    month = live.where(F.col("meter") == "maps").groupBy("period").agg(F.sum("usd").alias("month_spent"))
    asked = t.events.where(F.col("event_type") == "view").withColumns({"d": F.to_date("ts"), "period": F.date_format("ts", "yyyy-MM")})
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return asked.join(day, "d", "left").join(month, "period", "left").select(
        "event_id", E.spend_gate(F.col("value"), z("day_spent"), z("month_spent"), 120.0, 1500.0, 22000.0).alias("cap"))


# --- threads -----------------------------------------------------------------

@plan("J18", """WITH RECURSIVE p AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn = 5 AND length(text) < 150 THEN conv_id * 100 + 6 ELSE conv_id * 100 + turn - 1 END AS parent FROM conversations WHERE turn = 0 OR length(text) > 40),
    w AS (SELECT id, id AS at, parent, 0 AS n FROM p UNION ALL SELECT w.id, w.parent, p.parent, n + 1 FROM w JOIN p ON p.id = w.parent WHERE n < 50)
    SELECT id, max(root) AS root FROM (SELECT w.id, CASE WHEN w.parent IS NULL THEN w.at WHEN NOT EXISTS (SELECT 1 FROM p q WHERE q.id = w.parent) THEN w.parent END AS root FROM w) GROUP BY id""")
def thread_root(t: Tables) -> DataFrame:
    turn, size = F.col("turn"), F.length("text")
    me = F.col("conv_id") * 100 + turn
    parent = F.when(turn == 0, F.lit(None)).when((turn == 5) & (size < 150), F.col("conv_id") * 100 + 6).otherwise(me - 1)
    return E.thread_roots(t.conversations.where((turn == 0) | (size > 40)).select(me.alias("id"), parent.alias("parent")))


@plan("A34 W23", """SELECT conv_id AS root, count(*) AS posts_in_thread, count(*) FILTER (role = 'assistant' AND turn = 0) AS mentions, count(*) FILTER (role = 'assistant' AND turn > 0) AS replies,
    count(DISTINCT role) FILTER (role <> 'assistant') AS other_institutions, NOT bool_or(turn = 0 AND length(text) > 120) AS root_missing, max(turn) AS last_activity FROM conversations
    WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant') AND (turn > 0 OR length(text) > 120) GROUP BY conv_id""")
def thread_panel(t: Tables) -> DataFrame:
    posts = t.conversations.where((F.col("turn") > 0) | (F.length("text") > 120))
    touched = t.conversations.where(F.col("role") == "assistant").select("conv_id")
    mine = F.col("role") == "assistant"
    return posts.join(touched, "conv_id", "left_semi").groupBy(F.col("conv_id").alias("root")).agg(
        F.count(F.lit(1)).alias("posts_in_thread"), F.count_if(mine & (F.col("turn") == 0)).alias("mentions"), F.count_if(mine & (F.col("turn") > 0)).alias("replies"),
        F.count_distinct(F.when(~mine, F.col("role"))).alias("other_institutions"), (~F.bool_or(F.col("turn") == 0)).alias("root_missing"), F.max("turn").alias("last_activity"))


@plan("A20", """SELECT user_id AS id, count(DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER)) AS roots, count(*) FILTER (event_type = 'view') AS mentions, count(*) FILTER (event_type = 'click') AS replies,
    count(*) FILTER (event_type = 'error') AS ch_error, count(*) FILTER (event_type = 'purchase') AS ch_purchase, arg_max(event_type, (ts, event_id)) AS latest_source, CAST(max(ts) AS DATE) AS last_date FROM events GROUP BY 1
    HAVING max(ts) >= TIMESTAMP '2024-01-30' AND count(*) FILTER (event_type = 'error') > 0""")
def social_browse(t: Tables) -> DataFrame:
    of = lambda e: F.count_if(F.col("event_type") == e)
    g = t.events.groupBy(F.col("user_id").alias("id")).agg(
        F.count_distinct(F.get_json_object("props", "$.k").cast("int")).alias("roots"), of("view").alias("mentions"), of("click").alias("replies"),
        of("error").alias("ch_error"), of("purchase").alias("ch_purchase"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest_source"), F.max("ts").alias("_last"))
    return g.where((F.col("_last") >= F.lit("2024-01-30").cast("timestamp")) & (F.col("ch_error") > 0)).withColumn("last_date", F.to_date("_last")).drop("_last")


@plan("A21", """SELECT count(*) AS total, count(*) FILTER (value >= 20) AS attributed, count(*) FILTER (value < 20) AS unattributed, count(*) FILTER (event_type = 'view') AS roots,
    count(*) FILTER (event_type <> 'view') AS replies, CAST(max(ts) AS DATE) AS latest FROM events""")
def store_stats(t: Tables) -> DataFrame:
    inst = F.when(F.col("value") >= 20, F.col("user_id"))
    root = F.col("event_type") == "view"
    return t.events.agg(F.count(F.lit(1)).alias("total"), F.count(inst).alias("attributed"), F.count_if(inst.isNull()).alias("unattributed"),
                        F.count_if(root).alias("roots"), F.count_if(~root).alias("replies"), F.to_date(F.max("ts")).alias("latest"))


@plan("A28 X8", """SELECT channel, n, institutions, CASE WHEN bad = n THEN 'unusable' WHEN bad > 0 THEN 'partial' ELSE 'complete' END AS completeness FROM (SELECT CAST(ts AS DATE) AS channel, count(*) AS n, count(DISTINCT user_id) AS institutions,
    count(*) FILTER (event_type = 'error' AND value > 90) AS bad FROM events GROUP BY 1)""")
def sweep_summary(t: Tables) -> DataFrame:
    failed = (F.col("event_type") == "error") & (F.col("value") > 90)
    return t.events.groupBy(F.to_date("ts").alias("channel")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("institutions"),
        F.when(F.bool_and(failed), "unusable").when(F.bool_or(failed), "partial").otherwise("complete").alias("completeness"))


@plan("J24", "SELECT event_id, user_id FROM events WHERE value < 5 ORDER BY ts DESC, event_id DESC LIMIT 50")
def unattributed_queue(t: Tables) -> DataFrame:
    # The filter comes before the limit; ordering with a limit is a top-k per partition, then a merge.
    return t.events.where(F.col("value") < 5).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


@plan("A30", """SELECT 'orders' AS source, count(*) AS rows, CAST(NULL AS BIGINT) AS nested FROM orders UNION ALL SELECT 'events', count(*), count(*) FILTER (props LIKE '%k%') FROM events
    UNION ALL SELECT 'embeddings', count(*), CAST(sum(len(embedding)) AS BIGINT) FROM embeddings UNION ALL SELECT 'lineitem', count(*), NULL FROM lineitem""")
def source_inventory(t: Tables) -> DataFrame:
    one = lambda d, name, nested: d.agg(F.count(F.lit(1)).alias("rows"), nested.cast("long").alias("nested")).select(F.lit(name).alias("source"), "rows", "nested")
    none = F.max(F.lit(None).cast("long"))
    props = F.size(F.map_keys(F.from_json("props", "map<string,int>")))
    return (one(t.orders, "orders", none).unionByName(one(t.events, "events", F.sum(props)))
            .unionByName(one(t.embeddings, "embeddings", F.sum(F.size("embedding")))).unionByName(one(t.lineitem, "lineitem", none)))


# --- lines, sections, coordinates ---------------------------------------------

GAPS = """pt AS (SELECT event_type AS k, epoch(ts) AS x FROM events), fl AS (SELECT k, x, CASE WHEN x - lag(x) OVER w > 1200 OR lag(x) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM pt WINDOW w AS (PARTITION BY k ORDER BY x)),
    cl AS (SELECT k, x, sum(b) OVER (PARTITION BY k ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM fl),
    gc AS (SELECT k, min(x) AS cluster_start, max(x) AS cluster_end, avg(x) AS center, count(*) AS support FROM cl GROUP BY k, c HAVING count(*) >= 3)"""


def points(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("k"), "event_id", (F.unix_micros(C.utc_instant(F.col("ts"))) / 1e6).alias("x"))


@plan("W13", with_(more=GAPS) + "SELECT k, round(cluster_start, 3) AS cluster_start, round(cluster_end, 3) AS cluster_end, round(center, 2) AS center, support FROM gc")
def gap_clusters(t: Tables) -> DataFrame:
    return E.gap_clusters(points(t), ["k"], "x", 1200.0, 3).select(
        "k", F.round("cluster_start", 3).alias("cluster_start"), F.round("cluster_end", 3).alias("cluster_end"), F.round("center", 2).alias("center"), "support")


@plan("W14", with_(more=GAPS) + """SELECT event_id, round(arg_min(g.center, (abs(g.center - e.x), g.center)) FILTER (abs(g.center - e.x) <= 900), 2) AS center FROM (SELECT event_id, event_type AS k, epoch(ts) AS x FROM events) e
    LEFT JOIN gc g ON g.k = e.k AND abs(g.center - e.x) <= 1000 GROUP BY event_id""")
def nearest_center(t: Tables) -> DataFrame:
    centers = E.gap_clusters(points(t), ["k"], "x", 1200.0, 3).select("k", "center")
    return E.nearest_center(points(t), centers, ["k"], "x", 900.0).select("event_id", F.round("center", 2).alias("center"))


@plan("W12", """SELECT p_partkey AS id, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'rod') OR contains(p_name, 'ring') THEN 'round' WHEN contains(p_type, 'red') THEN 'red'
    WHEN contains(p_type, 'SMALL') THEN 'small' ELSE 'unrouted' END AS section FROM part""")
def section_router(t: Tables) -> DataFrame:
    routes = [("red", ["red"]), ("round", ["rod", "ring"]), ("small", ["SMALL"])]
    return t.part.select(F.col("p_partkey").alias("id"), S.route(F.col("p_name"), F.col("p_type"), routes).alias("section"))


@plan("W11", """WITH p AS (SELECT l_suppkey AS r, l_orderkey AS page, CASE WHEN max(l_quantity) > 25 THEN min(l_returnflag) END AS s FROM lineitem GROUP BY 1, 2),
    b AS (SELECT *, CASE WHEN page - lag(page) OVER w = 1 THEN 0 ELSE 1 END AS brk FROM p WINDOW w AS (PARTITION BY r ORDER BY page)),
    g AS (SELECT *, sum(brk) OVER (PARTITION BY r ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM b),
    f AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY r, run ORDER BY page ROWS UNBOUNDED PRECEDING) AS got FROM g)
    SELECT r, page, coalesce(got, 'unrouted') AS resolved, s IS NULL AND got IS NOT NULL AS inherited FROM f""")
def section_runs(t: Tables) -> DataFrame:
    pages = t.lineitem.groupBy(F.col("l_suppkey").alias("r"), F.col("l_orderkey").alias("page")).agg(
        F.coalesce(F.when(F.max("l_quantity") > 25, F.min("l_returnflag")), F.lit("unrouted")).alias("s"))
    return S.inherit_sections(pages, ["r"], "page", "s", F.col("s") == "unrouted", span=512).select("r", "page", "resolved", "inherited")


@plan("W15", """WITH e AS (SELECT l_suppkey AS r, l_linenumber AS section, min(l_orderkey) AS start FROM lineitem GROUP BY 1, 2), d AS (SELECT r, start, min(section) AS section FROM e GROUP BY 1, 2)
    SELECT r, section, start, coalesce(lead(start) OVER (PARTITION BY r ORDER BY start) - 1, 20000) AS page_end FROM d""")
def toc_ranges(t: Tables) -> DataFrame:
    e = t.lineitem.groupBy(F.col("l_suppkey").alias("r"), F.col("l_linenumber").alias("section")).agg(F.min("l_orderkey").alias("start"))
    d = e.groupBy("r", "start").agg(F.min("section").alias("section"))
    return S.section_ranges(d, "r", "start", F.lit(20000)).select("r", "section", "start", "page_end")


@plan("W16", """WITH f AS (SELECT l_suppkey AS r, year(l_shipdate) AS y, l_returnflag || l_linestatus AS label, arg_min(CASE WHEN l_discount <> 0 THEN l_discount END, (l_orderkey, l_linenumber, l_partkey)) AS dv,
    min((l_orderkey, l_linenumber, l_partkey)) AS p FROM lineitem WHERE l_tax <> 0 GROUP BY 1, 2, 3),
    x AS (SELECT r, y, label, (SELECT CASE WHEN l_discount <> 0 THEN l_discount END FROM lineitem WHERE l_suppkey = r AND l_orderkey = p[1] AND l_linenumber = p[2] AND l_partkey = p[3] AND year(l_shipdate) = y AND l_tax <> 0 AND l_returnflag || l_linestatus = label LIMIT 1) AS v FROM f)
    SELECT r, label, y, CASE WHEN v IS NULL THEN 'blank' ELSE CAST(v AS VARCHAR) END AS shown FROM x""", wide="y")
def compare_years(t: Tables) -> DataFrame:
    """First aligned value of every year and label; a blank cell is told apart from an absent row."""
    d = t.lineitem.where(F.col("l_tax") != 0).groupBy(F.col("l_suppkey").alias("r"), F.year("l_shipdate").alias("y"), F.concat("l_returnflag", "l_linestatus").alias("label")).agg(
        F.min_by(F.struct(F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("v")), F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("c"))
    return d.select("r", "label", "y", F.coalesce(F.col("c.v").cast("string"), F.lit("blank")).alias("shown"))


@plan("M13", """WITH p AS (SELECT DISTINCT n_name AS district, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey),
    e AS (SELECT a.district, a.x, a.y, b.x AS bx, b.y AS byy FROM p a JOIN p b ON a.district = b.district AND (a.x, a.y) <> (b.x, b.y)),
    bad AS (SELECT DISTINCT e.district, e.x, e.y, e.bx, e.byy FROM e JOIN p r ON r.district = e.district WHERE (e.bx - e.x) * (r.y - e.y) - (e.byy - e.y) * (r.x - e.x) < 0
      OR ((e.bx - e.x) * (r.y - e.y) - (e.byy - e.y) * (r.x - e.x) = 0 AND (r.x - e.x) * (e.bx - e.x) + (r.y - e.y) * (e.byy - e.y) > (e.bx - e.x) * (e.bx - e.x) + (e.byy - e.y) * (e.byy - e.y)))
    SELECT DISTINCT district, x, y FROM e WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.district = e.district AND b.x = e.x AND b.y = e.y AND b.bx = e.bx AND b.byy = e.byy)
    UNION ALL SELECT district, min(x), min(y) FROM p GROUP BY district HAVING count(*) = 1""")
def district_hull(t: Tables) -> DataFrame:
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("district"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    return E.district_hulls(d, "district", "x", "y").drop("vertex")


@plan("X5", """SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_totals(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        "event_type", F.to_date("w.start").alias("day"), "n", "total")


@plan("A32", with_("panel", "feat", more="""f AS (SELECT entity, string_agg(year || ':' || CAST(round(open_share, 4) AS VARCHAR), ',' ORDER BY year) AS series FROM feat GROUP BY entity),
    c AS (SELECT entity, string_agg(year || ' ' || st, ',' ORDER BY -year, st) AS findings FROM (SELECT entity, year, CASE WHEN levy_rate > 0.0401 THEN 'fail' ELSE 'pass' END AS st FROM feat) GROUP BY entity)""")
      + "SELECT f.entity, findings, length(series) > 10 AS has_series, (SELECT count(*) FROM feat x WHERE x.entity = f.entity) AS n_years FROM f JOIN c ON c.entity = f.entity")
def dossiers(t: Tables) -> DataFrame:
    """Nested dossier per entity; series and findings hold one entry per year."""
    d = R.panel_ratios(t)
    state = F.when(F.col("levy_rate") > 0.0401, "fail").otherwise("pass")
    g = d.groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("year", "open_share"))).alias("series"),
        F.array_sort(F.collect_list(F.struct((-F.col("year")).alias("y"), state.alias("st")))).alias("findings"))
    return g.select("entity", F.array_join(F.transform("findings", lambda f: F.concat_ws(" ", -f["y"], f["st"])), ",").alias("findings"),
                    (F.size("series") > 0).alias("has_series"), F.size("series").cast("long").alias("n_years"))
