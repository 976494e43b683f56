"""Roles of the audit model played by the supplied tables, and the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.plans.registry import Tables

AS_OF = "1999-07-01"


def institutions(t: Tables) -> DataFrame:
    c, n = t.customer, t.nation
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("kind"), F.col("n_name").alias("town"),
        F.col("c_acctbal").alias("capacity"),
        F.concat_ws("/", "n_name", "c_mktsegment").alias("operator"))


def sanctions(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("rec"), F.col("o_custkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("severity"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("fine"),
        F.col("o_orderstatus").alias("role"))


def evaluations(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == "O").select(
        F.col("o_orderkey").alias("rec"), F.col("o_custkey").alias("id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").startswith("1").cast("int").alias("partial"))


def assets(t: Tables) -> DataFrame:
    """Assets of an institution: the lines of its orders."""
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("id"), F.to_date("l_shipdate").alias("built"),
        F.when(F.col("l_returnflag") == "N", "active").otherwise("inactive").alias("state"))


def panel(t: Tables) -> DataFrame:
    year = F.year("l_shipdate")
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    open_qty = F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("entity"), year.alias("year")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"),
        F.sum(price).alias("gross"), F.sum(price * (1 - disc)).alias("net"),
        F.sum(price * disc).alias("rebate"), F.sum(price * tax).alias("levy"),
        F.sum(open_qty).alias("open_qty"))


def panel_ratios(t: Tables) -> DataFrame:
    p = panel(t)
    return p.select(
        "entity", "year",
        C.ratio(F.col("gross"), F.col("qty")).alias("unit_price"),
        C.ratio(F.col("rebate"), F.col("gross")).alias("rebate_share"),
        C.ratio(F.col("levy"), F.col("net")).alias("levy_rate"),
        C.ratio(F.col("qty"), F.col("n_lines")).alias("line_size"),
        C.ratio(F.col("open_qty"), F.col("qty")).alias("open_share"))


FEATURES = ["unit_price", "rebate_share", "levy_rate", "line_size", "open_share"]

# The same roles as SQL table expressions, for the oracle side.
CTE = {
    "inst": """inst AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS kind, n_name AS town,
        c_acctbal AS capacity, n_name || '/' || c_mktsegment AS operator
        FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "pen": """pen AS (SELECT o_orderkey AS rec, o_custkey AS id, CAST(o_orderdate AS DATE) AS date,
        6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS severity,
        CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS fine, o_orderstatus AS role FROM orders)""",
    "ev": """ev AS (SELECT o_orderkey AS rec, o_custkey AS id, CAST(o_orderdate AS DATE) AS date,
        CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS partial FROM orders WHERE o_orderstatus = 'O')""",
    "asset": """asset AS (SELECT o_custkey AS id, CAST(l_shipdate AS DATE) AS built,
        CASE WHEN l_returnflag = 'N' THEN 'active' ELSE 'inactive' END AS state
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "panel": """panel AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_lines,
        sum(l_quantity) AS qty, sum(l_extendedprice) AS gross, sum(l_extendedprice * (1 - l_discount)) AS net,
        sum(l_extendedprice * l_discount) AS rebate, sum(l_extendedprice * l_tax) AS levy,
        sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS open_qty FROM lineitem GROUP BY 1, 2)""",
    "feat": """feat AS (SELECT entity, year, gross / nullif(qty, 0) AS unit_price,
        rebate / nullif(gross, 0) AS rebate_share, levy / nullif(net, 0) AS levy_rate,
        qty / nullif(n_lines, 0) AS line_size, open_qty / nullif(qty, 0) AS open_share FROM panel)""",
    "long": """long AS (SELECT * FROM (
        SELECT entity, year, 'unit_price' AS feature, unit_price AS value FROM feat UNION ALL
        SELECT entity, year, 'rebate_share', rebate_share FROM feat UNION ALL
        SELECT entity, year, 'levy_rate', levy_rate FROM feat UNION ALL
        SELECT entity, year, 'line_size', line_size FROM feat UNION ALL
        SELECT entity, year, 'open_share', open_share FROM feat) WHERE value IS NOT NULL)""",
}


def with_(*names: str, more: str = "") -> str:
    """A WITH clause of the named role expressions (and more, if given)."""
    parts = [CTE[n] for n in names] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n"


def hinge_sql(source: str, by: str, value: str = "value") -> str:
    """SQL body computing n, median, q1, q3 per ``by`` from a list of sorted values."""
    return f"""SELECT {by}, n, (s[(n+1)//2] + s[n//2+1]) / 2 AS median,
        CASE WHEN n >= 4 THEN (s[(n//2+1)//2] + s[(n//2)//2+1]) / 2 END AS q1,
        CASE WHEN n >= 4 THEN (s[(n+1)//2 + (n//2+1)//2] + s[(n+1)//2 + (n//2)//2+1]) / 2 END AS q3
        FROM (SELECT {by}, count(*) AS n, list({value} ORDER BY {value}) AS s FROM {source} GROUP BY {by})"""


def scales_sql(source: str, by: str, name: str = "sc") -> str:
    """Table expressions ending in ``name``: n, median, mad, scale per ``by``."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in by.split(","))
    return f"""{name}_h AS ({hinge_sql(source, by)}),
    {name}_d AS (SELECT {', '.join('a.' + k.strip() for k in by.split(','))}, median(abs(a.value - b.median)) AS mad
        FROM {source} a JOIN {name}_h b ON {on} GROUP BY {', '.join('a.' + k.strip() for k in by.split(','))}),
    {name} AS (SELECT a.*, b.mad, greatest(CASE WHEN b.mad > 0 THEN 1.4826 * b.mad END,
        CASE WHEN a.q3 > a.q1 THEN (a.q3 - a.q1) / 1.349 END) AS scale
        FROM {name}_h a JOIN {name}_d b ON {on})"""
