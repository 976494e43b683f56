"""Queries stay exact when one key holds a third of all rows and groups are cut into buckets."""

import os
import random
import shutil
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyscope.operators import ordering  # noqa: E402
from tallyscope.operators import statements as S  # noqa: E402
from tallyscope.plans.catalogue import PLANS  # noqa: E402
from tallyscope.plans.registry import TABLES  # noqa: E402
from verify import rows_of  # noqa: E402

HOT = {
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) FROM t",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 11 ELSE l_orderkey END AS l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey) FROM t",
    "customer": "SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 4::INT ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment) FROM t",
    "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM t WHERE doc_id = 1) ELSE text END AS text) FROM t",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM t",
}
QUERIES = ["features_asof", "leave_one_out_group_rate", "district_standardised_ratio", "per_town_topn", "univariate_separation", "rank_auc", "cume_percentile",
           "peer_robust_z", "rank_percentile_in_year", "staffing_exclusive_quartiles", "occurrence_keys", "document_counts", "sanction_groups", "rekey_pairs",
           "attribution", "full_text_containment", "verbatim_echo", "ledger_fold", "gap_clusters", "section_runs", "policy_checks_long", "matched_controls",
           "district_hull", "candidate_links", "compliance_summary"]


@pytest.fixture(scope="module")
def hot(small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    for name in TABLES:
        if name in HOT:
            con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{small}/{name}.parquet'")
            con.execute(f"COPY ({HOT[name]}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        else:
            shutil.copy(f"{small}/{name}.parquet", folder / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", QUERIES)
def test_hot_keys(spark, hot, name, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 20)
    folder, con = hot
    df = PLANS[name](spark, folder)
    rel = con.execute(PLANS[name].sql)
    cols = [d[0] for d in rel.description]
    assert rows_of(df.columns, df.collect()) == rows_of(cols, rel.fetchall())


def test_wide_facts_sort_dealt_partitions(spark):
    """Facts are dealt by key in bounded partitions before the aggregate that sorts them; a hot key keeps its first values."""
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 40), rng.choice("ANR"), rng.choice(["qty", "tax", "price"]), rng.choice([0.0, 1.5, 2.5]), i, rng.random()) for i in rng.sample(range(9000), 3000)]
    d = S.wide_facts(spark.createDataFrame(rows, "k int, section string, item string, value double, a int, b double"), ["k"], ["qty", "tax", "none"], F.struct("a", "b"))
    want = {}
    for k, section, item, value, a, b in sorted(rows, key=lambda r: r[4:]):
        one = want.setdefault(k, (set(), {}))
        one[0].add(section)
        one[1].setdefault(item, value)
    assert {(r.k, r.n_sections, r.qty, r.tax, r.none) for r in d.collect()} == {(k, len(s), v.get("qty"), v.get("tax"), None) for k, (s, v) in want.items()}
    assert "REBALANCE_PARTITIONS_BY_COL" in d._jdf.queryExecution().executedPlan().toString()
