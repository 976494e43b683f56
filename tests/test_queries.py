"""Every registered query with an oracle gives the oracle's rows on the smallest data."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyscope.plans.catalogue import PLANS  # noqa: E402
from tallyscope.plans.registry import TABLES  # noqa: E402
from verify import rows_of  # noqa: E402


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, p in PLANS.items() if p.sql))
def test_query_equals_oracle(spark, small, duck, name):
    df = PLANS[name](spark, small)
    rel = duck.execute(PLANS[name].sql)
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, rel.fetchall())
