"""Exact top-k against all inner products."""

import math
import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from tallyscope.llm.queries import LLM_QUERIES, LLM_SQL  # noqa: E402
from tallyscope.llm.voronoi_knn import top_k  # noqa: E402


def brute(rows, every, k):
    """rows: (id, vector)."""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("pivots,groups,block", [(1, 1, 4), (9, 3, 8), (64, 12, 1024)])
@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters_and_odd_vectors(spark, pivots, groups, block, spread):
    pick = np.random.default_rng(5)
    centre = pick.normal(size=(6, 8))
    x = (centre[pick.integers(0, 6, 300)] + spread * pick.normal(size=(300, 8))).astype(np.float32).tolist()
    x[40:80] = [x[40]] * 40  # one very common vector
    rows = list(enumerate(x)) + [(1000, None), (1001, [None] * 8), (1005, [float("nan")] + [1.0] * 7), (1010, [float("inf")] * 8), (1015, [0.0] * 8), (None, x[0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(5)).repartition(3)
    got = top_k(docs, F.col("id") % 5 == 0, 4, pivots=pivots, groups=groups, block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4)


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(0, [1.0, 2.0]), (5, [3.0]), (7, [])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(docs, F.col("id") % 5 == 0).collect()))
    assert got == brute([(0, [1.0, 2.0]), (5, [3.0]), (7, [])], 5, 5)
    assert top_k(docs.limit(0), F.col("id") % 5 == 0).count() == 0
    assert top_k(docs, F.lit(False)).count() == 0


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    rel = con.execute(LLM_SQL["op3_voronoi_knn"])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall())
    assert sorted(map(tuple, LLM_QUERIES["op3_voronoi_knn"](spark, small).select(*names).collect())) == want


def test_query_ids_on_many_rows(spark):
    """Rows of a query's own id are near it but no neighbours of it; expected rows are the SQL's."""
    pick = np.random.default_rng(3)
    x = pick.choice([-1.0, 1.0], size=(60, 64))  # of one norm, and all of them pivots
    of = {50: [59] * 10, 100: [10] * 30, 150: [20, 20, 21], 7: [5] * 20}
    rows = [(n + 201, x[n].tolist()) for n in range(48) if n not in (10, 20, 21)] + [(i, x[n].tolist()) for i, at in of.items() for n in at]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    rel = con.execute(LLM_SQL["op3_voronoi_knn"])
    names = [d[0] for d in rel.description]
    want = sorted(rel.fetchall())
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for pivots, groups in ((64, 12), (200, 3), (1, 1)):
        got = top_k(docs, F.col("id") % 50 == 0, pivots=pivots, groups=groups).select(*names)
        assert sorted(map(tuple, got.collect())) == want
