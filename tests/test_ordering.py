import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import ordering as O
from tallyscope.operators import peers


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else f"g{i % 7}"
        value = 5.0 if rng.random() < 0.4 else round(rng.gauss(0, 10), 1)
        rows.append((i, group, value))
    pdf = pd.DataFrame(rows, columns=["id", "g", "v"])
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_row_number_matches_sort(frame, limit):
    df, pdf = frame
    got = O.row_number(df, F.col("v"), F.col("id"), ["g"], descending=True, size="n",
                       before="b", upto="u", buckets=64, rows_per_task=limit).toPandas().set_index("id")
    want = pdf.sort_values(["g", "v", "id"], ascending=[True, False, True])
    want["rank"] = want.groupby("g").cumcount() + 1
    assert (got["rank"].sort_index() == want.set_index("id")["rank"].sort_index()).all()
    grouped = pdf.set_index("id").groupby("g")["v"]
    assert (got["b"].sort_index() == grouped.rank(method="min", ascending=False) - 1).all()
    assert (got["u"].sort_index() == grouped.rank(method="max", ascending=False)).all()
    assert (got["n"] == got["g"].map(pdf.groupby("g").size())).all()


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_global_rank_and_ties(frame, limit):
    df, pdf = frame
    got = O.tie_counts(df, F.col("v"), buckets=64, rows_per_task=limit).toPandas().set_index("id")
    low = pdf.set_index("id")["v"].rank(method="min") - 1
    high = pdf.set_index("id")["v"].rank(method="max")
    assert (got["n_below"].sort_index() == low.sort_index()).all()
    assert (got["n_upto"].sort_index() == high.sort_index()).all()
    assert set(got["n_all"]) == {3000}


@pytest.mark.parametrize("limit", [10, 1 << 20])
def test_medians_and_quartiles(frame, limit):
    df, pdf = frame
    got = O.medians(df, F.col("v"), ["g"], buckets=64, rows_per_task=limit).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].median()
    assert (abs(got["median"].sort_index() - want.sort_index()) < 1e-12).all()
    import statistics
    q = O.exclusive_quartiles(df, F.col("v"), ["g"], buckets=64, rows_per_task=limit).toPandas()
    for r in q.itertuples():
        exp = statistics.quantiles(sorted(pdf[pdf.g == r.g]["v"]), n=4)
        assert [r.q1, r.q2, r.q3] == pytest.approx(exp)


def test_hinges_leave_the_middle_out(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 4, 8, 16)], "c int, value double")
    row = peers.cohort_scales(df, ["c"]).first()
    assert (row["median"], row["q1"], row["q3"], row["mad"]) == (4.0, 1.5, 12.0, 3.0)
    assert row["scale"] == pytest.approx(10.5 / 1.349)


def test_flat_cohort_has_no_scale(spark):
    df = spark.createDataFrame([(1, 3.0)] * 9, "c int, value double")
    assert peers.cohort_scales(df, ["c"]).first()["scale"] is None


@pytest.mark.parametrize("limit", [10, 1 << 20])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["bigint", "string", "double", "decimal(38,0)", "date"])
def test_row_number_keeps_types_apart(spark, kind, descending, limit):
    rng = random.Random(3)
    big = 9007199254740992
    values = {"bigint": [big + rng.randrange(4) for _ in range(60)] + [None, -big, 5], "decimal(38,0)": [10 ** 30 + rng.randrange(3) for _ in range(60)] + [None, 5],
              "string": ["abcdefgh" + rng.choice("xyz") for _ in range(60)] + [None, "", "é", "zz"], "double": [float("inf"), None, 1.5, float("-inf")] * 20,
              "date": ["2020-01-0" + str(rng.randrange(1, 5)) for _ in range(60)] + [None]}[kind]
    ties = {"bigint": "t", "string": "s"}
    rows = [(None if v is None else str(v), big + i, f"key{i:03d}") for i, v in enumerate(values)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "v string, t long, s string").withColumn("v", F.col("v").cast(kind)).repartition(5)
    for tie in ties.values():
        got = O.row_number(df, F.col("v"), F.col(tie), [], descending=descending, before="b", upto="u", buckets=16, rows_per_task=limit).collect()
        assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
        line = sorted(got, key=lambda r: r["rank"])
        for a, b in zip(line, line[1:]):
            if a["v"] == b["v"]:
                assert a[tie] < b[tie]
            else:
                assert b["v"] is None or (a["v"] is not None and (a["v"] > b["v"] if descending else a["v"] < b["v"]))
        for r in got:
            same = [x["rank"] for x in got if x["v"] == r["v"]]
            assert (r["b"], r["u"]) == (min(same) - 1, max(same))
