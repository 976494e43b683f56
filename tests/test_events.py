import datetime as dt
import random

from pyspark.sql import functions as F

from tallyscope.operators import events as E
from tallyscope.operators import statements as S


def test_ledger_fold(spark):
    t = lambda h: dt.datetime(2026, 9, 1, h)
    log = spark.createDataFrame([
        (1, t(1), "reserve", "a", "feed", "p", 5.0, None), (2, t(2), "settle", "a", "other", "q", None, 3.0), (3, t(1), "reserve", "b", "feed", "p", 7.0, None),
        (4, t(3), "release", "b", None, None, None, None), (5, t(1), "settle", "c", None, None, None, 9.0), (6, t(4), "reserve", "d", "feed", "p", 2.0, None),
        (7, t(1), "note", None, "maps", None, None, None)],
        "entry long, ts timestamp, kind string, reservation_id string, meter string, period string, usd_max double, actual_usd double")
    got = {r["reservation_id"]: (r["meter"], r["state"], r["usd"]) for r in E.fold_ledger(log).collect()}
    assert got == {"a": ("feed", "settle", 3.0), "b": ("feed", "release", 0.0), "d": ("feed", "reserve", 2.0)}
    s = E.spend_by_period(E.fold_ledger(log), ["feed"]).first()
    assert (s["usd"], s["unsettled"]) == (5.0, 1)


def test_billing_cycle(spark):
    d = spark.createDataFrame([("2026-09-08",), ("2026-09-07",), ("2026-01-03",)], "d string").select(
        E.billing_period(F.col("d").cast("timestamp"), F.lit("feed"), "feed", 8).alias("p"), E.billing_period(F.col("d").cast("timestamp"), F.lit("maps"), "feed", 8).alias("m"))
    assert [tuple(r) for r in d.collect()] == [("2026-09-08", "2026-09"), ("2026-08-08", "2026-09"), ("2025-12-08", "2026-01")]


def test_gate_order(spark):
    g = E.spend_gate(F.col("a"), F.lit(9.0), F.lit(0.0), 5.0, 10.0, 100.0)
    got = spark.createDataFrame([(6.0,), (2.0,), (1.0,)], "a double").select(g.alias("g")).collect()
    assert [r["g"] for r in got] == ["run", "day", None]


def test_thread_roots_long_chain_and_cycle(spark):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 70)] + [(100, 101), (101, 102), (102, 100), (200, 999), (201, 200)]
    got = {r["id"]: r["root"] for r in E.thread_roots(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert all(got[i] == 0 for i in range(70)) and got[100] is None and got[102] is None and got[201] == 999 and got[200] == 999


def test_gap_clusters_over_small_blocks(spark):
    rng = random.Random(2)
    xs = sorted(rng.uniform(0, 4000) for _ in range(300))
    got = sorted((round(r["cluster_start"], 6), r["support"]) for r in E.gap_clusters(
        spark.createDataFrame([("k", x) for x in xs], "k string, x double"), ["k"], "x", 14.0, block=4).collect())
    want, run = [], [xs[0]]
    for x in xs[1:]:
        if x - run[-1] > 14.0:
            want.append((round(run[0], 6), len(run)))
            run = []
        run.append(x)
    want.append((round(run[0], 6), len(run)))
    assert got == want


def test_hull_is_decomposable(spark):
    rng = random.Random(4)
    pts = [("d", rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(3000)] + [("e", 1.0, 1.0), ("e", 1.0, 1.0), ("e", 2.0, 2.0)]
    got = E.district_hulls(spark.createDataFrame(pts, "k string, x double, y double").repartition(7), "k", "x", "y").collect()
    hull = [(r["x"], r["y"]) for r in sorted((r for r in got if r["k"] == "d"), key=lambda r: r["vertex"])]
    own = [p[1:] for p in pts if p[0] == "d"]
    # A point is a vertex if and only if no line through it and another point has points on both sides or beyond it.
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    assert hull[0] == min(own) and len(set(hull)) == len(hull) and set(hull) <= set(own)
    assert all(turn(a, b, c) >= 0 for a, b in zip(hull, hull[1:] + hull[:1]) for c in own)
    assert all(turn(a, b, c) > 0 for a, b, c in zip(hull, hull[1:] + hull[:1], hull[2:] + hull[:2]))
    assert {(r["x"], r["y"]) for r in got if r["k"] == "e"} == {(1.0, 1.0), (2.0, 2.0)}


def test_sections_inherit_over_consecutive_pages_only(spark):
    rows = [(1, "a"), (2, "?"), (3, "?"), (5, "?"), (6, "b"), (7, "?"), (8, "?"), (9, "?"), (11, "?")]
    got = {r["page"]: (r["resolved"], r["inherited"]) for r in S.inherit_sections(
        spark.createDataFrame([("r", p, s) for p, s in rows], "r string, page long, s string"), ["r"], "page", "s", F.col("s") == "?", span=2).collect()}
    assert got == {1: ("a", False), 2: ("a", True), 3: ("a", True), 5: ("?", False), 6: ("b", False), 7: ("b", True), 8: ("b", True), 9: ("b", True), 11: ("?", False)}


def test_percent_columns_without_stem_stay(spark):
    d = spark.createDataFrame([(1, ["收入", "收入%", "金額%"], [10.0, 0.5, 0.7])], "k int, labels array<string>, cells array<double>")
    r = S.spread_percent_columns(d).first()
    assert r["labels"] == ["收入", "金額%"] and r["cells"] == [10.0, 0.7] and r["percents"] == [0.5]
