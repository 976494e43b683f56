import datetime as dt

from pyspark.sql import functions as F

from tallyscope.streaming import streams as S


def parts(spark, tmp_path, rows, schema, n=3):
    folder = tmp_path / "in"
    folder.mkdir()
    step = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * step:(i + 1) * step], schema).coalesce(1).write.parquet(str(folder / f"d{i}"))
    return str(folder)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


T0 = dt.datetime(2026, 9, 1)
LEDGER = "reservation_id string, kind string, entry long, meter string, usd_max double, actual_usd double"


def test_ledger_state_waits_for_late_reserves(spark, tmp_path):
    rows = [("a", "settle", 2, None, None, 3.0), ("b", "reserve", 3, "feed", 7.0, None), ("a", "reserve", 1, "feed", 5.0, None),
            ("b", "release", 4, None, None, None), ("c", "settle", 5, None, None, 1.0), ("d", "reserve", 6, "maps", 2.0, None)]
    rows = [(r[0], r[1], r[2], r[3], r[4] or 0.0, r[5] or 0.0) for r in rows]
    out = S.run(S.ledger_state(stream_of(spark, parts(spark, tmp_path, rows, LEDGER), LEDGER)), "l", "update", str(tmp_path / "w"))
    got = {r["reservation_id"]: (r["state"], r["usd"]) for r in S.latest_per_key(out, ["reservation_id"]).collect()}
    assert got == {"a": ("settle", 3.0), "b": ("release", 0.0), "d": ("reserve", 2.0)}


def test_ledger_state_ends_behind_the_watermark(spark, tmp_path):
    """Reservations of the first batches leave no state once the watermark is a hold behind their last entries."""
    hour = lambda h: T0 + dt.timedelta(hours=h)
    schema = "reservation_id string, kind string, entry long, meter string, usd_max double, actual_usd double, ts timestamp"
    rows = [(f"a{i}", "reserve", i, "feed", 5.0, 0.0, hour(1)) for i in range(20)] + [(f"a{i}", "settle", 100 + i, "feed", 0.0, 2.0, hour(2)) for i in range(20)]
    rows += [("late", "reserve", 300, "feed", 5.0, 0.0, hour(200))] + [("last", "reserve", 301 + i, "feed", 5.0, 0.0, hour(400 + i)) for i in range(39)]
    stream = S.ledger_state(stream_of(spark, parts(spark, tmp_path, rows, schema, 4), schema), "ts", "1 hour", 2)
    seen = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda d, b: seen.extend(d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) >= 20 and kept[-1] <= 2
    last = {r["reservation_id"]: (r["state"], r["usd"]) for r in seen}
    assert all(last[f"a{i}"] == ("settle", 2.0) for i in range(20)) and last["last"] == ("reserve", 5.0)


def test_ledger_calls_go_by_buckets(spark, tmp_path, monkeypatch):
    """Reservations share a few state rows; each of them still ends by its own last entry."""
    monkeypatch.setattr(S, "LEDGER_BUCKETS", 3)
    hour = lambda h: T0 + dt.timedelta(hours=h)
    schema = "reservation_id string, kind string, entry long, meter string, usd_max double, actual_usd double, ts timestamp"
    rows = [(f"a{i}", "reserve", i, "feed", 5.0, 0.0, hour(1 if i % 2 else 300)) for i in range(20)] + [(f"b{i}", "reserve", 100 + i, "feed", 7.0, 0.0, hour(300)) for i in range(20)]
    rows += [(f"c{i}", "reserve", 200 + i, None, 1.0, 0.0, hour(301)) for i in range(20)] + [(f"a{i}", "settle", 300 + i, None, 0.0, 2.0, hour(302)) for i in range(20)]
    stream = S.ledger_state(stream_of(spark, parts(spark, tmp_path, rows, schema, 4), schema), "ts", "1 hour", 2)
    seen = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda d, b: seen.extend(d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3
    last = {r["reservation_id"]: (r["state"], r["usd"], r["meter"]) for r in seen}
    # The odd ones ended behind the watermark, so their settlements find no reservation.
    assert all(last[f"a{i}"] == (("reserve", 5.0, "feed") if i % 2 else ("settle", 2.0, "feed")) for i in range(20))
    assert all(last[f"b{i}"] == ("reserve", 7.0, "feed") and last[f"c{i}"] == ("reserve", 1.0, None) for i in range(20))


def test_duplicates_and_old_rows_are_refused(spark, tmp_path):
    day = lambda d: T0 + dt.timedelta(days=d)
    rows = [("x", day(0)), ("y", day(1)), ("x", day(2)), (None, day(1)), ("z", None), ("old", day(-9)), ("y", day(2)), ("w", day(3))]
    schema = "id string, t timestamp"
    d = S.unique_mentions(stream_of(spark, parts(spark, tmp_path, rows, schema), schema), "id", "t", "30 days", F.lit(T0))
    out = S.run(S.with_observed_time(d, "t", "t"), "m", folder=str(tmp_path / "w"))
    assert sorted(r["id"] for r in out.collect()) == ["w", "x", "y"] and "observed_time" in out.columns


def test_append_store_is_idempotent(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (1, "late"), (3, "c"), (2, "late")]
    schema = "k long, v string"
    seen = []
    S.append_store(stream_of(spark, parts(spark, tmp_path, rows, schema), schema), "k", ["v"], str(tmp_path / "s"),
                   lambda fresh, b: seen.append(fresh.count()))
    got = spark.read.parquet(str(tmp_path / "s" / "store"))
    assert got.count() == 3 and sum(seen) == 3


def test_unsettled_reservations_keep_their_upper_bound(spark, tmp_path):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    res, stl = tmp_path / "r", tmp_path / "s"
    res.mkdir(), stl.mkdir()
    for i, part in enumerate([[("a", hour(0), 5.0), ("b", hour(0), 7.0)], [("later", hour(90), 1.0)], [("last", hour(200), 1.0)]]):
        spark.createDataFrame(part, "k string, t timestamp, usd_max double").coalesce(1).write.parquet(str(res / f"p{i}"))
    for i, part in enumerate([[("a", hour(2), 3.0)], [("zz", hour(90), 1.0)], [("yy", hour(200), 1.0)]]):
        spark.createDataFrame(part, "k string, t timestamp, actual_usd double").coalesce(1).write.parquet(str(stl / f"p{i}"))
    r = stream_of(spark, str(res), "k string, t timestamp, usd_max double")
    s = stream_of(spark, str(stl), "k string, t timestamp, actual_usd double")
    out = S.run(S.settle_within(r, s, "k", "t", "24 HOURS", "1 hour"), "j", folder=str(tmp_path / "w"))
    got = {x["k"]: (x["usd"], x["unsettled"]) for x in out.collect()}
    assert got["a"] == (3.0, False) and got["b"] == (7.0, True)
