import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyscope.sources import readers as D
from tallyscope.sources import sinks as W


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_sanctions_csv(spark, tmp_path):
    head = "id,date,fine,is_monetary,sanction_type,actor_role\n"
    good = write(tmp_path / "a.csv", head + "1,2023/01/05,6000,1,fine,x\n2,bad,,0,stop_enrollment,y\n")
    rows = D.read_sanctions(spark, good).orderBy("id").collect()
    assert str(rows[0]["date"]) == "2023-01-05" and rows[0]["fine"] == 6000 and rows[1]["date"] is None and rows[1]["fine"] is None
    with pytest.raises(ValueError):
        D.read_sanctions(spark, write(tmp_path / "b.csv", head + "1,2023/01/05,,1,fine,x\n"))
    with pytest.raises(ValueError):
        D.read_sanctions(spark, write(tmp_path / "c.csv", "id,date\n1,2\n"))


def test_nested_snapshots(spark, tmp_path):
    cars = write(tmp_path / "cars.json", json.dumps({"u1": [{"plate_no": "A", "on_production_date": "202001", "txn_name": "本區新領"}, {"plate_no": "B", "txn_name": "??"}], "u2": []}, ensure_ascii=False))
    got = {(r["id"], r["plate_no"], r["state"], str(r["built"])) for r in D.flatten_assets(spark.read.text(cars, wholetext=True)).collect()}
    assert got == {("u1", "A", "active", "2020-01-01"), ("u1", "B", "unknown", "None")}
    acts = write(tmp_path / "acts.json", json.dumps({"負責人：甲": [{"id": "u1", "date": "2020/1/1", "law": "第8條", "punishment": "6,000元"}]}, ensure_ascii=False))
    assert [(r["id"], r["actor"]) for r in D.invert_actors(spark.read.text(acts, wholetext=True)).collect()] == [("u1", "負責人：甲")]
    geo = write(tmp_path / "geo.json", json.dumps({"features": [{"properties": {"id": "u1"}, "geometry": {"coordinates": [121.5, 25.0]}}, {"properties": {"id": "u2"}, "geometry": None}]}))
    assert {tuple(r) for r in D.feature_points(spark.read.text(geo, wholetext=True), "id:string").collect()} == {("u1", 121.5, 25.0), ("u2", None, None)}


def test_fee_slip_skips_uncharged(spark):
    slip = {"slip": {"3歲": {"上學期": {"months": "6", "class": {"全日班": {"學費": {"單價": "1,000", "小計": "6,000"}, "雜費": {"單價": "", "小計": None}}}}}}}
    raw = spark.createDataFrame([("t", json.dumps(slip, ensure_ascii=False))], "title string, payload string")
    assert [(r["item"], r["months"], r["subtotal"]) for r in D.fee_lines(raw, ["title"]).collect()] == [("學費", 6.0, 6000.0)]


def test_reports_checked_against_file_names(spark, tmp_path):
    for name, code in (("N01_甲_110.json", "N01"), ("N02_乙_110.json", "N09")):
        write(tmp_path / name, json.dumps({"code": code, "short_name": name[4], "academic_year": "110"}, ensure_ascii=False))
    good, bad = D.read_reports(spark, str(tmp_path), "code string, short_name string, academic_year string", r"^(N\d+)_(.+)_(\d+)\.json$")
    assert [r["code"] for r in good.collect()] == ["N01"] and bad.count() == 1


def test_feed_formats(spark, tmp_path):
    csv = write(tmp_path / "f.csv", "caption,link,author\nhello,u1,me\n,u2,me\n")
    lines = write(tmp_path / "f.jsonl", '{"content": "a", "url": "x"}\n{"title": {"text": "b"}}\n{"url": "only"}\n')
    whole = write(tmp_path / "f.json", json.dumps({"results": [{"body": "c", "user": "z"}, {"message": "d"}]}))
    texts = lambda p: sorted(r["text"] for r in D.read_feed(spark, p).collect())
    assert texts(csv) == ["hello"] and texts(lines) == ["a", "b"] and texts(whole) == ["c", "d"]


def test_files_against_manifest(spark, tmp_path):
    folder = tmp_path / "snap"
    folder.mkdir()
    for n in ("a.json", "b.json", "c.json"):
        write(folder / n, n)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    m = spark.createDataFrame([("a.json", h("a.json"), 6), ("b.json", h("x"), 6), ("d.json", h("d"), 1)], "name string, sha256 string, byte_length long")
    assert {tuple(r) for r in D.verify_files(spark, str(folder), m).collect()} == {("b.json", "mismatch"), ("c.json", "no_hash"), ("d.json", "missing_file")}


def test_sinks(spark, tmp_path):
    d = spark.range(10).select("id", (F.col("id") % 3).alias("g"))
    W.write_table(d, str(tmp_path / "t"), ["id", "g"], ["g", "id"], "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 10
    W.write_partitioned(d, str(tmp_path / "p"), ["g"], F.col("id"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).where("g = 1").count() == 3
    for _ in range(2):
        W.append_new(d, str(tmp_path / "s"), "id", ["g"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10


def test_a_store_in_partition_folders_is_not_empty(spark, tmp_path):
    d = spark.range(10).withColumn("g", F.col("id") % 3)
    d.write.partitionBy("g").parquet(str(tmp_path / "s"))
    W.append_new(d.select("id", "g"), str(tmp_path / "s"), "id", ["g"])
    assert spark.read.option("basePath", str(tmp_path / "s")).parquet(*[str(tmp_path / "s" / f"g={k}") for k in range(3)]).count() == 10


def test_nan_becomes_null(spark):
    d = D.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()
    assert d["a"] is None and d["b"] == 1
