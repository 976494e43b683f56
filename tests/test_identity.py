import itertools
import random

from pyspark.sql import functions as F

from tallyscope.functions import columns as C
from tallyscope.operators import identity as I
from tallyscope.operators import reconcile as Q
from tallyscope.operators.containment import contains_pairs


def test_contains_pairs_equals_nested_loop(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab紅é") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(80)]
    names = [(i, word(rng.choice([1, 2, 3, 5, 9, 17]))) for i in range(60)] + [(99, "")]
    got = contains_pairs(spark.createDataFrame(texts, "t long, text string"), "t", "text", spark.createDataFrame(names, "n long, name string"), "n", "name")
    want = {(t, n) for t, x in texts for n, y in names if y and y in x}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50


def test_attribution_refusals(spark):
    inst = spark.createDataFrame([
        (1, "新北市私立小太陽幼兒園", "小太陽", "板橋區"), (2, "新北市私立大樹幼兒園", "大樹", "新店區"), (3, "新北市立板橋幼兒園", "板橋", "板橋區"),
        (4, "新北市私立大樹幼兒園附設分班", "大樹", "三重區")], "id long, title string, core string, town string")
    texts = spark.createDataFrame([
        (1, "小太陽幼兒園遭罰 - 某新聞"), (2, "小太陽很大"), (3, "台北市「小太陽」事件"), (4, "台北市「小太陽」事件 板橋"), (5, "大樹 幼兒園停辦"),
        (6, "板橋幼兒園招生"), (7, "新北市立板橋幼兒園招生"), (8, "台北市某園")], "text_id long, text string")
    got = {r["text_id"]: (r["institution_id"], r["basis"]) for r in I.attribute_texts(texts, inst, ["台北市", "北市"], "新北市", ["板橋"]).collect()}
    assert got == {1: (1, "distinctive_name"), 2: (None, "no_name"), 3: (None, "other_city_uncorroborated"), 4: (1, "distinctive_name"),
                   5: (None, "ambiguous"), 6: (None, "no_name"), 7: (3, "full_title"), 8: (None, "other_city")}


def test_attribution_by_titles_with_the_full_lists(spark):
    inst = spark.createDataFrame([
        (1, "新北市私立吉尼爾幼兒園", "板橋區"), (2, "新北市安溪非營利幼兒園(委託社團法人桃園市教保服務人員協會辦理)", "三峽區"), (3, "新北市立林口幼兒園", "林口區"),
        (4, "新北市私立何嘉仁幼兒園", "新店區"), (5, "新北市私立何嘉仁幼兒園附設分班", "三重區"), (6, None, "三重區"), (7, "新北市私立大樹幼兒園", "三重區"), (8, "新北市私立大樹幼兒園", "板橋區")], "id long, title string, town string")
    texts = spark.createDataFrame([
        (1, "吉尼爾幼兒園遭罰 - 吉尼爾新聞網", False), (2, "安溪 幼稚園招生", None), (3, "林口幼兒園招生", False), (4, "新北市立林口幼兒園招生", False), (5, "「大樹」又被抓", False),
        (6, "「吉尼爾」與高雄", False), (7, "高雄與板橋的「吉尼爾」", False), (8, "吉尼爾幼兒園遭罰", True), (9, "新北市私立吉尼爾幼兒園", False), (10, "新北投吉尼爾很好", False), (11, None, False), (12, "何嘉仁幼兒園又被抓", False)],
        "text_id long, text string, is_anonymised boolean")
    got = {r["text_id"]: (r["institution_id"], r["basis"]) for r in I.attribute_texts(texts, inst).collect()}
    assert got == {1: (1, "distinctive_name"), 2: (2, "distinctive_name"), 3: (None, "no_name"), 4: (3, "full_title"), 5: (None, "ambiguous"), 6: (None, "other_city_uncorroborated"),
                   7: (1, "distinctive_name"), 8: (None, "anonymised"), 9: (1, "full_title"), 10: (None, "no_name"), 11: (None, "no_name"), 12: (4, "distinctive_name")}


def test_attribution_with_one_name_in_most_texts(spark):
    inst = spark.createDataFrame([(i, f"新北市私立名{i}號幼兒園", "板橋區") for i in range(50)] + [(100 + i, "新北市私立大樹幼兒園", "新店區") for i in range(30)], "id long, title string, town string")
    texts = spark.createDataFrame([(i, "大樹幼兒園停辦" if i % 3 else f"「名{i % 50}號」停辦") for i in range(600)], "text_id long, text string")
    got = {r["text_id"]: (r["institution_id"], r["basis"]) for r in I.attribute_texts(texts, inst).collect()}
    assert got == {i: (None, "ambiguous") if i % 3 else (i % 50, "distinctive_name") for i in range(600)}


def test_unique_identity_pairs(spark):
    old = spark.createDataFrame([(1, "a", "p"), (2, "a", "q"), (3, "a", "q"), (4, "b", None), (5, "c", "r")], "k int, s string, p string")
    new = spark.createDataFrame([(11, "a", "p"), (12, "a", "q"), (14, "b", None), (15, "c", "r"), (16, "c", "r")], "k int, s string, p string")
    assert [(r.old_key, r.new_key) for r in I.unique_identity_pairs(old, new, ["s", "p"], "k").collect()] == [(1, 11)]


def test_headline_and_tags(spark):
    d = spark.createDataFrame([("@someone\n\n 今天 #小樹_1 出事\n後文",), ("#tag",), ("",)], "t string")
    got = d.select(C.headline(F.col("t")).alias("h"), C.hashtags(F.col("t")).alias("g")).collect()
    assert got[0]["h"] == "今天 #小樹_1 出事" and got[0]["g"] == "小樹_1" and got[1]["h"] == "#tag"


def test_short_law_joins_only_one_longer(spark):
    rows = spark.createDataFrame([(1, "第8條"), (1, "第8條第1項"), (2, "第8條"), (2, "第8條第1項"), (2, "第8條第2項"), (3, "同"), (3, "同")], "k int, law string")
    got = {(r["k"], r["target"]): (r["source_rows"], r["records"]) for r in I.merge_short_laws(rows, ["k"], "law").collect()}
    assert got == {(1, "第8條第1項"): (2, 1), (2, "第8條"): (1, 1), (2, "第8條第1項"): (1, 1), (2, "第8條第2項"): (1, 1), (3, "同"): (2, 2)}


def test_three_of_four_equals_nested_loop(spark):
    rng = random.Random(5)
    make = lambda base: [(base + i, rng.randint(0, 3), *[str(rng.randint(0, 2)) for _ in range(4)]) for i in range(60)]
    old, new = make(0), make(1000)
    cols = "k long, s int, a string, b string, c string, d string"
    got = I.three_of_four_pairs(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols), "s", ["a", "b", "c", "d"], "k")
    pairs = [(o[0], n[0]) for o, n in itertools.product(old, new) if o[1] == n[1] and sum(x == y for x, y in zip(o[2:], n[2:])) >= 3]
    want = {(o, n) for o, n in pairs if sum(p[0] == o for p in pairs) == 1 and sum(p[1] == n for p in pairs) == 1}
    assert {(r["old_key"], r["new_key"]) for r in got.collect()} == want


def test_sibling_violations(spark):
    reg = spark.createDataFrame([("e1", 1), ("e1", 2), ("e2", 3)], "entity string, id int")
    claims = spark.createDataFrame([("a", "e1", 1), ("b", "e1", 1), ("b", "e1", 2), ("c", "zz", 9), ("d", "e2", 3), ("d", "e2", 8)], "key string, entity string, id int")
    assert {tuple(r) for r in I.sibling_violations(claims, reg).select("key", "problem").collect()} == {
        ("a", "omitted_id"), ("c", "unknown_entity"), ("d", "added_id")}


def test_first_snapshot_gives_no_changes(spark):
    d = spark.createDataFrame([(1, "x")], "id int, v string")
    assert Q.snapshot_changes(None, d, "id", ["v"]).count() == 0


def test_occurrences_over_small_blocks(spark):
    d = spark.range(500).withColumn("h", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    got = Q.occurrence_keys(d, ["h"], "id", block=16).where("h = 'hot'").orderBy("id").collect()
    assert [r["occurrence"] for r in got] == list(range(1, len(got) + 1))


def test_documents_need_the_school(spark):
    rows = spark.createDataFrame([("a", "教幼字字第1號", "x", 5.0), ("a", "教幼字第1號", "x", 5.0), ("b", "教幼字第1號", "y", None)], "s string, n string, p string, f double")
    docs, dupes = Q.document_counts(rows, "s", C.document_number(F.col("n")), ["p"], "f")
    assert {tuple(r) for r in docs.collect()} == {("a", 2, 1, 1), ("b", 1, 1, 0)}
    assert [tuple(r) for r in dupes.collect()] == [("a", 1, 5.0)]


def test_null_verdict_is_no_failure(spark):
    f = spark.createDataFrame([("N01", 110, "school", "r", None, "high"), ("N01", 110, "school", "q", False, "high"), ("N01", 113, "school", "q", False, "low")],
                              "code string, year int, kind string, rule string, passed boolean, severity string")
    x = spark.createDataFrame([("N01", 110, '["u1","u2"]'), ("N01", 113, '["u1"]')], "code string, year int, ids_json string")
    assert {tuple(r) for r in I.findings_as_of(f, x, "2024-01-01").collect()} == {("u1", 1, 1, 1), ("u2", 1, 1, 1)}
