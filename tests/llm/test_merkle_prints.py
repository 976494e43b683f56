"""Fingerprints against trees built by hand, next rows against a sorted list."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import merkle_prints as M


def sha(x):
    return sha256(x.encode()).hexdigest()


def fingerprint(text):
    leaves = [[sha("L" + x)[:32] for x in re.findall(r"[^.!?]{1,32}[.!?]*|[.!?]+", p)] for p in (text or "").split("\n")]
    paragraphs = [sha("P" + "".join(x))[:32] for x in leaves]
    starts = [i for i, h in enumerate(paragraphs) if i == 0 or h[-1] in "08"] + [len(paragraphs)]
    sections = [(sha("S" + "".join(paragraphs[a:b]))[:32], a, b) for a, b in zip(starts, starts[1:])]
    out = sha("R" + "".join(s[0] for s in sections))
    for h, a, b in sections:
        out += "/" + h[:16] + "".join("," + paragraphs[i][:16] + "".join(x[:8] for x in leaves[i]) for i in range(a, b))
    return out, {x[:8] for p in leaves for x in p}


def near(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def brute(rows):
    """rows: (id, text) in order of ids, nulls last."""
    rows = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        edited = t[:len(t) - k] + after[:k]
        (own, a), (changed, b), (_, c) = fingerprint(t), fingerprint(edited), fingerprint(after)
        out.append((i, len(t), sha(edited), own, changed, near(a, b), near(a, c)))
    return sorted(out, key=repr)


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


def texts(n, seed=1):
    pick = random.Random(seed)
    base = [None, "", "\n", "a", "ab\n\ncd", "é" * 100, "😀 one. Two! Three?\nFour...", "x" * 5000, ".!?", "same\ntext", "same\ntext", "a\0b\tc\r\nd"]
    base += ["\n".join("".join(pick.choice("ab cde.\n!é中") for _ in range(pick.randint(0, 90))) for _ in range(pick.randint(1, 8))) for _ in range(n)]
    return base + [" ".join(str(pick.randint(0, 10**6)) for _ in range(20000))]


@pytest.mark.parametrize("range_rows", [4096, 3])
def test_rows_equal_trees_built_by_hand(spark, monkeypatch, range_rows):
    rows = [(None if k == 7 else 1000 - 13 * k, t) for k, t in enumerate(texts(60))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _range int, next_text string").repartition(5)
    monkeypatch.setattr(M, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(M.following, "__defaults__", ("doc_id", "text", "next_text", range_rows))
    assert rows_of(M.edited_fingerprints(docs)) == brute(rows)


def test_main_path_has_no_python(spark, small):
    plan = M.edited_fingerprints(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


def test_hot_and_repeated_ids(spark):
    """One id holds most rows, all copies of one text: it is dealt over several ranges and each copy has a next row."""
    rows = [(5, "copy of a text. It is hot.")] * 60 + [(k, f"text number {k}. And so on.") for k in (1, 2, 3, 9, 10)] + [(9, "text number 9. And so on.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = M.following(docs, range_rows=10)
    assert sorted((r.doc_id, r.text, r.next_text) for r in got.collect()) == sorted((i, t, n) for (i, t), (_, n) in zip(sorted(rows), sorted(rows)[1:] + sorted(rows)[:1]))


def test_one_row_and_empty_table(spark):
    docs = spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")
    assert rows_of(M.edited_fingerprints(docs)) == brute([(3, "abcdefgh")])
    assert M.edited_fingerprints(docs.limit(0)).count() == 0


def test_differing_branches_locate_edits(spark):
    pick = random.Random(3)
    lines = [" ".join(str(pick.randint(0, 999)) for _ in range(12)) for _ in range(40)]
    edited = lines[:]
    edited[17] = "something else"
    edited.insert(30, "a new line")
    docs = spark.createDataFrame([("\n".join(lines), "\n".join(edited))], "a string, b string")
    prints = M.with_fingerprints(docs, {"x": "a", "y": "b"}).select(M.same(F.col("x"), F.col("y")).alias("same"),
                                                                    M.changed_paragraphs(F.col("x"), F.col("y")).alias("at"), M.changed_paragraphs(F.col("x"), F.col("x")).alias("none"), "y")
    row = prints.first()
    assert not row.same and row.none == []
    sections = [s.split(",")[1:] for s in row.y.split("/")[1:]]
    number = [0]
    for s in sections:
        number.append(number[-1] + len(s))
    assert [number[r.section - 1] + r.paragraph - 1 for r in row["at"]] == [17, 30]


def test_edits_are_nearer_than_other_texts(spark, small):
    got = M.edited_fingerprints(spark.read.parquet(f"{small}/documents.parquet")).where("n_chars >= 400 and near_next < 1").agg(F.min("near_edited"), F.max("near_next")).first()
    assert got[0] > 0.5 > got[1]
