"""Decontamination against full alignment of every text with every item."""

import random
import re

import numpy as np
import pytest

from tallyscope.llm import decontamination as D
from tallyscope.llm.queries import LLM_QUERIES


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def align(a, b):
    """Smith-Waterman by the book."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, last[j] + (D.MATCH if x == y else D.MISS), last[j + 1] + D.GAP, now[j] + D.GAP))
        best, last = max(best, max(now)), now
    return best


def brute(docs, items, least=0.6, least_words=8):
    out = []
    for i, t in docs:
        w = words(t)
        for k, x in items:
            v = words(x)
            if len(v) >= least_words:
                s = align(w, v) / (2 * len(v)) if set(w) & set(v) else 0
                if s >= least - 1e-12:
                    out.append((i, k, round(s, 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.item_id, round(r.score, 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_words", [40, 10 ** 6])
def test_edited_copies(spark, block_words):
    pick = random.Random(4)
    vocabulary = ["the", "of", "and"] * 8 + [f"w{i}" for i in range(60)]
    items = [(k, " ".join(pick.choice(vocabulary) for _ in range(pick.choice([8, 9, 14, 15, 20, 40])))) for k in range(12)]
    items += [(50, None), (51, "too short"), (52, items[3][1]), (None, items[4][1]), (53, "")]
    docs = [(1, None), (2, ""), (3, "The END of"), (None, items[0][1].upper())]
    for i in range(80):
        w = items[pick.randrange(12)][1].split()
        for _ in range(pick.choice([0, 1, 3, 5, 8, 12])):
            at = pick.randrange(len(w) + 1)
            w[at:at + pick.choice([0, 1, 1])] = [pick.choice(vocabulary)] * pick.choice([0, 1, 1, 2])
        side = [" ".join(pick.choice(vocabulary) for _ in range(pick.choice([0, 5, 60]))) for _ in range(2)]
        docs.append((i + 10, "\n".join([side[0], " ".join(w), side[1]])))
    docs += docs[10:12] + [(500, " ".join(f"x{i}" for i in range(30000)) + " " + items[1][1])]
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(k, t, 0.5) for k, t in items], "item_id long, text string, score double")
    assert got(D.contaminated(frame, bench, block_words=block_words)) == brute(docs, items)


def test_alignment_side_by_side():
    pick = np.random.default_rng(0)
    for _ in range(50):
        a, b = pick.integers(2, 6, (3, 12)).astype(np.uint64), pick.integers(2, 6, (3, 7)).astype(np.uint64)
        assert D.aligned(a, b)[0].tolist() == [align(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert D.contaminated(docs, items.where("item_id = 9")).count() == 0
    assert D.contaminated(docs, items).collect()[0][:] == (1, 1, 1.0, 9)


def test_query_equals_alignment_of_all(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 4000").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = brute(docs, items)
    some = {i for i, _ in docs}
    assert [r for r in got(LLM_QUERIES["op10_decontamination"](spark, small)) if r[0] in some] == want and want


def test_inserted_words_and_short_items(spark):
    """Copies with words put in after every second one, or at random, and exact copies of items of few words."""
    pick = random.Random(9)
    items = [(k, " ".join(f"w{k}x{i}" for i in range(m))) for k, m in enumerate([8, 9, 10, 11, 12, 13, 14, 15, 15, 15, 16, 20, 31, 45])]
    docs, often = [], " ".join(x for _, x in items)
    for k, x in items:
        w = x.split()
        for rate in (0.5, 0.7, 0.8):
            for n in range(8):
                out = [y for v in w for y in ([v, f"new{pick.random()}"] if pick.random() < rate else [v])]
                docs.append((len(docs), "before it " + " ".join(out) + " and after"))
        docs.append((len(docs), " ".join(v + (" z" if i % 2 else "") for i, v in enumerate(w))))
    docs += [(1000 + i, often) for i in range(3)]  # frequent grams
    long = got(D.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")))
    assert long == brute(docs, items)

    short = [(1, "Who wrote it?"), (2, "seven words make up this short item"), (3, "one"), (4, "a a")]
    docs = [(1, "x who WROTE it? y"), (2, "who wrote it"), (3, "who then wrote it?"), (4, "seven words make up this short item"), (5, "one a b a"), (6, "b a\na one"), (7, "seven words make up this new short item")]
    rows = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(short, "item_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 1.0, 3), (4, 2, 1.0, 6), (5, 3, 1.0, 0), (6, 3, 1.0, 3), (6, 4, 1.0, 2)]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.6, 0.9])
def test_other_least_scores(spark, least):
    pick = random.Random(11)
    items = [(k, " ".join(f"w{pick.randint(0, 40)}" for _ in range(pick.randint(8, 20)))) for k in range(8)]
    docs = []
    for i in range(60):
        w = items[i % 8][1].split()
        out = [y for v in w for y in (["new", v], [v], ["new"], [v])[pick.randint(0, 3)]]
        docs.append((i, " ".join(out)))
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), least_score=least)
    assert got(found) == brute(docs, items, least)


def test_gram_counts_come_in_one_job(spark):
    """Not one for every partition: each leaves its own jobs and stages with the driver."""
    items = [[f"w{i}" for i in range(k, k + 12)] for k in range(0, 60, 12)]
    docs = spark.createDataFrame([(i, " ".join(items[i % 5])) for i in range(40)], "doc_id long, text string").repartition(4)
    held = [D.fingerprints(w.data, w.start, w.end) for w in (D.split_words([" ".join(item).encode()]) for item in items)]
    block = D._block(list(range(5)), held, 0.6, 8)
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("gram counts", "")
    try:
        counts = D.gram_counts(docs, "text", spark.sparkContext.broadcast(block), len(block.gram))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (counts == 8).all() and len(counts)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("gram counts")) <= 2
