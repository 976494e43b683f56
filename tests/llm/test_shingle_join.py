"""The n-gram Jaccard join against all pairs."""

import random
import re

import pytest

from tallyscope.llm.components import component_labels
from tallyscope.llm.queries import LLM_QUERIES
from tallyscope.llm.shingle_join import jaccard_components


def shingles(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, num=3, den=4):
    """rows: (id, text); the answer as sorted rows."""
    sets = [shingles(t) for _, t in rows]
    distinct = list({s for s in sets if s})
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            k = len(a & b)
            if k and den * k >= num * (len(a) + len(b) - k):
                parent[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[root(s)] = min(least.get(root(s), i), i)
    return sorted(((i, len(s), (least.get(root(s)) if s else i)) for (i, _), s in zip(rows, sets)), key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def edited(pick, words, share):
    return [pick.choice(["alpha", "beta", "gamma", "delta"]) if pick.random() < share else w for w in words]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.id: r.label for r in component_labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
    assert component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows_per_block", [3, 128])
def test_groups_of_edited_copies(spark, rows_per_block):
    pick = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (None, "one two"), (2, "")]
    common = [f"common{i}" for i in range(30)]
    for group in range(12):
        base = [f"w{pick.randint(0, 400)}" for _ in range(pick.choice([6, 40, 200, 300]))]
        for _ in range(pick.choice([2, 5, 25])):
            rows.append((len(rows) + 10, " ".join(edited(pick, base, pick.choice([0, 0, 0.005, 0.01, 0.02, 0.05])))))
        rows.append((len(rows) + 10, " ".join(base[:-1])))
        rows.append((len(rows) + 10, " ".join([f"v{pick.randint(0, 99)}" for _ in range(60)] + common)))
    rows += [(None, rows[20][1]), rows[20], (5000, "long " * 3 + " ".join(f"x{i}" for i in range(30000)))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, class int").repartition(4)
    assert answer(jaccard_components(docs, cells=1 << 12, rows=rows_per_block)) == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert answer(LLM_QUERIES["op9_shingle_join"](spark, small)) == brute(rows)
