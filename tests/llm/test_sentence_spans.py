"""Sliding sentence spans against a plain search over all runs."""

import random
import re

import pytest

from tallyscope.llm.queries import LLM_QUERIES
from tallyscope.llm.sentence_spans import dedup_spans

SPACE = " \t\n\v\f\r"


def split(text):
    """(begin, end, words) of each sentence."""
    out = []
    for m in re.finditer(f"[^{SPACE}]+", text):
        word = re.sub("[A-Z]", lambda x: x[0].lower(), m[0])
        if out and not out[-1][3] and "\n" not in text[out[-1][1]:m.start()]:
            out[-1][1], out[-1][3] = m.end(), m[0][-1] in ".!?"
            out[-1][2].append(word)
        else:
            out.append([m.start(), m.end(), [word], m[0][-1] in ".!?"])
    return out


def brute(rows, span, least):
    """rows: (id, print, text)."""
    docs = sorted({(i is None, i or 0, h, t) for i, h, t in rows if t})
    parts = {d: split(d[3]) for d in docs}
    first, places = {}, []
    for d in docs:
        s = parts[d]
        for a in range(len(s)):
            for k in range(1, span + 1):
                run = s[a:a + k]
                if len(run) < k:
                    break
                n = [len(x[2]) for x in run]
                if k == span:
                    ok = sum(n) >= least
                else:
                    ok = sum(n) >= span * least or (len(s) == k and sum(n) >= least)
                if ok:
                    key = tuple(tuple(x[2]) for x in run)
                    places.append((key, d, a, k))
                    first.setdefault(key, (d, a))
    gone = {}
    for key, d, a, k in places:
        if first[key] != (d, a):
            gone.setdefault(d, set()).update(range(a, a + k))
    out = []
    for i, h, t in rows:
        d = (i is None, i or 0, h, t)
        s, drop = parts.get(d, []), gone.get(d, set())
        value, at = "", 0
        for k in sorted(drop):
            value += t[at:max(at, s[k - 1][1] if k else 0)]
            at = s[k][1]
        out.append((i, None if t is None else value + t[at:], len(s), len(drop)))
    return sorted(out, key=repr)


def rows_of(spark, docs):
    from pyspark.sql import functions as F
    return [(r.doc_id, r.h, r.text) for r in docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()]


@pytest.mark.parametrize("span,least", [(3, 6), (2, 1), (1, 4)])
def test_shared_passages(spark, span, least):
    pick = random.Random(8)
    pool = [" ".join(f"w{pick.randint(0, 30)}" for _ in range(pick.choice([1, 1, 2, 5, 9, 20, 40]))).capitalize() + pick.choice([".", ".", "!", "?", ".\n", "\n", " . ", "..."]) for _ in range(40)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One."), (5, "one."), (2, ""), (None, pool[1] * 4)]
    passages = [" ".join(pick.choice(pool) for _ in range(6)) for _ in range(4)]
    for i in range(80):
        parts = [pick.choice(pool) if pick.random() < 0.3 else f"Own sentence {pick.random()} é." for _ in range(pick.randint(1, 8))]
        if pick.random() < 0.4:
            parts.insert(pick.randint(0, len(parts)), pick.choice(passages))
        rows.append((None if i % 30 == 9 else i + 10, " ".join(parts)))
    rows += rows[30:33] + [(900, " ".join(f"x{k}." for k in range(20000)) + passages[0])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_removed string").repartition(4)
    got = dedup_spans(docs, span=span, least_words=least)
    assert sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got.collect()), key=repr) == brute(rows_of(spark, docs), span, least)


def test_passages_of_two_long_sentences_go_whole(spark):
    """Two sentences that repeat between differing neighbours, whatever their shares of the words; helper names are on the input."""
    rows = []
    for case, (a, b) in enumerate([(45, 20), (40, 14), (36, 35), (20, 45), (30, 30), (12, 12)]):
        passage = " ".join(f"p{case}w{k}" for k in range(a)) + ". " + " ".join(f"q{case}w{k}" for k in range(b)) + "."
        rows += [(10 * case + k, f"Before {case} {k}. {passage} After {case} {k}.", "p", 1) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _print string, _gone int")
    got = {r.doc_id: r.n_removed for r in dedup_spans(docs).collect()}
    assert got == {10 * case + k: 2 if k and case < 5 else 0 for case in range(6) for k in range(2)}


def test_empty_table(spark):
    assert dedup_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_plain_search(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = LLM_QUERIES["op7_sentence_spans"](spark, small)
    want = brute(rows_of(spark, docs), 3, 12)
    assert sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in got.collect()), key=repr) == want
    assert sum(w[3] for w in want) > 0
