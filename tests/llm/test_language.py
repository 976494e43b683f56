"""The language model: exact marginals, held-out accuracy, odd texts."""

import itertools
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tallyscope.llm import language_crf
from tallyscope.llm.queries import LLM_QUERIES


def test_marginals_equal_enumeration():
    pick = np.random.default_rng(1)
    scores, moves, start = pick.normal(size=(7, 3)), pick.normal(size=(3, 3)), pick.normal(size=3)
    opens = np.array([True, False, False, False, True, False, False])
    want = np.zeros((7, 3))
    for begin, end in ((0, 4), (4, 7)):
        total = 0
        for path in itertools.product(range(3), repeat=end - begin):
            p = np.exp(start[path[0]] + sum(scores[begin + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                want[begin + i, y] += p
        want[begin:end] /= total
    assert np.allclose(language_crf.forward_backward(scores, moves, start, opens)[0], want, atol=1e-5)


def test_blocks_equal_one_chain():
    pick = np.random.default_rng(2)
    steps = pick.random((3000, 4, 4)) ** 4
    v, out = np.ones(4), []
    for s in steps:
        v = v @ s
        v = v / v.max()
        out.append(v)
    assert np.allclose(language_crf.chained(steps), np.array(out))


def test_held_out_accuracy_and_spans(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = LLM_QUERIES["op6_language_crf"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)

    model = language_crf.fit(docs)
    line = {r.lang: r.text.split("\n")[0] for r in docs.where("n_chars > 300").collect()}
    mixed = spark.createDataFrame([(1, line["en"] + " " + line["fr"])], "doc_id long, text string")
    spans = language_crf.predict(mixed, model).first().lang_spans
    n = {k: sum(s.n_words for s in spans if s.lang == k) for k in line}
    assert min(n["en"], n["fr"]) > 0.8 * min(len(line["en"].split()), len(line["fr"].split()))
    assert sum(n.values()) == spans[-1].first_word + spans[-1].n_words


def test_odd_texts(spark, small, odd_docs, odd_texts):
    model = language_crf.fit(spark.read.parquet(f"{small}/documents.parquet"))
    docs = odd_docs.withColumn("score", F.lit("x")).union(odd_docs.sparkSession.createDataFrame([(900, "12 34 !", None, "", 3, ""), (901, "— 😀 …", None, "", 3, "")], "a long, b string, c string, d string, e long, f string"))
    got = language_crf.predict(docs, model)
    rows = got.collect()
    assert len(rows) == len(odd_texts) + 6
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters), r.text
        assert r.lang_pred in ("und", *model.labels) and (letters or r.score == 0)
    empty = language_crf.fit(odd_docs.where("lang = 'zz'"))
    assert {r.lang_pred for r in language_crf.predict(odd_docs, empty).collect()} == {"und"}
    assert language_crf.predict(odd_docs.limit(0), model).count() == 0


def test_long_lines_are_cut_not_dropped(spark):
    for line in (b"a" * 5000, "é中😀".encode() * 900, b"Some words, " * 500, b"x" * 1500 + b" " + b"y" * 1500, b"", b"short"):
        pieces = language_crf.line_pieces(line)
        assert b"".join(pieces) == line and all(len(p) <= language_crf.LINE_BYTES for p in pieces)
        assert all(p.decode() for p in pieces) or not line
    assert all(p.endswith(b", ") or p.endswith(b",") for p in language_crf.line_pieces(b"Some words, " * 500)[:-1])

    vowels = {"aa": "the house stands near water", "bb": "ein Haus steht dort am Wasser", "cc": "日本語の文章です"}
    texts = {k: (("" if k == "cc" else " ").join([v] * 200)) for k, v in vowels.items()}
    assert min(len(t.encode()) for t in texts.values()) > language_crf.LINE_BYTES
    docs = spark.createDataFrame([(i, t, k) for k, t in texts.items() for i in range(3)], "doc_id long, text string, lang string")
    model = language_crf.fit(docs)
    assert model.labels == sorted(texts)
    assert all(r.lang_pred == r.lang for r in language_crf.predict(docs, model).collect())


def test_driver_holds_the_model_only(spark, small):
    """Training takes many times the model's memory, so a task does it."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    tracemalloc.start()
    try:
        model = language_crf.fit(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.weights.any() and peak < 4 * model.weights.nbytes

    lines = language_crf.least_lines([tuple(r) for r in language_crf.sample_rows(docs, "text", "lang").collect()], language_crf.LINES_PER_LABEL)
    here = language_crf.trained(lines)
    assert here.labels == model.labels and all((a == b).all() for a, b in zip(here[1:], model[1:]))
