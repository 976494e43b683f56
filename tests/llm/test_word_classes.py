"""Classes of all words: gains and rounds against plain counting, scores against dictionaries, every word with a class of its own."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.llm import class_ngrams as C, word_classes as W
from tallyscope.llm.queries import LLM_QUERIES
from test_class_ngrams import held, words


def mark():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def learned(docs):
    return W.exchange_words(docs, mark(), *C.learn(docs, mark()))


def classes_of(table):
    out = {}
    for r in table.collect():
        h, n, klass = np.frombuffer(r.words, np.uint64), np.frombuffer(r.n, np.int64), np.frombuffer(r.classes, np.uint8)
        assert len(h) == len(n) == len(klass)
        out |= dict(zip(h.tolist(), klass.tolist()))
    return out


def labelled(rows, model, table):
    """All words' classes and counts: of units, of every other training word, of endings for the rest."""
    train = [words(t) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    keys = sorted({w for _, t in rows for w in words(t)} | set(count))
    _, h, ending = C.tokens_of([b" ".join(keys)])
    own = {p: k for k, p in enumerate(model.counts.own.tolist())}
    further = classes_of(table)
    assert set(further) == {p for w, p in zip(keys, h.tolist()) if count[w]} - set(own)
    return train, count, {w: int(model.unit_class[own[p]] if p in own else further[p] if p in further else model.unit_class[C.WORD_UNITS + e]) for w, p, e in zip(keys, h.tolist(), ending.tolist())}


def bigrams_of(train, klass, end):
    table = np.zeros((C.CLASSES, C.CLASSES))
    for t in train:
        line = [end, *(klass[w] for w in t), end]
        np.add.at(table, (line[:-1], line[1:]), 1)
    return table


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model, table = learned(docs)
    got = sorted((tuple(r) for r in C.scored(docs, mark(), model, table).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    train, count, klass = labelled(rows, model, table)
    end = int(model.unit_class[-1])
    bigrams = bigrams_of(train, klass, end)
    share = (bigrams.sum(0) + 1) / (bigrams.sum() + C.CLASSES)
    move = (bigrams + C.CLASS_WEIGHT * share) / (bigrams.sum(1, keepdims=True) + C.CLASS_WEIGHT)
    size = np.bincount([*(klass[w] for w in count), *model.unit_class[C.WORD_UNITS:]], minlength=C.CLASSES)
    whole = bigrams.sum(0) + 0.5 * size
    total, distinct = sum(count.values()) + len(train), len(count) + bool(train)
    want = []
    for i, t in rows:
        t = words(t)
        line = [end, *(klass[w] for w in t), end]
        n = [*(count[w] for w in t), len(train)]
        score = sum(math.log10(move[a, b]) + math.log10((k + 0.5) / whole[b]) for a, b, k in zip(line, line[1:], n))
        base = sum(math.log10((k + 1) / (total + distinct + 1)) for k in n)
        want.append((i, held(i), len(n), sum(k > 0 for k in n), total, base, score))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9) if want else not got
    return model, table, train, klass


def test_odd_texts(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(C, "KNOWN_PER_BUCKET", 1)
    monkeypatch.setattr(C, "WORD_UNITS", 10)
    check(odd_docs)
    check(odd_docs.limit(0))
    check(odd_docs.where("doc_id in (9, 16)"))


@pytest.fixture(scope="module")
def kinds(spark):
    """Words of two kinds that take turns, half of them from 100 frequent ones; endings say nothing about the kind."""
    pick = np.random.default_rng(5)
    texts = [(i, " ".join(f"{'ab'[k % 2]}{pick.integers(50) if pick.random() < 0.5 else pick.integers(50, 400)}end" for k in range(40))) for i in range(400)]
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3).cache()


def test_rare_words_get_classes_of_their_own(kinds, monkeypatch):
    """They were all in the class of their ending, whatever stood beside them."""
    monkeypatch.setattr(C, "WORD_UNITS", 100)
    monkeypatch.setattr(C, "KNOWN_PER_BUCKET", 2)
    monkeypatch.setattr(W, "GATHERED", 900)
    monkeypatch.setattr(W, "TOGETHER", 2)
    before, counts = C.learn(kinds, mark())
    model, table, train, klass = check(kinds)
    of_kind = [Counter(klass[w] for t in train for w in t if w[:1] == k) for k in (b"a", b"b")]
    assert sum((of_kind[0] & of_kind[1]).values()) < 0.1 * sum(of_kind[0].values())
    first = C.scored(kinds, mark(), before, counts).where("held_out").agg(F.sum("score")).first()[0]
    assert C.scored(kinds, mark(), model, table).where("held_out").agg(F.sum("score")).first()[0] > first

    # Rounds end with a higher likelihood of plainly counted bigrams than they begin with.
    monkeypatch.setattr(W, "exchanged", lambda *a, run=W.exchanged: run(*a, rounds=0))
    _, none = learned(kinds)
    _, _, start = labelled([tuple(r) for r in kinds.collect()], model, none)
    end = int(model.unit_class[-1])
    assert W.likelihood(bigrams_of(train, klass, end)) > W.likelihood(bigrams_of(train, start, end))


def test_query_labels_every_word(spark, kinds, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "WORD_UNITS", 100)
    kinds.write.parquet(f"{tmp_path}/documents.parquet")
    called, run = [], W.exchange_words
    monkeypatch.setattr(W, "exchange_words", lambda *a: called.append(run(*a)) or called[-1])
    assert LLM_QUERIES["op4_class_ngrams"](spark, str(tmp_path)).count() == kinds.count()
    (model, table), = called
    assert set(classes_of(table)) | set(model.counts.own.tolist()) == set(model.counts.known.tolist())


def test_a_corpus_with_many_more_words_than_units(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    model, table, train, klass = check(docs)
    assert len(klass) > 2 * len(model.counts.own)


def test_gains_are_those_of_moving_one_word(monkeypatch):
    monkeypatch.setattr(W, "LISTED", 4)
    pick = np.random.default_rng(2)
    units, classes = 30, C.CLASSES
    bigrams = pick.poisson(1.5, (units, units)) * pick.integers(1, 6, (units, 1))
    label = pick.integers(0, 5, units)

    def table_of(label):
        out = np.zeros((classes, classes))
        np.add.at(out, (np.repeat(label, units), np.tile(label, units)), bigrams.ravel())
        return out

    table = table_of(label)
    for u in range(units):
        others = np.arange(units) != u
        counts = np.r_[np.bincount(label[others], bigrams[others, u], classes), np.bincount(label[others], bigrams[u, others], classes), bigrams[u, u]][None]
        got = W.gains(counts.astype(float), label[u:u + 1], table, W.lists(table))[0]
        want = [W.likelihood(table_of(np.where(np.arange(units) == u, c, label))) for c in range(classes)]
        assert np.allclose(got - got[0], np.array(want) - want[0], atol=1e-6)
