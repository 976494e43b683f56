"""Class n-grams: counts and scores against a plain computation, likelihood of the exchange, odd texts."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyscope.llm import class_ngrams as C
from tallyscope.llm.queries import LLM_QUERIES


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain(rows, model):
    """What every row should get, from dictionaries and the model's own parameters."""
    train = [words(t) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    total, distinct = sum(count.values()) + len(train), len(count) + bool(train)
    keys = sorted({w for _, t in rows for w in words(t)} | set(count))
    _, h, ending = C.tokens_of([b" ".join(keys)])
    print_of, ending_of = dict(zip(keys, h.tolist())), dict(zip(keys, ending.tolist()))
    own = {p: k for k, p in enumerate(model.counts.own.tolist())}
    unit = {w: own.get(print_of[w], C.WORD_UNITS + ending_of[w]) for w in keys}
    n_e, v_e = Counter(), Counter()
    for w, n in count.items():
        if unit[w] >= C.WORD_UNITS:
            n_e[ending_of[w]] += n
            v_e[ending_of[w]] += 1
    end = C.WORD_UNITS + C.ENDING_UNITS
    out = []
    for i, t in rows:
        base = math.log10((len(train) + 1) / (total + distinct + 1))
        score, before = 0.0, model.unit_class[end]
        known = int(bool(train))
        for w in [*words(t), None]:
            u = end if w is None else unit[w]
            c = model.unit_class[u]
            score += model.move[before, c] + model.unit[u]
            before = c
            if w is not None:
                base += math.log10((count[w] + 1) / (total + distinct + 1))
                known += count[w] > 0
                if u >= C.WORD_UNITS:
                    score += math.log10((count[w] + 1) / (n_e[ending_of[w]] + v_e[ending_of[w]] + 1))
        out.append((i, held(i), len(words(t)) + 1, known, total, base, score))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[5]))


def check(docs, known_per_bucket=None):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    mark = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model, table = C.learn(docs, mark)
    got = sorted((tuple(r) for r in C.scored(docs, mark, model, table).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    want = plain(rows, model)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9) if want else not got
    assert np.allclose((10 ** model.move).sum(1), 1)
    for c in range(C.CLASSES):
        if (model.unit_class == c).any():
            assert abs((10 ** model.unit[model.unit_class == c]).sum() - 1) < 1e-6
    return got


def test_odd_texts(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(C, "KNOWN_PER_BUCKET", 1)
    monkeypatch.setattr(C, "WORD_UNITS", 10)
    check(odd_docs)
    check(odd_docs.limit(0))
    check(odd_docs.where("doc_id in (9, 16)"))


def test_query_beats_the_base(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = [tuple(r) for r in LLM_QUERIES["op4_class_ngrams"](spark, small).collect()]
    assert len(got) == docs.count()
    out = [r for r in got if r[1]]
    assert out and sum(r[6] for r in out) > sum(r[5] for r in out)
    check(docs.select("doc_id", "text"))


def likelihood(bigrams, label):
    k = label.max() + 1
    t = np.zeros((k, k))
    np.add.at(t, (np.repeat(label, len(label)), np.tile(label, len(label))), bigrams.ravel())
    return C._xlogx(t).sum() - C._xlogx(t.sum(0)).sum() - C._xlogx(t.sum(1)).sum()


def test_exchange_reaches_the_best_of_small_cases():
    pick = np.random.default_rng(3)
    for _ in range(5):
        truth = np.array([0, 0, 0, 1, 1, 1])
        bigrams = pick.poisson(np.where(truth[:, None] == truth[None, :], 3.0, 40.0)).astype(np.float32)
        label = C.exchanged(bigrams, classes=2, rounds=10)
        best = max(likelihood(bigrams, np.array((0, *x))) for x in itertools.product((0, 1), repeat=5))
        assert likelihood(bigrams, label) >= best - 1e-6
