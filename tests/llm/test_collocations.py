"""Quotient filters against dictionaries, collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyscope.llm import collocations as C
from tallyscope.llm.quotient_filter import Filter, by_bucket, counted, from_bytes, merged, permuted, restored, to_bytes, unmixed
from tallyscope.llm.words import mixed


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, least, longest=4, num=80, den=100, scale=2_000_000):
    """rows: (text, lang); all kept phrases by counting every run of words."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    cand = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    longer = Counter()
    for (lang, g), n in cand.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                longer[lang, g[i:i + m]] = max(longer[lang, g[i:i + m]], n)
    out = []
    for (lang, g), a in cand.items():
        if den * longer[lang, g] >= num * a and longer[lang, g]:
            continue
        score, _, l, r = min((scale * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, l, r, total[lang], score))
    return sorted(out)


def texts(seed=3, rows=150):
    pick = random.Random(seed)
    words = ["the", "of", "New", "York", "new", "city", "é", "x" * 40, "中文", "a\x01b", "in", "state"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\x0b"]
    out = [(None, "en"), ("", "en"), ("   ", None), ("New York city. New York city", None), ("\0", "de"), (" ".join(["la"] * 50), "fr")]
    for _ in range(rows):
        text = "".join(pick.choice(words[:pick.choice([3, 12])]) + pick.choice(marks) for _ in range(pick.randint(1, 60)))
        out.append((text, pick.choice(["en", "en", "en", "de", None, ""])))
    return out + out[-5:]


def rows_of(found):
    return sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


def test_permutation_has_an_inverse():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4):
        keys = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(n)]
        keys[0][:3] = [0, 1, (1 << 64) - 1]
        assert all((a == b).all() for a, b in zip(restored(permuted(keys)), keys))
    assert (unmixed(mixed(keys[0])) == keys[0]).all()


@pytest.mark.parametrize("n,skip", [(1, 0), (1, 5), (2, 3), (4, 9)])
def test_filters_count_like_a_dictionary(n, skip):
    rng = np.random.default_rng(n * 10 + skip)
    want, shards = Counter(), []
    for shard in range(4):
        keys = [rng.integers(0, 30, 5000, dtype=np.uint64) for _ in range(n)]
        keys[0][:1000] = 7  # one hot key
        for k in keys[1:]:
            k[:1000] = 7
        want.update(zip(*(k.tolist() for k in keys)))
        shards.append({b: to_bytes(f, skip) for b, f in by_bucket(counted(permuted(keys)), skip)})
    got = {}
    for bucket in {b for s in shards for b in s}:
        f = merged([from_bytes(s[bucket], bucket) for s in shards if bucket in s])
        got.update(zip(zip(*(k.tolist() for k in restored(f.limbs))), f.count.tolist()))
    assert got == want


def test_filters_are_compact_and_may_be_empty():
    keys = permuted([np.arange(1 << 16, dtype=np.uint64)])
    assert len(to_bytes(counted(keys), 0)) < 9 * (1 << 16)
    none = counted([np.zeros(0, np.uint64)])
    assert by_bucket(none, 3) == [] and len(from_bytes(to_bytes(none)).count) == 0
    one = Filter((np.array([5], np.uint64),), np.array([10**12]))
    assert from_bytes(to_bytes(one)).count.tolist() == [10**12]


@pytest.mark.parametrize("least", [2, 12])
def test_phrases_equal_plain_counting(spark, least):
    rows = texts()
    docs = spark.createDataFrame([(t, g, "x", 1) for t, g in rows], "text string, lang string, word string, n int").repartition(5)
    want = brute(rows, least)
    assert want and rows_of(C.collocations(docs, least=least)) == want


def test_clashing_ids_wide_ids_and_cut_texts(spark, monkeypatch):
    rows = texts(9, 60)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute(rows, 4)
    plain = C.plain_ids
    monkeypatch.setattr(C, "plain_ids", lambda prints, bits: np.maximum(plain(prints, bits) % np.uint64(3), np.uint64(0)) + np.uint64(C.RESERVED))
    monkeypatch.setattr(C, "PART_BYTES", 50)
    monkeypatch.setattr(C, "HELD_KEYS", 40)
    assert rows_of(C.collocations(docs, least=4)) == want
    monkeypatch.setattr(C, "NARROW_WORDS", 0)
    assert rows_of(C.collocations(docs, least=4)) == want


def test_pairs_only_and_ranks(spark):
    rows = texts(4, 80)
    docs = spark.createDataFrame(rows, "text string, lang string")
    want = brute(rows, 3, 2)
    found = C.collocations(docs, least=3, longest=2)
    assert rows_of(found) == want
    best = C.best_phrases(found, 3).collect()
    for lang in {w[0] for w in want}:
        ranked = sorted((w for w in want if w[0] == lang), key=lambda w: (-w[6], -w[2], w[1].encode()))[:3]
        assert [(r.rank, r.phrase) for r in sorted(best, key=lambda r: r.rank) if r.lang == lang] == [(i + 1, w[1]) for i, w in enumerate(ranked)]


def test_one_text_of_many_words(spark):
    words = " ".join(random.Random(2).choice(["a", "b", "c"]) for _ in range(60_000)) + ". a b c"
    docs = spark.createDataFrame([(words, "en")], "text string, lang string")
    assert rows_of(C.collocations(docs)) == brute([(words, "en")], 30)


def test_empty_table(spark):
    assert C.best_phrases(C.collocations(spark.createDataFrame([], "text string, lang string")), 5).count() == 0
