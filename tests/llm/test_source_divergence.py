"""Source divergence against plain counting, run-length columns against plain ones."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyscope.llm import source_divergence as D


def brute(rows, least, smooth=5, unit=10**9, top=50):
    """rows: (text, lang, source)."""
    df, count, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for g, t in df if g == lang and df[g, t] >= least), key=str.encode)
        sources = sorted(s for g, s in groups if g == lang)
        total = {s: sum(count[lang, s, t] for t in kept) for s in sources}

        def share(c, n):
            return 1 + unit * (c + smooth) // (n + smooth * len(kept))
        p = {s: [share(count[lang, s, t], total[s]) for t in kept] for s in sources}
        q = [share(sum(count[lang, s, t] for s in sources), sum(total.values())) for t in kept]
        for s in sources:
            parts = {"pair": [(o, sum(abs(x - y) for x, y in zip(p[s], p[o]))) for o in sources if o != s],
                     "term": [(t, x - y) for t, x, y in zip(kept, p[s], q) if x > y and count[lang, s, t]]}
            for part, items in parts.items():
                items = sorted(items, key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def texts(seed=1, rows=200):
    pick = random.Random(seed)
    words = ["The", "the", "of", "é", "Été", "x1y", "中文", "long" * 20, "a-b", "q"] + [f"w{chr(97 + k)}" for k in range(26)]
    out = [(None, None, None), ("", "en", "only empty"), ("1 2 3", "xx", "a"), ("1 2", "xx", "b"), ("Rare", "yy", "a"), (" ".join(words) * 3, None, "s1")]
    for _ in range(rows):
        text = " ".join(pick.choice(words[:pick.choice([4, 36])]) for _ in range(pick.randint(0, 30)))
        out.append((text, pick.choice(["en", "en", "de", None]), pick.choice(["hot", "hot", "hot", "s1", "s2", "s\n3", None])))
    return out + out[-4:]


def rows_of(found):
    return sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least,top", [(2, 50), (15, 3)])
def test_values_equal_plain_counting(spark, least, top):
    rows = texts()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, source string, term string").repartition(4)
    assert rows_of(D.divergences(docs, least=least, top=top)) == brute(rows, least, top=top)


def test_many_tiles_small_blocks_and_cut_texts(spark, monkeypatch):
    rows = texts(5, 80) + [(t, "en", f"src{k}") for k, (t, _, _) in enumerate(texts(6, 40))]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    for name, value in (("BLOCK_TERMS", 3), ("TILE_GROUPS", 4), ("PART_BYTES", 30), ("HELD", 50)):
        monkeypatch.setattr(D, name, value)
    assert rows_of(D.divergences(docs, least=3)) == brute(rows, 3)


def test_counts_beyond_64_bits_when_scaled():
    count = np.array([0, 10**12, 9 * 10**15], np.int64)
    got = D.shares(count, 10**16, 7, 5, 10**9)
    assert got.tolist() == [1 + 10**9 * (c + 5) // (10**16 + 35) for c in count.tolist()]


def test_runs_and_segments():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = (np.repeat(rng.integers(0, 3, 20), rng.integers(1, 5, 20))[:20] for _ in range(2))
        assert D.distance(D.read_runs(D.runs_of(a)), D.read_runs(D.runs_of(b))) == int(np.abs(a - b).sum())
    assert D.unpacked_names(D.packed_names(["", "a\nb", "é"])) == ["", "a\nb", "é"]


def test_no_kept_terms_and_empty_table(spark):
    docs = spark.createDataFrame([("a", "en", "x"), ("b", "en", "y"), ("c", "en", "z")], "text string, lang string, source string")
    assert rows_of(D.divergences(docs)) == brute([("a", "en", "x"), ("b", "en", "y"), ("c", "en", "z")], 30)
    assert D.divergences(docs.limit(0)).count() == 0


def test_one_hot_source(spark):
    rows = [("le the la " + "b" * (k % 3), "en", "hot" if k % 3 else f"s{k % 5}") for k in range(300)]
    groups = defaultdict(int)
    for r in rows:
        groups[r[2]] += 1
    assert max(groups.values()) * 3 >= len(rows)
    assert rows_of(D.divergences(spark.createDataFrame(rows, "text string, lang string, source string").repartition(6))) == brute(rows, 30)
