import random

import pytest

WORDS = ["alpha", "beta", "the", "of", "Größe", "naïve", "it's", "x1", "12", "über", "Σίσυφος", "é", "don't", "a.b", "▁", "ſ", "中文", "😀"]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tied, repeated, special and very long texts."""
    pick = random.Random(5)
    texts = [None, "", " ", "\n\n", "a", "a", "The  cat\tsat", "<|endoftext|>x", "end <|endoftext|>", "x" * 5000, "\0a\0", "é" * 300]
    texts += [" ".join(pick.choice(WORDS) for _ in range(pick.randint(1, 60))) for _ in range(60)]
    return texts + [" ".join(pick.choice(WORDS) for _ in range(20000))]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    rows = [(None if i % 17 == 3 else i, t, None if i % 5 else "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows + rows[:4], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
