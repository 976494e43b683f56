"""Token counts and BPE against the tokenizers library itself."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tallyscope.llm import bpe_lexicon, token_counts
from tallyscope.llm.queries import LLM_QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def unigram():
    library = Tokenizer(models.Unigram(token_counts.unigram_vocabulary(PIECES), unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return library


def test_counts_equal_the_library(spark, odd_docs, odd_texts):
    library = unigram()
    got = token_counts.token_counts(odd_docs.withColumn("n_tokens", F.lit("x")), PIECES)
    assert got.columns == [*odd_docs.columns, "n_tokens"]
    rows = got.collect()
    assert len(rows) == len(odd_texts) + 4
    for r in rows:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids), (r.text or "")[:80]


def test_counts_on_ties():
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0)]
    counter = token_counts.WordCounter(vocabulary)
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    for text in ("ab", "aba", "ababab", "b a", "bb ab", " ab", "  a"):
        assert counter.of_text(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_count_query_equals_the_library(spark, small):
    library = unigram()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = LLM_QUERIES["op1_token_counts"](spark, small).collect()
    assert len(rows) == len(texts)
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in rows)


def test_bpe_equals_the_library(spark, odd_docs, odd_texts):
    library = Tokenizer.from_file(WORDS)
    lexicon = bpe_lexicon.compile_lexicon(odd_docs, WORDS, least_count=2)
    rows = bpe_lexicon.decode(bpe_lexicon.encode(odd_docs.withColumn("ids", F.lit(1)), lexicon, WORDS), WORDS).collect()
    assert len(rows) == len(odd_texts) + 4
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want, (r.text or "")[:80]
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_of_an_empty_table(spark, odd_docs):
    none = odd_docs.limit(0)
    lexicon = bpe_lexicon.compile_lexicon(none, WORDS)
    assert bpe_lexicon.encode(none, lexicon, WORDS).count() == 0
    assert bpe_lexicon.encode(odd_docs, lexicon, WORDS).where(F.size("ids") > 0).count() > 50
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_transducer_is_minimal_and_exact(tmp_path):
    words = [b"", b"a", b"bing", b"king", b"kings", b"rings", b"sing", b"singing"]
    path = tmp_path / "lexicon"
    path.write_bytes(bpe_lexicon.compile_transducer([(w, [i, i + 1]) for i, w in enumerate(words)]))
    t = bpe_lexicon.Transducer(str(path))
    numbers = t.lookup([*words, b"k", b"kingz", b"zz", b"singin"])
    assert numbers.tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert [t.ids[t.ends[n]:t.ends[n + 1]].tolist() for n in range(3)] == [[0, 1], [1, 2], [2, 3]]
    # The same right languages: one state each.
    right = set()
    for w in words:
        for cut in range(len(w) + 1):
            right.add(frozenset(x[cut:] for x in words if x.startswith(w[:cut])))
    assert len(t.final) == len(right)


def test_bpe_query_equals_the_library(spark, small):
    library = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = LLM_QUERIES["op2_bpe_lexicon"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
