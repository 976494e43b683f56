"""Every stage against brute force over what the stage before kept, and the whole run."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tallyscope.llm import decontamination, language_crf, line_dedup
from test_decontamination import brute as brute_items
from test_line_dedup import brute as brute_lines
from test_shingle_join import brute as brute_groups


def test_stages_take_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(90001, "12 34 55", None, "s", 8), (None, "the end of the text and that is it", "en", None, None), (90002, None, "en", "s", 0), (90003, "", "en", "s", 0)], docs.schema)
    now = docs.union(docs.where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 80000)).union(extra).coalesce(3)
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for position, (name, stage) in enumerate(P.STAGES):
        before = [tuple(r) for r in now.collect()]
        out = stage(spark, now, small)
        path = str(tmp_path / str(position))
        out.write.parquet(path)
        columns, now = now.columns, spark.read.parquet(path)
        after = [tuple(r) for r in now.collect()]
        key = [c for c in columns if c not in ("text", "n_chars")]
        at, text = [columns.index(c) for c in key], columns.index("text")
        if position < len(P.STAGES) - 1:
            assert now.columns == columns, name
        if position == 0:
            assert not {90001, 90002, 90003} & {r[0] for r in after} and set(after) <= set(before)
            assert len(after) >= len(docs.collect()) * 0.99
        elif position == 1:
            hashes = {r.text: r.h for r in spark.createDataFrame([(b[text],) for b in before], "text string").select("text", line_dedup.text_print("text").alias("h")).collect()}
            want = brute_lines([(b[0], hashes[b[text]], b[text]) for b in before])
            assert sorted(((a[0], a[text]) for a in after), key=repr) == sorted(((w[0], w[1]) for w in want), key=repr)
        elif position == 2:
            groups = brute_groups([(i, b[text]) for i, b in enumerate(before)])
            assert len(after) == len({c for _, _, c in groups}) and set(after) <= set(before)
        elif position == 3:
            bad = {(i, ) for i, _, _ in brute_items([(n, b[text]) for n, b in enumerate(before) if b[text] and len(b[text]) < 4000], benchmark)}
            kept = {repr(a) for a in after}
            for n, b in enumerate(before):
                if b[text] and len(b[text]) < 4000:
                    assert (repr(b) in kept) == ((n,) not in bad), b[0]
        else:
            library = Tokenizer.from_file(public_tokenizers.path(P.WORD_BPE))
            assert len(after) == len(before)
            for r in now.collect():
                assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
                assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_empty_table(spark, small):
    none = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, small).count() == 0


def test_documents_of_several_languages_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    words = {r.lang: r.text.split()[:40] for r in docs.where("n_chars > 400").orderBy("doc_id").collect()}
    assert len(words) > 2
    clean = " ".join(w for name in sorted(words) for w in words[name])
    model = language_crf.fit(docs.where(language_crf.fold("doc_id", 3) != 1))
    switched = spark.createDataFrame([(95001, clean, None, "s", len(clean)), (95002, "12 - 34", None, "s", 7)], docs.schema)
    assert language_crf.predict(switched, model, spans=False).where("doc_id = 95001").first().score < 0.5
    kept = {r.doc_id for r in P.identify_language(spark, docs.union(switched), small).collect()}
    assert 95001 in kept and 95002 not in kept
