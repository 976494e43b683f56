"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyscope.llm import bpe_lexicon, class_ngrams, collocations, decontamination, language_crf, license_scan, line_dedup, merkle_prints, sentence_spans, shingle_join, source_divergence, token_counts, voronoi_knn, word_classes

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


@query
def op2_bpe_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    lexicon = bpe_lexicon.compile_lexicon(docs, path)
    both = bpe_lexicon.encode_and_decode(docs, lexicon, path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_voronoi_knn(spark: SparkSession, folder: str) -> DataFrame:
    return voronoi_knn.top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


LLM_SQL["op3_voronoi_knn"] = """
WITH c AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                  CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
           FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query
def op4_class_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = language_crf.fold("doc_id", 7) == 2
    model, counts = class_ngrams.learn(docs, held_out)
    model, counts = word_classes.exchange_words(docs, held_out, model, counts)
    return class_ngrams.scored(docs, held_out, model, counts)


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


@query
def op6_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(language_crf.fold("doc_id", 3) == 1, F.lit(False))
    model = language_crf.fit(docs.where(language_crf.fold("doc_id", 3) != 1))
    labelled = language_crf.predict(docs.select("doc_id", "text"), model, spans=False)
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentence_spans.dedup_spans(docs).select("doc_id", "n_sentences", "n_removed", "text")


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


LLM_SQL["op8_license_scan"] = license_scan.scan_sql()


@query
def op9_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, folder, "benchmark").select("item_id", "text"))


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.collocations(table(spark, folder, "documents").select("text", "lang"))
    return collocations.best_phrases(found, 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


LLM_SQL["op11_collocations"] = collocations.phrases_sql()


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergences(table(spark, folder, "documents").select("text", "lang", "source"))


LLM_SQL["op12_source_divergence"] = source_divergence.divergences_sql()


@query
def op13_merkle_prints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_prints.edited_fingerprints(table(spark, folder, "documents").select("doc_id", "text"))


LLM_SQL["op13_merkle_prints"] = merkle_prints.edited_fingerprints_sql()
