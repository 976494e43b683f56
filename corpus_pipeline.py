"""The corpus pipeline: stages that each call one training-data operator on all rows the stage before kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; the last adds token ids and
the text they decode to. Nulls, repeated rows, empty tables and odd texts are handled as the operators' docstrings say.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyscope.llm import bpe_lexicon, decontamination, language_crf, line_dedup, shingle_join
from tallyscope.llm.words import free_name
from tallyscope.session import stored

WORD_BPE = "word_bpe_49k.json"
#: Words of the shortest benchmark item for which documents are dropped.
LEAST_ITEM_WORDS = 6
#: Whole texts are a few kilobytes or more, so few of them make an Arrow batch.
BATCH_ROWS = 500


def with_row_numbers(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a stored number for every row, in a column of a free name, and that name."""
    row = free_name(docs, "_row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id())), row


def short_batches(stage: Callable) -> Callable:
    """A stage whose Arrow batches have ``BATCH_ROWS`` rows at most."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, BATCH_ROWS)
        return stage(spark, docs, sf_dir)
    return run_stage


@short_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that have no language (no letters) go; those of several or of close languages stay.

    The model learns from the stage's own labelled rows; a held-out fold takes no part, as in the query.
    """
    model = language_crf.fit(docs.where(language_crf.fold("doc_id", 3) != 1))
    labelled = language_crf.predict(docs, model, spans=False)
    return labelled.where(F.col("lang_pred") != language_crf.UNKNOWN).select(*docs.columns)


@short_batches
def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that an earlier line matches go from their texts; every document keeps its row."""
    clean = line_dedup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@short_batches
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of linked documents the first row stays, and so do rows that link with nothing.

    Row numbers are given once and stored, so that null and repeated ids are told apart; they follow ``doc_id`` as far
    as the table does.
    """
    numbered, row = with_row_numbers(docs)
    groups = shingle_join.jaccard_components(numbered, ids=row)
    # Few go, and their stored number tells the planner how to join.
    others = stored(groups.where(F.col(row) != F.col("component_id")).select(row))
    return numbered.join(others, row, "left_anti").select(*docs.columns)


@short_batches
def remove_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark passage of ``LEAST_ITEM_WORDS`` words or more, edited or not, go.

    The operator reports shorter items as well, but a document that has a word or two in common with one is no copy.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    long_enough = benchmark.where(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))) >= LEAST_ITEM_WORDS)
    numbered, row = with_row_numbers(docs)
    found = stored(decontamination.contaminated(numbered, long_enough, ids=row).select(row).distinct())
    return numbered.join(found, row, "left_anti").select(*docs.columns)


@short_batches
def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token ids of every document kept, and the text they decode to."""
    path = public_tokenizers.path(WORD_BPE)
    lexicon = bpe_lexicon.compile_lexicon(docs, path)
    return bpe_lexicon.encode_and_decode(docs, lexicon, path)


STAGES = [
    ("language identification", identify_language),
    ("line deduplication", remove_repeated_lines),
    ("n-gram jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", remove_benchmark_copies),
    ("bpe encoding and decoding", encode_documents),
]

#: Learned languages, components and alignments are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = stored(docs)
    return docs
