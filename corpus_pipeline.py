"""From raw documents to token ids: toxic texts go, texts of no certain language go, one document of each group of
near copies stays, documents that hold benchmark items go, the rest is encoded.

Each stage is a function of (spark, docs, sf_dir) and works on what its predecessor kept. Rows with null text have
no toxic word, no language (they go there), no n-gram and no benchmark item. Columns besides doc_id, text and lang
pass through the filters untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from camtrap_spark.llm import decontaminate, language_id, ngram_join, sentencepiece_viterbi, toxicity
from camtrap_spark.llm.common import keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chain is fitted on the labelled documents among docs; those that it calls toxic go."""
    return toxicity.remove(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the languages that docs name; texts of no certain language, or unlike it, go."""
    return language_id.remove(docs, language_id.fit(docs, familiar=True))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one of the smallest id stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, within its error budget, go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, round_trip and ids of every document."""
    return sentencepiece_viterbi.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("ngram_join", keep_one_of_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Fitted models and Viterbi search have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
