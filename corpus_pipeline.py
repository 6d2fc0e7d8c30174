"""A corpus in five stages: classify, apply quality rules, take one of each near-duplicate, mix sources, encode.

Each stage takes (spark, docs, folder) and returns a DataFrame; ``run`` writes
each result as Parquet into the shared folder and gives it to the next stage.
All stages but the last return the columns of ``documents``, whole rows as they
came.  Missing and empty texts are scored and judged like others; what the
quality rules say of a text under 50 words holds here too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from planlens.llm import robust_outliers, rule_ensemble, simhash, source_mix, word_bpe
from planlens.llm.common import store, table


def classify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rule ensemble scores one half or more."""
    return rule_ensemble.good_documents(docs, table(spark, folder, "labels"), 3, 1)


def apply_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return robust_outliers.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix by source takes them: not, once or twice."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, source, lang, ids and decoded of each document."""
    return word_bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), "doc_id", "source", "lang")


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode),
]

#: The classifier is fitted and links are followed step by step, which SQL can't express; tests/llm compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
