"""From raw documents to packed training sequences: five stages, each an operator of tidewatch.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontamination, ngram_join, packing, quality_classifier, quality_rules
from tidewatch.llm.common import stored, table


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and the frequent lines of the others."""
    return quality_rules.judge_quality(docs, keep=True)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold go; the network is fitted on this stage's own input."""
    return quality_classifier.score_quality(docs, table(spark, sf_dir, "labels"), keep=True)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    # A small cache of words costs time alone: after the stages before, the executors' JVMs have grown to their full size.
    return packing.pack_documents(docs, with_ids=True, cache_words=100_000)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
