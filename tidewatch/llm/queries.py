"""The queries of this subpackage, by their registered names, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontamination, html_extract, language_id, lexical_search, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, simhash, token_files, url_filter
from .common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_language(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.report(conversations.repair_conversations(damaged, "copies"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_ngram_join": op2_ngram_join,
        "op3_url_filter": op3_url_filter,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_quality_rules": op5_quality_rules,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_packing": op7_packing,
        "op8_decontamination": op8_decontamination,
        "op9_language_id": op9_language_id,
        "op10_token_files": op10_token_files,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_lexical_search": op12_lexical_search,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": ngram_join.SQL,
        "op3_url_filter": url_filter.SQL,
        "op5_quality_rules": quality_rules.SQL,
        "op8_decontamination": decontamination.SQL,
        "op12_lexical_search": lexical_search.SQL,
    }
