"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphsieve.llm import chat, decontaminate, html_extract, langid, mixing, ngram_join, pii, substring_dedup, toxicity, winnow
from glyphsieve.llm.shared import read


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(read(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prefix_tree(read(spark, sf_dir, "conversations"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(read(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(read(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_extract.extracted(pages, html_extract.fit(pages))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.detect_languages(docs, langid.fit(docs))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(read(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_chat_formatting,
        op3_pii,
        op4_document_fingerprints,
        op5_benchmark_decontamination,
        op6_toxicity,
        op7_html_extraction,
        op8_language_id,
        op9_substring_dedup,
        op10_ngram_jaccard_join,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": mixing.oracle(),
    "op4_document_fingerprints": winnow.oracle(),
    "op9_substring_dedup": substring_dedup.oracle(),
    "op10_ngram_jaccard_join": ngram_join.oracle(),
}
