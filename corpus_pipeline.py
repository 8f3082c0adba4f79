"""The corpus pipeline: five operators of ``glyphsieve.llm``, one after another.

Of every stage: a null, empty or very long text, a null in any other column, a tie, a
repeated row, and a column of any other name go through it as said at the stage; an
empty table gives an empty table with the same columns (the last stage adds ``epoch``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphsieve.llm import decontaminate, langid, mixing, ngram_join, pii
from glyphsieve.llm.shared import outside, read, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network accepts.

    Null and empty texts, and those without a letter, go; null keys and repeated rows stay
    or go by their text; a null language only means that the row isn't learnt from; very
    long texts are read whole. Without any declared language all texts that aren't empty stay."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar documents link: the one of the least id.

    Rows with a null key, and texts that are null or without words, stay; all rows of the
    least key stay, repeated ones too (their key is one document); a group has one least key,
    so there are no ties; very long texts are compared whole."""
    return ngram_join.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark occurs.

    Null and empty texts contain nothing and stay; null keys and repeated rows stay or go by
    their text; very long texts are searched whole; an empty benchmark removes nothing."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by the name of its kind; n_chars follows.

    Null texts stay null and keep their n_chars; a null n_chars stays null; each repeated row
    is masked alike; of overlapping spans the better one is masked (``pii`` says how ties end)."""
    return pii.masked_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by epoch, in the proportions of the tree.

    A null language or source counts as an empty name; null and empty texts cost nothing and
    come with their leaf; rows of one key (null too) are taken together or not at all."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("private_data", private_data),
    ("source_mixing", source_mixing),
]

#: The first stage trains a network, so SQL can't give the rows; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself is deleted once its result is written."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = outside(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
