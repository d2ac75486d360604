"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. docs has the columns of documents; further ones are carried
along. All stages give an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from minuteflow.llm import op2_simhash, op3_pii, op5_quality, op9_decontaminate, op10_mix
from minuteflow.session import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go; null and empty texts are rejected, repeated rows share their verdict."""
    return op5_quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id; of equal rows one stays, texts without words are one group."""
    return op2_simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; null and empty texts stay; all rows of a doc_id go together, rows without one by their text."""
    return op9_decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; null texts stay null, overlapping spans are masked together."""
    return op3_pii.without_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix of sources; a null source is one source, equal doc_ids get a place each."""
    return op10_mix.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: Fingerprints and scheduling have no DuckDB form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
