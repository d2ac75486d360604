"""Files in and out: golden cases, question lists, page payloads, mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteflow.schemas import PAGES

CASES = "id string, enabled boolean, question string, `limit` string, expected_item_ids array<string>, expected_meeting_ids array<string>, expected_relations array<string>, unexpected_item_ids array<string>, require_consistency boolean, review_status string"


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON files that hold a list or {"cases": [...]}."""
    listed = spark.read.schema(f"cases array<struct<{CASES.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    plain = spark.read.schema(CASES).json(path, multiLine=True).where("id is not null")
    return listed.unionByName(plain).dropDuplicates(["id"])


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, without blank lines and comments."""
    return spark.read.text(path).select(F.trim("value").alias("question")).where("question <> '' and question not like '#%'")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Extracted page payloads, one JSON object a line."""
    return spark.read.schema(PAGES).json(path)


def write_mapping(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").json(path)


def merge_mapping(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, original, anonymized), sorted: new entries replace stored ones of the same key; of equal keys in new the smallest stays."""
    fresh = new.groupBy("kind", "original").agg(F.min("anonymized").alias("anonymized"))
    return stored.join(fresh.select("kind", "original"), ["kind", "original"], "left_anti").unionByName(fresh).orderBy("kind", "original")
