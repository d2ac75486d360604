"""Click feedback: global and similar-query click counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.text import similar_queries


def feedback_counts(clicks: DataFrame, query: str, key: str) -> DataFrame:
    """(key, all_clicks, similar_clicks) for meeting_id or item_id."""
    similar = similar_queries(F.col("query"), F.lit(query))
    return clicks.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("all_clicks"), F.sum(F.when(similar, 1).otherwise(0)).cast("bigint").alias("similar_clicks"))


def meeting_feedback(clicks: DataFrame, query: str) -> DataFrame:
    """(meeting_id, feedback): half a point for each click, another half if its query was similar."""
    return feedback_counts(clicks, query, "meeting_id").select("meeting_id", (0.5 * F.col("all_clicks") + 0.5 * F.col("similar_clicks")).alias("feedback"))


def item_feedback(clicks: DataFrame, query: str) -> DataFrame:
    """(item_id, feedback): one point for each click, half a point more if its query was similar."""
    return feedback_counts(clicks, query, "item_id").select("item_id", (F.col("all_clicks") + 0.5 * F.col("similar_clicks")).alias("feedback"))


def record_click(logs: DataFrame, search_id: str, meeting_id: str, item_id: str | None, document_id: str | None, click_id: str, at: str) -> DataFrame:
    """The click row to append, with the search's query; no row if the search is unknown."""
    return logs.where(F.col("search_id") == search_id).limit(1).select(
        F.lit(click_id).alias("click_id"),
        "search_id",
        "query",
        F.lit(meeting_id).alias("meeting_id"),
        F.lit(item_id).cast("string").alias("item_id"),
        F.lit(document_id).cast("string").alias("document_id"),
        F.lit(at).cast("timestamp").alias("created_at"),
    )
