"""Search analytics: totals, most frequent values and recent searches; ties go to the smaller value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.text import has_owner, strip


def top_values(rows: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """(value, count) of the most frequent non-blank values."""
    return rows.where(strip(F.coalesce(F.col(column), F.lit(""))) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def search_stats(searches: DataFrame, clicks: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """(kind, value, count) for popular queries, clicked meetings and items, and busy owners."""
    owners = items.where(has_owner(F.col("owner")))
    parts = [("query", searches, "query"), ("meeting", clicks, "meeting_id"), ("item", clicks, "item_id"), ("owner", owners, "owner")]
    frames = [top_values(rows, column, limit).select(F.lit(kind).alias("kind"), "value", "count") for kind, rows, column in parts]
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


def recent_searches(searches: DataFrame, limit: int = 10) -> DataFrame:
    return searches.orderBy(F.desc("created_at"), "search_id").limit(limit)
