"""Score columns of the ranked search: field weights, task intent, recency and click feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from minuteflow.functions.text import any_matches, has_owner, is_meaningful, matches_query

# Weights of fields and words that show a question about tasks.
MEETING_WEIGHTS = {"meeting_name": 10, "responsible_unit": 5, "chairperson": 4, "recorder": 3, "attendees": 3, "location": 2}
ITEM_WEIGHTS = {"content": 8, "owner": 5, "planned_date": 3, "actual_completed_date": 3, "tracking_result": 4}
STRUCTURE_WEIGHTS = {"meeting_name": 5, "content": 4, "owner": 3, "responsible_unit": 3, "attendees": 2}
TASK_TERMS = (
    "owner", "responsible", "assignee", "person in charge", "due", "deadline", "planned", "completed", "completion", "unfinished", "pending", "overdue", "tracking", "follow-up", "follow up",
    "負責", "負責人", "權責", "預計", "日期", "期限", "完成", "完成日", "實際完成", "未完成", "逾期", "追蹤", "結果", "待辦", "任務",
)


def _hits(weights: dict[str, int], query: str) -> dict[str, Column]:
    return {f: any_matches(F.col(f), query) if f == "attendees" else matches_query(F.col(f), query) for f in weights}


def _total(hits: dict[str, Column], weights: dict[str, int]) -> Column:
    parts = [F.when(h, float(weights[f])).otherwise(0.0) for f, h in hits.items() if f in weights]
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def field_scores(weights: dict[str, int], query: str) -> tuple[Column, Column, Column]:
    """(keyword score, structure score, matched fields) of a row."""
    hits = _hits(weights, query)
    fields = F.array_compact(F.array(*[F.when(h, F.lit(f)) for f, h in hits.items()]))
    return _total(hits, weights), _total(hits, STRUCTURE_WEIGHTS), fields


def has_task_intent(query: str) -> bool:
    low = (query or "").lower()
    return any(t in low for t in TASK_TERMS)


def task_score(query: str) -> Column:
    """Open work of an item, for questions about tasks: owner 2, planned date 2, not completed 2, no tracking 1."""
    if not has_task_intent(query):
        return F.lit(0.0)
    return (
        F.when(has_owner(F.col("owner")), 2.0).otherwise(0.0)
        + F.when(is_meaningful(F.col("planned_date")), 2.0).otherwise(0.0)
        + F.when(is_meaningful(F.col("actual_completed_date")), 0.0).otherwise(2.0)
        + F.when(is_meaningful(F.col("tracking_result")), 0.0).otherwise(1.0)
    )


def recency_score(date: Column, as_of: str) -> Column:
    """5, 3 or 1 within 30, 90 or 180 days of as_of; later dates count as today, unreadable ones as old."""
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), F.try_to_date(date, "yyyy-M-d")), F.lit(0))
    return F.when(age <= 30, 5.0).when(age <= 90, 3.0).when(age <= 180, 1.0).otherwise(0.0)
