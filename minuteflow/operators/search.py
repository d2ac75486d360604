"""Ranked search over meetings and their items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.scoring import ITEM_WEIGHTS, MEETING_WEIGHTS, field_scores, recency_score, task_score
from minuteflow.functions.text import has_owner, is_meaningful
from minuteflow.operators.feedback import item_feedback, meeting_feedback


@dataclass(frozen=True)
class Filters:
    """None means not asked for; an empty string for owner still is an item filter."""

    date_from: str | None = None
    date_to: str | None = None
    responsible_unit: str | None = None
    chairperson: str | None = None
    status: str | None = None
    owner: str | None = None
    has_owner: bool | None = None
    has_planned_date: bool | None = None
    is_completed: bool | None = None
    has_tracking_result: bool | None = None

    @property
    def on_items(self) -> bool:
        return any(x is not None for x in (self.owner, self.has_owner, self.has_planned_date, self.is_completed, self.has_tracking_result))


def filter_meetings(meetings: DataFrame, f: Filters) -> DataFrame:
    """Meetings without a date pass the date bounds."""
    undated = F.coalesce(F.col("meeting_date"), F.lit("")) == ""
    if f.date_from:
        meetings = meetings.where(undated | (F.col("meeting_date") >= f.date_from))
    if f.date_to:
        meetings = meetings.where(undated | (F.col("meeting_date") <= f.date_to))
    if f.responsible_unit:
        meetings = meetings.where(F.col("responsible_unit") == f.responsible_unit)
    if f.chairperson:
        meetings = meetings.where(F.lower("chairperson").contains(f.chairperson.lower()))
    if f.status:
        meetings = meetings.where(F.col("status") == f.status)
    return meetings


def filter_items(items: DataFrame, f: Filters) -> DataFrame:
    if f.owner:
        items = items.where(F.lower("owner").contains(f.owner.lower()))
    for asked, test in (
        (f.has_owner, has_owner(F.col("owner"))),
        (f.has_planned_date, is_meaningful(F.col("planned_date"))),
        (f.is_completed, is_meaningful(F.col("actual_completed_date"))),
        (f.has_tracking_result, is_meaningful(F.col("tracking_result"))),
    ):
        if asked is not None:
            items = items.where(test if asked else ~test)
    return items


def scored_items(items: DataFrame, query: str, clicks: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """items with keyword, structure, task, feedback and graph scores, their sum and the matched fields.

    graph: (item_id, graph) boosts. The counters join after items were filtered and projected.
    """
    keyword, structure, fields = field_scores(ITEM_WEIGHTS, query)
    out = items.withColumns({"keyword": keyword, "structure": structure, "task": task_score(query), "matched_fields": fields})
    out = out.join(item_feedback(clicks, query), "item_id", "left") if clicks is not None else out.withColumn("feedback", F.lit(0.0))
    out = out.join(graph, "item_id", "left") if graph is not None else out.withColumn("graph", F.lit(0.0))
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("feedback", "graph")})
    return out.withColumn("item_score", F.expr("keyword + structure + task + feedback + graph"))


def sort_results(results: DataFrame, mode: str = "score") -> DataFrame:
    """Six orders; unknown modes sort by final score. Nulls count as '' or, ascending, as the last date."""
    final, date, key = F.col("final_score").desc(), F.coalesce("meeting_date", F.lit("")), F.col("meeting_id")
    if mode in ("meeting_date_asc", "date_asc", "oldest"):
        return results.orderBy(F.coalesce(F.when(F.col("meeting_date") != "", F.col("meeting_date")), F.lit("9999-12-31")), final, key)
    if mode in ("meeting_date_desc", "date_desc", "recent", "latest"):
        return results.orderBy(date.desc(), final, key.desc())
    for name in ("feedback", "keyword", "graph"):
        if mode in (name, f"{name}_score"):
            return results.orderBy(F.round(f"{name}_score", 2).desc(), final, date, key)
    return results.orderBy(final, date, key)


def search_meetings(
    meetings: DataFrame,
    items: DataFrame,
    query: str,
    as_of: str,
    filters: Filters = Filters(),
    clicks: DataFrame | None = None,
    graph_meetings: DataFrame | None = None,
    graph_items: DataFrame | None = None,
) -> DataFrame:
    """A row for each matching meeting: scores, matched fields and matched items, unsorted.

    Items are scored and summed before the join, so the shuffle carries a row for each meeting with
    items, and the sums are combined map-side.
    """
    asked = bool((query or "").strip())
    scored = scored_items(filter_items(items, filters), query, clicks, graph_items)
    if asked and not filters.on_items:
        scored = scored.where("keyword > 0 or graph > 0")
    # One entry for each matched item of a meeting: the contract returns them all.
    entry = F.struct((-F.col("item_score")).alias("rank"), "item_no", "item_id")
    per_meeting = scored.groupBy("meeting_id").agg(
        *[F.sum(c).alias(f"i_{c}") for c in ("keyword", "structure", "task", "feedback")],
        F.collect_list(entry).alias("entries"),
        F.flatten(F.collect_set("matched_fields")).alias("i_fields"),
    )
    keyword, structure, fields = field_scores(MEETING_WEIGHTS, query)
    found = filter_meetings(meetings, filters).withColumns({"m_keyword": keyword, "m_structure": structure, "m_fields": fields})
    found = found.join(per_meeting, "meeting_id", "inner" if filters.on_items else "left")
    found = found.join(meeting_feedback(clicks, query), "meeting_id", "left") if clicks is not None else found.withColumn("feedback", F.lit(0.0))
    found = found.join(graph_meetings, "meeting_id", "left") if graph_meetings is not None else found.withColumn("graph", F.lit(0.0))

    def zero(c: str) -> F.Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    found = found.withColumns(
        {
            "keyword_score": zero("m_keyword") + zero("i_keyword"),
            "structure_score": zero("m_structure") + zero("i_structure"),
            "task_score": zero("i_task"),
            "feedback_score": zero("feedback") + zero("i_feedback"),
            "graph_score": zero("graph"),
            "recency_score": recency_score(F.col("meeting_date"), as_of),
        }
    ).withColumn("final_score", F.expr("keyword_score + structure_score + task_score + feedback_score + graph_score + recency_score"))
    if asked:
        found = found.where("keyword_score > 0 or structure_score > 0 or task_score > 0 or feedback_score > 0 or graph_score > 0")
        matched = F.coalesce(F.array_sort("entries"), F.array())
    else:
        matched = F.coalesce(F.array_sort("entries"), F.array()) if filters.on_items else F.slice(F.coalesce(F.array_sort("entries"), F.array()), 1, 0)
    return found.select(
        "meeting_id", "meeting_name", "meeting_date", "responsible_unit", "chairperson",
        *[f"{s}_score" for s in ("keyword", "structure", "task", "feedback", "graph", "recency", "final")],
        F.array_sort(F.array_distinct(F.concat("m_fields", F.coalesce("i_fields", F.array().cast("array<string>"))))).alias("matched_fields"),
        F.transform(matched, lambda x: x["item_id"]).alias("matched_items"),
    )


def page(results: DataFrame, number: int = 1, limit: int = 10) -> DataFrame:
    """One page of sorted results; the plan keeps only the rows up to the page's end."""
    return results.offset((max(number, 1) - 1) * limit).limit(limit)
