"""A search as it is answered: one page of results with its snippets and items, the total, and a log of the search.

Only the page's meetings get snippets and items. The results are written once; counting them is part of that job.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from minuteflow.functions.status import classify_status
from minuteflow.operators.highlight import SNIPPETS, holds_term, snippet
from minuteflow.operators.search import Filters, filter_items, page, scored_items, search_meetings, sort_results
from minuteflow.session import materialize

MEETING_FIELDS, ITEM_FIELDS = ("meeting_name", "responsible_unit"), ("content", "owner", "tracking_result")
ITEM_COLUMNS = ("item_id", "item_no", "content", "owner", "planned_date", "actual_completed_date", "tracking_result")


@dataclass(frozen=True)
class SearchPage:
    """rows: a page of results in order, with snippets (field, snippet) and items; total: how many results there are."""

    search_id: str
    total: int
    expanded_keywords: tuple[str, ...]
    rows: DataFrame


def meeting_snippets(meetings: DataFrame, items: DataFrame, query: str, more: Sequence[str] = ()) -> DataFrame:
    """(meeting_id, snippets): up to SNIPPETS different ones of a meeting and its items, those that hold the query itself first, then by field and place."""
    terms = [t for t in (query, *more) if (t or "").strip()]

    def of(rows: DataFrame, fields: tuple[str, ...], place: list) -> DataFrame:
        entry = lambda k, f: F.struct(F.lit(f).alias("field"), snippet(F.col(f), terms).alias("snippet"), holds_term(F.col(f), query).alias("direct"), F.lit(k).alias("k"))
        each = rows.select("meeting_id", F.struct(*place).alias("place"), F.explode_outer(F.array(*[entry(k, f) for k, f in enumerate(fields)])).alias("e"))
        return each.select("meeting_id", "place", "e.*").where("snippet is not null")

    first = [F.lit(0).alias("of_item"), F.lit("").alias("item_no"), F.lit("").alias("item_id")]
    later = [F.lit(1).alias("of_item"), F.coalesce("item_no", F.lit("")).alias("item_no"), F.coalesce("item_id", F.lit("")).alias("item_id")]
    found = of(meetings, MEETING_FIELDS, first).unionByName(of(items, ITEM_FIELDS, later))
    different = found.groupBy("meeting_id", "field", "snippet").agg(F.min(F.struct("place", "k", "direct")).alias("m"))
    entry = F.struct((~F.col("m.direct")).alias("indirect"), "field", F.col("m.place").alias("place"), F.col("m.k").alias("k"), "snippet")
    listed = different.groupBy("meeting_id").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    return listed.select("meeting_id", F.transform(F.slice("s", 1, SNIPPETS), lambda s: F.struct(s["field"].alias("field"), s["snippet"].alias("snippet"))).alias("snippets"))


def with_details(shown: DataFrame, meetings: DataFrame, items: DataFrame, query: str, filters: Filters = Filters(), clicks: DataFrame | None = None, graph_items: DataFrame | None = None, expanded: Sequence[str] = ()) -> DataFrame:
    """Results of search_meetings with document_id, snippets and items (their fields, status and score, best first).

    Without a query and without item filters there are no items. Snippets come from all items that pass the filters, of meetings that show any.
    """
    asked = bool((query or "").strip())
    own = filter_items(items, filters).join(shown.select("meeting_id"), "meeting_id", "left_semi")
    scored = scored_items(own, query, clicks, graph_items)
    matched = scored.where(F.lit(filters.on_items)) if not asked else scored if filters.on_items else scored.where("keyword > 0 or graph > 0")
    state = classify_status(F.col("actual_completed_date"), F.col("tracking_result"))
    entry = F.struct(
        (-F.col("item_score")).alias("rank"), F.coalesce("item_no", F.lit("")).alias("no"), F.coalesce("item_id", F.lit("")).alias("id"),
        F.struct(*ITEM_COLUMNS, state.alias("state"), F.col("item_score").alias("final_score"), F.col("keyword").alias("keyword_score"), F.col("structure").alias("structure_score"), F.col("task").alias("task_score"), F.col("feedback").alias("feedback_score"), F.col("graph").alias("graph_score")).alias("item"),
    )
    listed = matched.groupBy("meeting_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    of_shown = meetings.join(shown.select("meeting_id"), "meeting_id", "left_semi")
    marked = meeting_snippets(of_shown, own.join(listed.select("meeting_id"), "meeting_id", "left_semi"), query, expanded)
    out = shown.join(of_shown.select("meeting_id", "document_id"), "meeting_id", "left").join(listed, "meeting_id", "left").join(marked, "meeting_id", "left")
    none = F.expr("cast(array() as array<struct<field:string,snippet:string>>)")
    return out.withColumns({"items": F.coalesce(F.transform("entries", lambda e: e["item"]), F.array()), "snippets": F.coalesce("snippets", none)}).drop("entries")


def search_and_log(
    meetings: DataFrame, items: DataFrame, query: str, as_of: str, store: str, search_id: str, at: str, filters: Filters = Filters(), sort: str = "score", number: int = 1, limit: int = 10,
    clicks: DataFrame | None = None, graph_meetings: DataFrame | None = None, graph_items: DataFrame | None = None, expanded: Sequence[str] = (),
) -> SearchPage:
    """Search, write the results and the search's log below store, and give one page of them.

    store/results/search_id=... holds the results, store/logs/search_id=... one row (query, filters, result_count,
    created_at). Both are overwritten where the same search_id comes again, so that a search that is repeated after a failure is
    logged once. expanded are the related words that a graph search added; they only mark snippets.
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", search_id):
        raise ValueError("a search_id of letters, digits, _ and - is required")
    spark, seen = meetings.sparkSession, Observation()
    found = search_meetings(meetings, items, query, as_of, filters, clicks, graph_meetings, graph_items)
    path = f"{store}/results/search_id={search_id}"
    found.observe(seen, F.count(F.lit(1)).alias("total")).write.mode("overwrite").parquet(path)
    total = int(seen.get["total"])
    given = asdict(filters) | {"sort_by": sort, "page": number, "limit": limit}
    texts = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in given.items() if v not in (None, "")}
    log = spark.createDataFrame([(query, texts, total, at)], "query string, filters map<string,string>, result_count bigint, created_at string")
    log.withColumn("created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(f"{store}/logs/search_id={search_id}")
    stored = spark.read.schema(found.schema).parquet(path)
    shown = materialize(page(sort_results(stored, sort), number, limit))
    return SearchPage(search_id, total, tuple(expanded), sort_results(with_details(shown, meetings, items, query, filters, clicks, graph_items, expanded), sort))


def search_logs(spark, store: str) -> DataFrame:
    """(query, filters, result_count, created_at, search_id) of all searches logged below store."""
    return spark.read.option("basePath", f"{store}/logs").parquet(f"{store}/logs/*")
