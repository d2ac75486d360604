"""Searches as they are answered: snippets, items, total and log."""

from __future__ import annotations

import pytest

from minuteflow.operators import search_page
from minuteflow.operators.search import Filters
from minuteflow.session import fresh_path

MEETINGS = "meeting_id string, document_id string, meeting_name string, meeting_date string, responsible_unit string, chairperson string, recorder string, attendees array<string>, location string, status string"
ITEMS = "item_id string, meeting_id string, item_no string, content string, owner string, planned_date string, actual_completed_date string, tracking_result string"


@pytest.fixture(scope="module")
def rows(spark):
    meetings = [("m1", "d1", "Red ring review", "2001-05-01", "Ring unit", "Ann", "Bob", ["Ann"], None, "parsed"), ("m2", "d2", "Other", "2001-05-02", None, "Ann", "Bob", None, None, "parsed"), ("m3", "d3", "None", "2001-05-03", "x", None, None, None, None, "parsed")]
    long = "before " * 10 + "the RED RING of the gear " + "after " * 10
    items = [("i2", "m1", "02", long, "Carol", None, "2001-06-01", None), ("i1", "m1", "01", "A red ring", "--", None, None, "red ring is late"), ("i3", "m2", "01", "No such part", "Dan", None, None, None), ("i4", "m2", "02", "red ring", None, None, None, None), ("i5", "m2", "03", "red ring", None, None, None, None)]
    return spark.createDataFrame(meetings, MEETINGS), spark.createDataFrame(items, ITEMS)


def search(spark, rows, store, query="red ring", search_id="s1", **more):
    return search_page.search_and_log(*rows, query, "2001-08-01", store, search_id, "2001-08-01 10:00:00", **more)


def test_page_total_snippets_and_items(spark, rows):
    found = search(spark, rows, fresh_path(spark), expanded=("gear", "unit", " "))
    by = {r["meeting_id"]: r for r in found.rows.collect()}
    assert (found.total, set(by)) == (2, {"m1", "m2"})
    assert [(s["field"], s["snippet"]) for s in by["m1"]["snippets"]] == [
        ("content", "A <mark>red ring</mark>"), ("content", "...e before before the <mark>RED RING</mark> of the gear after after after..."), ("meeting_name", "<mark>Red ring</mark> review"),
        ("tracking_result", "<mark>red ring</mark> is late"), ("responsible_unit", "Ring <mark>unit</mark>"),
    ]
    # Equal snippets of one field are one.
    assert [(s["field"], s["snippet"]) for s in by["m2"]["snippets"]] == [("content", "<mark>red ring</mark>")]
    assert {i["item_id"]: i["state"]["status"] for i in by["m1"]["items"]} == {"i1": "pending", "i2": "completed"}
    assert [i["item_id"] for i in by["m2"]["items"]] == ["i4", "i5"] and by["m2"]["document_id"] == "d2"


def test_pages_filters_and_nothing(spark, rows):
    store = fresh_path(spark)
    second = search(spark, rows, store, sort="date_desc", number=2, limit=1)
    assert (second.total, [r["meeting_id"] for r in second.rows.collect()]) == (2, ["m1"])
    owned = search(spark, rows, store, query="", search_id="s2", filters=Filters(has_owner=True))
    assert {r["meeting_id"]: [i["item_id"] for i in r["items"]] for r in owned.rows.collect()} == {"m1": ["i2"], "m2": ["i3"]}
    everything = search(spark, rows, store, query=" ", search_id="s3")
    assert (everything.total, {(len(r["items"]), len(r["snippets"])) for r in everything.rows.collect()}) == (3, {(0, 0)})
    nothing = search(spark, rows, store, query="no such words", search_id="s4", filters=Filters(status="gone"))
    assert (nothing.total, nothing.rows.count()) == (0, 0)
    logs = {r["search_id"]: (r["query"], r["result_count"], r["filters"]) for r in search_page.search_logs(spark, store).collect()}
    assert {k: v[:2] for k, v in logs.items()} == {"s1": ("red ring", 2), "s2": ("", 2), "s3": (" ", 3), "s4": ("no such words", 0)}
    assert logs["s2"][2] == {"has_owner": "true", "sort_by": "score", "page": "1", "limit": "10"}


def test_a_repeated_search_is_logged_once(spark, rows):
    store = fresh_path(spark)
    for _ in range(2):
        search(spark, rows, store)
    assert [(r["search_id"], r["result_count"]) for r in search_page.search_logs(spark, store).collect()] == [("s1", 2)]
    with pytest.raises(ValueError):
        search(spark, rows, store, search_id="../s1")
