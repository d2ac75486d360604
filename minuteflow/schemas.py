"""Schemas of the canonical tables and empty frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = (
    "document_id string, original_filename string, stored_filename string, file_path string, file_ext string, file_size bigint, mime_type string, doc_type string, status string, "
    "page_count int, description string, tags array<string>, file_modified_at timestamp, created_at timestamp, updated_at timestamp, deleted_at timestamp, is_deleted boolean"
)
MEETINGS = (
    "meeting_id string, document_id string, company_name string, form_title string, form_no string, ref_no string, meeting_name string, meeting_date string, start_time string, "
    "end_time string, location string, chairperson string, recorder string, responsible_unit string, attendees array<string>, page_count int, raw_text string, status string, "
    "created_at timestamp, updated_at timestamp"
)
ITEMS = (
    "item_id string, meeting_id string, document_id string, item_no string, content string, owner string, planned_date string, actual_completed_date string, tracking_result string, "
    "page_number int, raw_row_text string, source string, status string, status_source string, status_confidence string, created_at timestamp, updated_at timestamp"
)
SEARCH_LOGS = "search_id string, query string, filters map<string,string>, result_count int, result_meeting_ids array<string>, created_at timestamp"
CLICKS = "click_id string, search_id string, query string, meeting_id string, item_id string, document_id string, created_at timestamp"
PAGES = (
    "document_id string, page_count int, word_count int, raw_text string, pages array<struct<page_number:int,text:string,"
    "words:array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>,tables:array<struct<bbox:array<double>,rows:array<array<string>>>>,width:double,height:double>>"
)
EDGES = "src_type string, src_id string, relation string, dst_type string, dst_id string, field string, score double, method string, count bigint, weight double"
GRAPH_RESULTS = (
    "meeting_id string, meeting_name string, meeting_date string, item_id string, item_no string, content string, matched_keyword string, matched_entity string, matched_relation string, "
    "matched_field string, graph_score double"
)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """An empty frame: what an absent store looks like."""
    return spark.createDataFrame([], schema)
