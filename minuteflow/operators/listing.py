"""Filtered lists, details, soft deletion and validation of stored rows."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_UPLOAD_BYTES = 50 * 1024 * 1024


def ignoring_case(rows: DataFrame, pattern: str) -> str:
    """The pattern without regard to case; one that doesn't compile is an error here rather than in every task."""
    whole = f"(?i){pattern}"
    try:
        rows.sparkSession._jvm.java.util.regex.Pattern.compile(whole)
    except IllegalArgumentException as broken:
        raise ValueError(f"no pattern: {pattern}") from broken
    return whole


def list_documents(documents: DataFrame, keyword: str | None = None, doc_type: str | None = None, status: str | None = None) -> DataFrame:
    """Documents that aren't deleted, newest first; keyword is a case-insensitive pattern on the file name."""
    found = documents.where(~F.coalesce("is_deleted", F.lit(False)))
    if keyword:
        found = found.where(F.col("original_filename").rlike(ignoring_case(documents, keyword)))
    if doc_type:
        found = found.where(F.col("doc_type") == doc_type)
    if status:
        found = found.where(F.col("status") == status)
    return found.select("document_id", "original_filename", "doc_type", "status", "page_count", "created_at").orderBy(F.desc("created_at"), "document_id")


def document_detail(documents: DataFrame, document_id: str) -> DataFrame:
    return documents.where((F.col("document_id") == document_id) & ~F.coalesce("is_deleted", F.lit(False))).limit(1)


def list_meetings(meetings: DataFrame, keyword: str | None = None, name: str | None = None, date_from: str | None = None, date_to: str | None = None, unit: str | None = None) -> DataFrame:
    """Newest first; here a meeting without a date fails date bounds."""
    found = meetings
    if keyword:
        pattern = ignoring_case(meetings, keyword)
        tests = F.col("meeting_name").rlike(pattern) | F.exists("attendees", lambda a: a.rlike(pattern))
        if "raw_text" in meetings.columns:
            tests = tests | F.coalesce(F.col("raw_text").rlike(pattern), F.lit(False))
        found = found.where(tests)
    if name:
        found = found.where(F.col("meeting_name").rlike(ignoring_case(meetings, name)))
    if unit:
        found = found.where(F.col("responsible_unit") == unit)
    if date_from:
        found = found.where(F.col("meeting_date") >= date_from)
    if date_to:
        found = found.where(F.col("meeting_date") <= date_to)
    return found.orderBy(F.desc("meeting_date"), "meeting_id")


def list_items(items: DataFrame, keyword: str | None = None, owner: str | None = None, planned_date: str | None = None, meeting_id: str | None = None) -> DataFrame:
    found = items
    if keyword:
        fields = [c for c in ("content", "tracking_result", "raw_row_text") if c in items.columns]
        test = F.lit(False)
        for c in fields:
            test = test | F.coalesce(F.col(c).rlike(ignoring_case(items, keyword)), F.lit(False))
        found = found.where(test)
    if owner:
        found = found.where(F.col("owner").rlike(ignoring_case(items, owner)))
    if planned_date:
        found = found.where(F.col("planned_date") == planned_date)
    if meeting_id:
        found = found.where(F.col("meeting_id") == meeting_id)
    return found.orderBy("meeting_id", "page_number", "item_no", "planned_date")


def meeting_detail(meetings: DataFrame, items: DataFrame, meeting_id: str) -> DataFrame:
    """The meeting's items with its own columns, by page and number; the key filter reaches both scans."""
    one = meetings.where(F.col("meeting_id") == meeting_id).select("meeting_id", "meeting_name", "meeting_date", "responsible_unit")
    return one.join(items.where(F.col("meeting_id") == meeting_id).drop("document_id"), "meeting_id", "left").orderBy("page_number", "item_no", "item_id")


def soft_delete(documents: DataFrame, document_id: str, at: str) -> DataFrame:
    """documents with one row marked as deleted, unless it already was."""
    hit = (F.col("document_id") == document_id) & ~F.coalesce("is_deleted", F.lit(False))
    return documents.withColumns(
        {
            "deleted_at": F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at")),
            "status": F.when(hit, F.lit("deleted")).otherwise(F.col("status")),
            "is_deleted": F.coalesce("is_deleted", F.lit(False)) | hit,
        }
    )


# What may be uploaded.
DENIED = ("exe", "bat", "cmd", "sh", "js", "html", "php")


def upload_problem(name: str, size: str, allowed: tuple[str, ...] = ("pdf", "docx")) -> F.Column:
    """Why a file is refused, or null."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return (
        F.when(suffix.isin(*DENIED), "dangerous extension")
        .when(~suffix.isin(*allowed), "unsupported extension")
        .when(F.col(size) > MAX_UPLOAD_BYTES, "too large")
        .when(F.coalesce(F.col(size), F.lit(0)) <= 0, "empty")
    )


def normalize_tags(tags: F.Column) -> F.Column:
    """A comma-separated text as a list of stripped, non-empty tags; null is an empty list."""
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda t: t != "")


def file_modified_at(given: F.Column, of_file: F.Column, now: F.Column) -> F.Column:
    """The given time if it can be read, else that of the stored file, else now."""
    return F.coalesce(F.try_to_timestamp(given), of_file, now)


def new_documents(uploads: DataFrame, at: str) -> DataFrame:
    """Records of uploaded files: uploads (document_id, original_filename, file_size, mime_type, doc_type, description, tags, given_modified_at, modification_time)."""
    now = F.lit(at).cast("timestamp")
    suffix = F.lower(F.regexp_extract("original_filename", r"[^.](\.[^.]+)$", 1))
    stored = F.concat("document_id", suffix)
    guessed = F.when(suffix == ".pdf", "application/pdf").when(suffix == ".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("application/octet-stream")
    text = lambda c, otherwise: F.coalesce(F.nullif(c, F.lit("")), F.lit(otherwise))
    return uploads.select(
        "document_id", "original_filename", stored.alias("stored_filename"), F.concat(F.lit("uploads/"), stored).alias("file_path"), suffix.alias("file_ext"), "file_size",
        F.coalesce(F.nullif("mime_type", F.lit("")), guessed).alias("mime_type"), text("doc_type", "unknown").alias("doc_type"), F.lit("uploaded").alias("status"), F.lit(None).cast("int").alias("page_count"),
        text("description", "").alias("description"), normalize_tags(F.col("tags")).alias("tags"), file_modified_at(F.col("given_modified_at"), F.col("modification_time"), now).alias("file_modified_at"),
        now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(False).alias("is_deleted"),
    )


def serialize_times(documents: DataFrame) -> DataFrame:
    """documents with their times as ISO texts with the offset of the session's zone."""
    times = [c for c in ("created_at", "updated_at", "deleted_at", "file_modified_at") if c in documents.columns]
    return documents.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx") for c in times})
