"""Item status rules as one struct expression: the first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.text import CJK, contains_lower, is_meaningful, normalize_placeholder, nullable

SUPPORTED = ("pending", "in_progress", "completed", "not_completed", "not_applicable")
# Terms of each status in tracking texts.
COMPLETED_TERMS = ("已完成", "結案", "closed", "completed", "done", "resolved")
COMPLETED_PATTERNS = ("確認已完成", "確認完成", "已完成", "完成，詳", "完成,詳", "完成詳")
IN_PROGRESS_TERMS = ("進行中", "處理中", "確認中", "追蹤中", "待確認", "pending", "in progress", "ongoing", "follow up")
NOT_APPLICABLE_TERMS = ("不適用", "not applicable", "n/a", "na")


def normalize_status_text(c: Column) -> Column:
    """Lower case, no white space between CJK characters, single blanks elsewhere."""
    low = F.lower(F.coalesce(c, F.lit("")))
    general = F.regexp_replace(F.regexp_replace(low, rf"(?U)(?<=[{CJK}])\s+(?=[{CJK}])", ""), r"(?U)\s+", " ")
    # Printable ASCII with single blanks is normal already.
    return F.trim(F.when(low.rlike(r"[^\x20-\x7e]|  "), general).otherwise(low))


def is_not_applicable(c: Column, text: Column | None = None) -> Column:
    """Dashes only, or a not-applicable term (the bare syllable 'na' counts); text is c normalized, where that is known."""
    text = normalize_status_text(c) if text is None else text
    return normalize_placeholder(c).isin("-", "--") | contains_lower(text, NOT_APPLICABLE_TERMS)


def is_completed_text(c: Column, text: Column | None = None) -> Column:
    text = normalize_status_text(c) if text is None else text
    return ~is_not_applicable(c, text) & (contains_lower(text, COMPLETED_PATTERNS) | contains_lower(text, COMPLETED_TERMS))


def classify_status(completed_date: Column, tracking: Column, text: Column | None = None) -> Column:
    """struct<status, status_source, status_confidence>; text is tracking normalized, where that is known."""
    text = normalize_status_text(tracking) if text is None else text

    def of(status: str, source: str, confidence: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(source).alias("status_source"), F.lit(confidence).alias("status_confidence"))

    return (
        F.when(is_meaningful(completed_date), of("completed", "actual_completed_date", "high"))
        .when(is_not_applicable(tracking, text), of("not_applicable", "tracking_result", "high"))
        .when(is_completed_text(tracking, text), of("completed", "tracking_result", "high"))
        .when(contains_lower(text, IN_PROGRESS_TERMS), of("in_progress", "tracking_result", "medium"))
        .otherwise(of("pending", "", "low"))
    )


def with_status(items: DataFrame, recompute: bool = True) -> DataFrame:
    """items with placeholder dates nulled and the three status fields; a supported stored status wins unless recompute."""
    # Generated rows: no filter or projection repeats what they hold, and each text is normalized once.
    items = items.select("*", F.inline_outer(F.array(F.struct(normalize_status_text(F.col("tracking_result")).alias("_text")))))
    found = classify_status(F.col("actual_completed_date"), F.col("tracking_result"), F.col("_text"))
    if not recompute and "status" in items.columns:
        stored = F.struct("status", F.coalesce("status_source", F.lit("")).alias("status_source"), F.coalesce("status_confidence", F.lit("")).alias("status_confidence"))
        found = F.when(F.col("status").isin(*SUPPORTED), stored).otherwise(found)
    return (
        items.select("*", F.inline_outer(F.array(F.struct(found.alias("_s")))))
        .withColumns({c: F.col(f"_s.{c}") for c in ("status", "status_source", "status_confidence")})
        .drop("_s", "_text")
        .withColumns({c: nullable(F.col(c)) for c in ("planned_date", "actual_completed_date")})
    )
