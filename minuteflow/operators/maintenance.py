"""Repair and reset jobs over stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.status import with_status

STATUS_FIELDS = ("status", "status_source", "status_confidence", "planned_date", "actual_completed_date")


def repair_statuses(items: DataFrame) -> DataFrame:
    """(item_id, status fields) of the items whose stored fields differ from the recomputed ones."""
    stored = {c: (F.col(c) if c in items.columns else F.lit(None).cast("string")) for c in STATUS_FIELDS}
    before = items.withColumns({f"old_{c}": v for c, v in stored.items()})
    after = with_status(before)
    differs = F.lit(False)
    for c in STATUS_FIELDS:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return after.where(differs).select("item_id", *STATUS_FIELDS)


def uniqueness_problems(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def cleared(rows: DataFrame) -> DataFrame:
    """The same columns without rows."""
    return rows.limit(0)
