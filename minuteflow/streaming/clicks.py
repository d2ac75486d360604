"""Click feedback as a stream: the same counts as the batch operator, in event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteflow.functions.text import normalize_feedback_query


def click_counts(clicks: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, meeting_id, query, clicks) of a click stream (created_at, meeting_id, query); late rows beyond the watermark are left out.

    With a click_id, a click that is delivered again within the watermark counts once; clicks without one count each.
    """
    timely = clicks.withWatermark("created_at", late)
    if "click_id" in clicks.columns:
        # Clicks without an id get one of their own, so that they aren't taken for each other.
        timely = timely.withColumn("_id", F.coalesce(F.col("click_id").cast("string"), F.expr("uuid()"))).dropDuplicatesWithinWatermark(["_id"])
    return (
        timely.groupBy(F.window("created_at", window), "meeting_id", normalize_feedback_query(F.col("query")).alias("query"))
        .agg(F.count("*").alias("clicks"))
    )


def write_counts(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in append mode: each batch's counts have a folder of their own, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "meeting_id", "query", "clicks").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, meeting_id, query, clicks) over all batches written."""
    return spark.read.parquet(path).groupBy("start", "end", "meeting_id", "query").agg(F.sum("clicks").alias("clicks"))
