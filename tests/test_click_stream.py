"""Click counts as a stream with redelivered and late clicks, against the batch."""

from __future__ import annotations

from datetime import datetime

from minuteflow.streaming.clicks import click_counts, stored_counts, write_counts

SCHEMA = "click_id string, created_at timestamp, meeting_id string, query string"


def at(day, hour, minute=0):
    return datetime(2024, 1, day, hour, minute)


BATCHES = [
    [("c1", at(1, 10), "m", "Red  ring"), ("c2", at(1, 11), "m", "red ring"), ("c1", at(1, 10), "m", "Red  ring"), (None, at(1, 11), "m", "red ring"), (None, at(1, 11), "m", "red ring")],
    # Delivered again in another batch, and a click half an hour late.
    [("c2", at(1, 11), "m", "red ring"), ("c3", at(1, 10, 45), "n", "bolt")],
    [("c4", at(2, 9), "m", "red ring")],
    # A day too late.
    [("c5", at(1, 9), "n", "bolt"), ("c4", at(2, 9), "m", "red ring")],
    [("c6", at(4, 9), "m", "bolt")],
    [("c7", at(6, 9), "m", "bolt")],
]
EXPECTED = [(1, "m", "red ring", 4), (1, "n", "bolt", 1), (2, "m", "red ring", 1), (4, "m", "bolt", 1)]


def test_redelivered_and_late_clicks(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = click_counts(stream).writeStream.outputMode("append").foreachBatch(write_counts(out)).option("checkpointLocation", state).start()
        query.processAllAvailable()
        query.stop()

    # A stream that is stopped and started again between the deliveries.
    for rows in BATCHES:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    got = sorted((r["start"].day, r["meeting_id"], r["query"], r["clicks"]) for r in stored_counts(spark, out).collect())
    assert got == EXPECTED


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = click_counts(spark.createDataFrame(BATCHES[2], SCHEMA).drop("click_id"))
    write = write_counts(out)
    for batch in (0, 1, 1):
        write(rows, batch)
    assert [r["clicks"] for r in stored_counts(spark, out).collect()] == [2]
