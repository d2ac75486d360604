"""Related meetings and items: the target's words are one row that meets all others, instead of pairwise comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.text import strip, tokens

# Words without meaning for relatedness.
STOP_WORDS = ("meeting", "minutes", "record", "會議", "記錄", "項目", "內容")


def _keywords(c: str) -> F.Column:
    return F.array_except(tokens(F.col(c)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def _text(c: str) -> F.Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def _wanted(words_of: DataFrame, key: str, target: str) -> DataFrame:
    """One row (wanted): the distinct words of the target's rows (key, words)."""
    return words_of.where(F.col(key) == target).agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("wanted"))


def _shared(words_of: DataFrame, key: str, target: str, name: str) -> DataFrame:
    """(key, name): distinct words that the rows (key, words) of each key share with the target's.

    The target's words are one row and meet the others where they are: a word that all rows have is no join key.
    """
    common = words_of.where(F.col(key) != target).join(F.broadcast(_wanted(words_of, key, target)), F.lit(True), "inner")
    each = common.select(key, F.explode_outer(F.array_intersect("words", "wanted")).alias("word")).where("word is not null")
    return each.groupBy(key).agg(F.countDistinct("word").alias(name))


def related_meetings(meetings: DataFrame, items: DataFrame, meeting_id: str, limit: int = 10) -> DataFrame:
    """4 for the same unit, 2 a shared attendee, 3 a shared owner, 2 a shared keyword, each up to 6."""
    attendees = meetings.select("meeting_id", F.filter(F.coalesce("attendees", F.array().cast("array<string>")), lambda a: strip(a) != "").alias("words"))
    owners = items.where(_text("owner") != "").select("meeting_id", F.array(_text("owner")).alias("words"))
    words = meetings.select("meeting_id", _keywords("meeting_name").alias("words")).union(items.select("meeting_id", _keywords("content").alias("words")))
    unit = meetings.where(F.col("meeting_id") == meeting_id).agg(F.min("responsible_unit").alias("target_unit"))
    out = meetings.where(F.col("meeting_id") != meeting_id).join(F.broadcast(unit), F.lit(True), "inner")
    for words_of, name in ((attendees, "shared_attendees"), (owners, "shared_owners"), (words, "shared_keywords")):
        out = out.join(_shared(words_of, "meeting_id", meeting_id, name), "meeting_id", "left")
    same = (_text("responsible_unit") != "") & (F.col("responsible_unit") == F.col("target_unit"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("shared_attendees", "shared_owners", "shared_keywords")}
    score = F.when(same, 4).otherwise(0) + sum((F.least(w * F.col(c), F.lit(6)) for c, w in (("shared_attendees", 2), ("shared_owners", 3), ("shared_keywords", 2))), F.lit(0))
    reasons = F.array_compact(F.array(F.when(same, F.lit("same_unit")), *[F.when(F.col(c) > 0, F.lit(c)) for c in zero]))
    return (
        out.withColumns(zero)
        .withColumns({"score": score.cast("bigint"), "reasons": reasons})
        .where("score > 0")
        .select("meeting_id", "meeting_name", "meeting_date", "score", "shared_attendees", "shared_owners", "shared_keywords", "reasons")
        .orderBy(F.desc("score"), F.coalesce("meeting_date", F.lit("")), "meeting_id")
        .limit(limit)
    )


def related_items(meetings: DataFrame, items: DataFrame, item_id: str, limit: int = 10) -> DataFrame:
    """3 a shared keyword up to 6, 4 the same owner, 2 the same planned month, 2 any shared meeting keyword, 1 the same blankness of tracking."""
    wanted = _wanted(items.select("item_id", _keywords("content").alias("words")), "item_id", item_id)
    target = items.where(F.col("item_id") == item_id).select(
        F.col("meeting_id").alias("t_meeting"), _text("owner").alias("t_owner"), F.substring(F.coalesce("planned_date", F.lit("")), 1, 7).alias("t_month"), (_text("tracking_result") == "").alias("t_blank")
    )
    meeting_words = meetings.select("meeting_id", _keywords("meeting_name").alias("m_words"))
    target = target.join(meeting_words.withColumnRenamed("m_words", "t_words"), target.t_meeting == F.col("meeting_id"), "left").drop("meeting_id")
    target = target.limit(1).join(wanted, F.lit(True), "inner")
    out = items.where(F.col("item_id") != item_id).join(F.broadcast(target), F.lit(True), "inner").join(meeting_words, "meeting_id", "left")
    month = F.substring(F.coalesce("planned_date", F.lit("")), 1, 7)
    score = (
        F.least(3 * F.size(F.array_intersect(_keywords("content"), F.col("wanted"))), F.lit(6))
        + F.when((_text("owner") != "") & (_text("owner") == F.col("t_owner")), 4).otherwise(0)
        + F.when((month != "") & (month == F.col("t_month")), 2).otherwise(0)
        + F.when(F.coalesce(F.arrays_overlap("m_words", "t_words"), F.lit(False)), 2).otherwise(0)
        + F.when((_text("tracking_result") == "") == F.col("t_blank"), 1).otherwise(0)
    )
    return out.withColumn("score", score.cast("bigint")).where("score > 0").select("item_id", "meeting_id", "item_no", "content", "score").orderBy(F.desc("score"), "meeting_id", "item_no", "item_id").limit(limit)
