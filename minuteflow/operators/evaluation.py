"""Golden cases: judging all answers against their cases in one join, seeding cases from answers, merging approved ones.

cases (sources.files.CASES, and expect_insufficient, expected_answer_contains and
expected_answer_not_contains where they are given); answers (id, answer, sources
array<struct<meeting_id, item_id>>, paths array<struct<meeting_id, item_id, matched_relation>>,
is_insufficient, errors array<string> of the consistency check). Columns that are missing count as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.text import case_id, strip
from minuteflow.operators.asking import INSUFFICIENT

LISTS = ("expected_item_ids", "expected_meeting_ids", "expected_relations", "unexpected_item_ids", "expected_answer_contains", "expected_answer_not_contains")
#: Lists of which one must hold something, beside expect_insufficient, for a case to be kept.
EXPECTATIONS = ("expected_item_ids", "expected_meeting_ids", "expected_relations", "expected_answer_contains")
MERGED = ("id", "enabled", "question", "limit", *LISTS, "require_consistency", "expect_insufficient", "review_status")


def _completed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in rows.columns})


def _list(c: str) -> Column:
    return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _case_columns(cases: DataFrame) -> DataFrame:
    kinds = {"enabled": "boolean", "question": "string", "limit": "string", "require_consistency": "boolean", "expect_insufficient": "boolean", "review_status": "string"} | dict.fromkeys(LISTS, "array<string>")
    return _completed(cases, kinds).withColumns({c: _list(c) for c in LISTS})


def judged(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, status, failures): passed, failed or skipped, and what is missing or too much, in the order of the lists.

    A disabled case is skipped, one without an answer failed. Texts and ids are looked for in the
    answer without regard to case; a case wants consistency unless it says otherwise.
    """
    known = _completed(answers, {"is_insufficient": "boolean", "errors": "array<string>"}).withColumn("_answered", F.lit(True))
    rows = _case_columns(cases).join(known, "id", "left")
    answer = F.lower(F.coalesce("answer", F.lit("")))
    none = F.array().cast("array<string>")
    ids = lambda c, field: F.coalesce(F.transform(c, lambda s: s[field]), none)
    rows = rows.withColumns({"_text": answer, "_source_items": ids("sources", "item_id"), "_source_meetings": ids("sources", "meeting_id"), "_path_items": ids("paths", "item_id"), "_path_meetings": ids("paths", "meeting_id"), "_relations": ids("paths", "matched_relation")})
    said = lambda x: F.col("_text").contains(F.lower(x))
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))

    def each(c: str, *checks: tuple[str, Callable[[Column], Column]]) -> Column:
        """For each entry of a list, the messages of the checks that it fails."""
        one = lambda x: F.array_compact(F.array(*[F.when(fails(x), F.concat(F.lit(f"{message}: "), x)) for message, fails in checks]))
        return F.flatten(F.transform(c, one))

    refused = F.coalesce("is_insufficient", F.lit(False)) | F.coalesce(F.col("answer").contains(INSUFFICIENT), F.lit(False))
    wants = F.coalesce("expect_insufficient", F.lit(False))
    basis = F.when(wants & ~refused, F.array(F.lit("expected insufficient-context response"))).when(~wants & F.coalesce(F.col("answer").contains(INSUFFICIENT), F.lit(False)), F.array(F.lit("unexpected insufficient-context response"))).otherwise(none)
    failures = F.concat(
        basis,
        each("expected_item_ids", ("answer missing expected item_id", lambda x: ~said(x)), ("sources missing expected item_id", lambda x: ~has("_source_items", x)), ("graph missing expected item_id", lambda x: ~has("_path_items", x))),
        each("unexpected_item_ids", ("unexpected item_id present", lambda x: said(x) | has("_source_items", x) | has("_path_items", x))),
        each("expected_meeting_ids", ("answer missing expected meeting_id", lambda x: ~said(x)), ("evidence missing expected meeting_id", lambda x: ~has("_source_meetings", x) & ~has("_path_meetings", x))),
        each("expected_relations", ("graph missing expected relation", lambda x: ~has("_relations", x))),
        each("expected_answer_contains", ("answer missing expected text", lambda x: ~said(x))),
        each("expected_answer_not_contains", ("answer contains forbidden text", said)),
        F.when(F.coalesce("require_consistency", F.lit(True)), F.coalesce("errors", none)).otherwise(none),
    )
    skipped = ~F.coalesce("enabled", F.lit(True))
    failures = F.when(skipped, none).when(F.col("_answered").isNull(), F.array(F.lit("no answer"))).otherwise(failures)
    return rows.select("id", failures.alias("failures"), skipped.alias("_s")).select("id", F.when(F.col("_s"), "skipped").when(F.size("failures") > 0, "failed").otherwise("passed").alias("status"), "failures")


def summary(results: DataFrame) -> DataFrame:
    """One row: total, enabled, passed, failed, skipped."""
    counts = {c: F.count_if(F.col("status") == c).alias(c) for c in ("passed", "failed", "skipped")}
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "skipped").alias("enabled"), *counts.values())


def seeded(answers: DataFrame, enabled: bool = False) -> DataFrame:
    """Cases to be reviewed from answers (number, question, limit, answer, sources, paths, is_insufficient): what an answer cites is expected."""
    known = _completed(answers, {"is_insufficient": "boolean", "limit": "string"})
    names = lambda c, field: F.array_sort(F.filter(F.array_distinct(F.coalesce(F.transform(c, lambda s: s[field]), F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))
    return known.select(
        case_id(F.col("question"), F.col("number")).alias("id"), F.lit(enabled).alias("enabled"), "question", F.coalesce("limit", F.lit("auto")).alias("limit"), names("sources", "item_id").alias("expected_item_ids"), names("sources", "meeting_id").alias("expected_meeting_ids"),
        names("paths", "matched_relation").alias("expected_relations"), F.array().cast("array<string>").alias("unexpected_item_ids"), F.lit(True).alias("require_consistency"), F.lit("needs_review").alias("review_status"), F.nullif("is_insufficient", F.lit(False)).alias("expect_insufficient"),
    )


def approved(cases: DataFrame) -> DataFrame:
    """The cases that are enabled or approved and expect something, cleaned; of equal ids the smallest stays."""
    rows = _case_columns(cases)
    wanted = F.coalesce("enabled", F.lit(False)) | (F.lower(strip(F.coalesce("review_status", F.lit("")))) == "approved")
    expects = F.coalesce("expect_insufficient", F.lit(False))
    for c in EXPECTATIONS:
        expects = expects | (F.size(c) > 0)
    question = strip(F.coalesce("question", F.lit("")))
    text = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    clean = rows.where(wanted & expects).select(
        F.coalesce(text("id"), case_id(question, F.lit(1))).alias("id"), F.lit(True).alias("enabled"), question.alias("question"), F.coalesce(text("limit"), F.lit("auto")).alias("limit"), *LISTS,
        F.coalesce("require_consistency", F.lit(True)).alias("require_consistency"), F.nullif(F.coalesce("expect_insufficient", F.lit(False)), F.lit(False)).alias("expect_insufficient"), F.lit("approved").alias("review_status"),
    )
    return clean.groupBy("id").agg(F.min(F.struct(*[c for c in MERGED if c != "id"])).alias("c")).select("id", "c.*").select(*MERGED)


def merged(stored: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored cases with the approved ones of cases in place of theirs, and one row (saved, created, updated, skipped). Merging again changes nothing."""
    fresh = approved(cases)
    own = _case_columns(stored).select(*MERGED)
    whole = own.join(fresh.select("id"), "id", "left_anti").select(*MERGED).unionByName(fresh)
    known = fresh.join(own.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    counts = known.agg(F.count("*").alias("saved"), F.count_if(F.col("known").isNull()).alias("created"), F.count_if(F.col("known")).alias("updated"))
    return whole, counts.crossJoin(F.broadcast(cases.agg(F.count("*").alias("n")))).select("saved", "created", "updated", (F.col("n") - F.col("saved")).alias("skipped"))
