"""Golden cases: judging, seeding and merging."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from minuteflow.operators import evaluation
from minuteflow.operators.asking import INSUFFICIENT
from minuteflow.sources.files import CASES

CASE = CASES + ", expect_insufficient boolean, expected_answer_contains array<string>, expected_answer_not_contains array<string>"
ANSWER = "id string, number int, question string, answer string, sources array<struct<meeting_id:string,item_id:string>>, paths array<struct<meeting_id:string,item_id:string,matched_relation:string>>, is_insufficient boolean, errors array<string>"


def case(id, **more):
    own = {"id": id, "enabled": True, "question": "q"} | more
    return tuple(own.get(c.strip(" `").split()[0].strip("`")) for c in CASE.split(", "))


@pytest.fixture(scope="module")
def answers(spark):
    rows = [
        ("good", 1, "Who does it?", "Item I1 of M1", [("M1", "I1")], [("M1", "I1", "HAS_ITEM")], None, None),
        ("refused", 2, "", INSUFFICIENT, None, None, True, None),
        ("bad", 3, "Ünder a-b  2", "Item I9", [(None, "I9"), ("M9", "")], [("M9", "I9", None)], False, ["sources differ"]),
    ]
    return spark.createDataFrame(rows, ANSWER)


def test_judged(spark, answers):
    cases = spark.createDataFrame(
        [
            case("good", expected_item_ids=["I1", ""], expected_meeting_ids=["M1"], expected_relations=["HAS_ITEM"], expected_answer_contains=["item i1"], expected_answer_not_contains=["i2"], unexpected_item_ids=["I2"]),
            case("refused", expect_insufficient=True),
            case("bad", expected_item_ids=["I1"], unexpected_item_ids=["i9", "I9"], expected_meeting_ids=["M1", "M9"], expected_relations=["HAS_ITEM"], expected_answer_contains=["x"], expected_answer_not_contains=["ITEM"], expect_insufficient=True),
            case("lost"),
            case("off", enabled=False, expected_item_ids=["I1"]),
        ],
        CASE,
    )
    results = evaluation.judged(cases, answers)
    got = {r["id"]: (r["status"], r["failures"]) for r in results.collect()}
    assert got["good"] == got["refused"] == ("passed", []) and got["off"] == ("skipped", []) and got["lost"] == ("failed", ["no answer"])
    assert got["bad"] == (
        "failed",
        [
            "expected insufficient-context response", "answer missing expected item_id: I1", "sources missing expected item_id: I1", "graph missing expected item_id: I1", "unexpected item_id present: i9", "unexpected item_id present: I9", "answer missing expected meeting_id: M1",
            "evidence missing expected meeting_id: M1", "answer missing expected meeting_id: M9", "graph missing expected relation: HAS_ITEM", "answer missing expected text: x", "answer contains forbidden text: ITEM", "sources differ",
        ],
    )
    assert evaluation.summary(results).first().asDict() == {"total": 5, "enabled": 4, "passed": 2, "failed": 2, "skipped": 1}
    loose = evaluation.judged(spark.createDataFrame([case("bad", require_consistency=False), case("refused")], CASE), answers)
    assert {r["id"]: r["failures"] for r in loose.collect()} == {"bad": [], "refused": ["unexpected insufficient-context response"]}


def test_seeded_cases_pass_once_approved(answers):
    cases = evaluation.seeded(answers.where("id = 'good'"))
    row = cases.first()
    assert (row["id"], row["expected_item_ids"], row["expected_meeting_ids"], row["expected_relations"], row["enabled"], row["review_status"]) == ("seed_001_who_does_it", ["I1"], ["M1"], ["HAS_ITEM"], False, "needs_review")
    done = evaluation.approved(cases.withColumn("review_status", F.lit(" Approved ")))
    result = evaluation.judged(done, answers.where("id = 'good'").withColumn("id", F.lit("seed_001_who_does_it")))
    assert result.first()["status"] == "passed"
    assert [r["expect_insufficient"] for r in evaluation.seeded(answers).orderBy("id").collect()] == [None, True, None]


def test_merging_is_idempotent(spark):
    stored = spark.createDataFrame([case("a", expected_item_ids=["old"]), case("b", expected_item_ids=["kept"])], CASE)
    new = spark.createDataFrame(
        [case("a", expected_item_ids=["new", ""]), case("c", enabled=None, review_status="approved", expected_relations=["R"]), case("d", enabled=False, expected_item_ids=["x"]), case("e"), case(" ", question="Who?", expect_insufficient=True), case("c", expected_relations=["R"])], CASE
    )
    whole, counts = evaluation.merged(stored, new)
    assert {r["id"]: r["expected_item_ids"] for r in whole.collect()} == {"a": ["new"], "b": ["kept"], "c": [], "seed_001_who": []}
    assert counts.first().asDict() == {"saved": 3, "created": 2, "updated": 1, "skipped": 3}
    again, counts = evaluation.merged(whole, new)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, whole.collect())) and counts.first()["created"] == 0
