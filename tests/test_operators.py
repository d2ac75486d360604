"""Unit vectors of the column helpers and operators that SQL can't express."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from minuteflow.functions import extract, routing, status, text
from minuteflow.operators import answers, asking, evidence, graph_build, graph_query, listing, maintenance, parse, privacy, recommend, vectors
from minuteflow.schemas import PAGES
from minuteflow.sources import files


def value(spark, expression, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return frame.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("date", "tracking", "expected"),
    [
        ("2018-04-21", None, ("completed", "actual_completed_date", "high")),
        ("- -", "不 適 用", ("not_applicable", "tracking_result", "high")),
        ("--", "Final report", ("not_applicable", "tracking_result", "high")),
        (None, "確認 已 完成", ("completed", "tracking_result", "high")),
        (None, "in  progress", ("in_progress", "tracking_result", "medium")),
        (None, None, ("pending", "", "low")),
    ],
)
def test_status(spark, date, tracking, expected):
    assert tuple(value(spark, status.classify_status(F.col("d"), F.col("t")), d=date, t=tracking)) == expected


@pytest.mark.parametrize(("cell", "query", "hit"), [("TFDA label", "FDA", False), ("the FDA label", "fda", True), ("確認FDA標籤", "FDA", True), ("標籤審查", "審查", True), ("review UPD notes", "UPD 會議", True), (None, "x", False), ("x", " ", False)])
def test_matches_query(spark, cell, query, hit):
    assert value(spark, text.matches_query(F.col("c"), query), c=cell) is hit


def test_uuid5(spark):
    assert value(spark, text.uuid5_url(F.col("c")), c="item_001") == str(uuid.uuid5(uuid.NAMESPACE_URL, "item_001"))


@pytest.mark.parametrize(("left", "right", "same"), [("red ring", "Red  RING", True), ("ring", "red ring check", True), ("a b", "a c", True), ("a b c", "a d e", False), ("", "x", False)])
def test_similar_queries(spark, left, right, same):
    assert value(spark, text.similar_queries(F.col("l"), F.col("r")), l=left, r=right) is same


def test_keywords(spark):
    rows = spark.createDataFrame([("i1", "UPD checks FDA label for the Conformity stem 標籤審查")], "item_id string, content string")
    found = {r["name"]: (r["type"], r["score"]) for r in extract.with_keywords(rows, "item_id", "content").collect()}
    assert found["FDA"] == ("regulation", 0.74)
    assert found["UPD"] == ("abbreviation", 0.74)
    assert found["Conformity stem"] == ("product", 0.76)
    assert found["標籤審查"] == ("chinese_term", 0.38)


def test_keywords_of_long_runs_and_odd_phrases(spark):
    rows = spark.createDataFrame([("i1", "甲乙丙丁戊己庚辛壬癸子丑寅卯"), ("i2", "a b/c red-ring X stem, cup"), ("i3", None), ("i4", "CE stem CE stem")], "item_id string, content string")
    found = {}
    for r in extract.with_keywords(rows, "item_id", "content", limit=99).collect():
        found.setdefault(r["item_id"], {})[r["name"]] = r["method"]
    run = {"甲乙丙丁戊己庚辛壬癸子丑"[i : i + n] for n in (2, 3, 4) for i in range(13 - n)} | {"寅卯"}
    assert set(found["i1"]) == run and "i3" not in found
    assert found["i2"] == {"red-ring X stem": "regex_product_phrase", "X stem": "regex_product_phrase"}
    assert found["i4"]["CE stem"] == "regex_product_phrase" and found["i4"]["CE"] == "regex_abbreviation"
    lists = {r["item_id"]: (r["products"], r["regulations"]) for r in extract.keyword_lists(extract.with_keywords(rows, "item_id", "content", limit=99), "item_id").collect()}
    assert lists["i4"] == (["CE stem", "stem CE stem", "CE stem CE stem"], ["CE"]) and lists["i1"] == ([], [])


def test_keywords_merge_within_their_row(spark):
    """A text has some seventy candidates: none of them is shuffled, sorted or aggregated over rows."""
    rows = spark.createDataFrame([("i1", "FDA Stem and fda stem, stem cup 標籤審查標籤"), ("i2", "標籤審查")], "item_id string, content string")
    found = extract.with_keywords(rows, "item_id", "content", limit=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Exchange", "Window", "Sort", "Aggregate"))
    assert [(r["name"], r["method"]) for r in found.where("item_id = 'i1'").collect()] == [("and fda stem", "regex_product_phrase"), ("FDA Stem", "regex_product_phrase"), ("stem cup", "regex_product_phrase"), ("FDA", "regex_abbreviation"), ("FDA Stem and fda stem", "regex_phrase")]
    assert sorted(r["name"] for r in found.where("item_id = 'i2'").collect()) == sorted(["審查", "標籤", "標籤審", "標籤審查", "籤審"])


@pytest.mark.parametrize(
    ("question", "kind", "intent"),
    [
        ("UR3 負責哪些會議", "relation_lookup", "unit_meetings"),
        ("FDA 未完成項目", "composite_query", "regulation_related"),
        ("2018年4月 完成日期 項目", "composite_query", "completed_date"),
        ("issue tracking for the cage", "follow_up_tracking", "product_related"),
        ("list the meeting agenda", "structural_list", "keyword_related"),
        ("hello", "open_qa", "keyword_related"),
        (None, "open_qa", "keyword_related"),
    ],
)
def test_route(spark, question, kind, intent):
    row = routing.route(spark.createDataFrame([(question,)], "question string")).first()
    assert (row["query_type"], row["graph_intent"]) == (kind, intent)
    assert row["default_limit"] == routing.ROUTES[kind][3]


def test_cosine_and_upsert(spark):
    frame = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0]), ("d", [0.0, 0.0])], "id string, vector array<double>")
    assert [(r["id"], round(r["score"], 6)) for r in vectors.nearest(frame, [1.0, 0.0]).collect()] == [("a", 1.0)]
    assert vectors.wrong_dimension(frame, 2).count() == 1
    assert vectors.upsert(frame, frame.where("id = 'a'")).count() == 4


def test_pseudonym_and_patterns(spark):
    import hashlib

    expected = "Person_" + hashlib.sha256(b"s\0person\0Alice").hexdigest()[:10].upper()
    assert value(spark, privacy.pseudonym("person", F.col("c"), "s"), c=" Alice ") == expected
    assert value(spark, privacy.pseudonym("person", F.col("c"), "s"), c="--") == "--"
    assert value(spark, privacy.scrub_patterns(F.col("c")), c="A123456789 on 2018-04-03, a@b.co, 0912-345-678") == "identifier on 2018-04-03, email, phone"


def test_claims_and_rendering(spark):
    found = spark.createDataFrame([("m", "i1", "check", "RESPONSIBLE_BY", "Ann", 4.0, "graph", 0), ("m", "i2", "test", None, None, 5.0, "structured", 1)], "meeting_id string, item_id string, content string, matched_relation string, matched_entity string, graph_score double, evidence_source string, source_rank int")
    numbered = evidence.records(found)
    claims = spark.createDataFrame([("one", ["evidence_001", "nope"]), ("none", ["x"])], "claim string, evidence_ids array<string>")
    complete = evidence.complete_claims(claims, numbered, "relation_lookup")
    assert sorted((r["claim"], r["evidence_ids"]) for r in complete.collect()) == [("one", ["evidence_001"]), ("test", ["evidence_002"])]
    assert evidence.render_answer(complete, numbered).first()["answer"] == "1. one (m / i1)\n2. test (m / i2)"


def test_golden_cases(spark):
    cases = spark.createDataFrame([("a", True, ["1"], ["9"]), ("b", True, ["2"], None), ("c", False, None, None)], "id string, enabled boolean, expected_item_ids array<string>, unexpected_item_ids array<string>")
    answers = spark.createDataFrame([("a", ["1", "3"])], "id string, item_ids array<string>")
    assert evidence.summarize(evidence.evaluate(cases, answers)).first().asDict() == {"total": 3, "passed": 1, "failed": 1, "skipped": 1}


def payload(document_id, tables=(), words=(), raw=""):
    page = {"page_number": 1, "text": raw, "words": [dict(zip(("x0", "y0", "x1", "y1", "text"), w)) for w in words], "tables": [{"bbox": [], "rows": list(t)} for t in tables], "width": 600.0, "height": 800.0}
    return {"document_id": document_id, "page_count": 1, "word_count": len(words), "raw_text": raw, "pages": [page]}


RAW = "會議記錄單 時間: 2018年4月3日 9時30分~10時5分 地點: Room 主席: Alice 記錄: Bob 會議名稱: FDA 審 查 權責單位: UR3 出席人員: Carol、王 明 項次"


def test_parse(spark):
    words = [(40, 60, 0, 70, "項 次"), (380, 60, 0, 72, "負責人"), (40, 100, 0, 0, "1."), (90, 100, 0, 0, "Check"), (130, 100, 0, 0, "label"), (380, 100, 0, 0, "Ann"), (40, 150, 0, 0, "2."), (90, 151, 0, 0, "Test"), (431, 150, 0, 0, "4/20")]
    frame = spark.createDataFrame([payload("d1", tables=[[["1", "Check label", "Carol", "４/20", "--", "pending"], ["x", "head", "", "", "", ""]]], raw=RAW), payload("d2", words=[(float(a), float(b), 0.0, float(d), t) for a, b, _, d, t in words], raw=RAW), payload("d3")], PAGES)
    meetings = parse.meetings(frame)
    one = meetings.where("document_id = 'd1'").first()
    assert (one["meeting_date"], one["start_time"], one["end_time"], one["meeting_name"], one["attendees"], one["status"]) == ("2018-04-03", "09:30", "10:05", "FDA 審查", ["Carol", "王明"], "needs_ocr")
    items = {(r["document_id"], r["item_no"]): r for r in parse.items(frame, meetings).collect()}
    assert set(items) == {("d1", "01"), ("d2", "01"), ("d2", "02")}
    assert (items["d1", "01"]["planned_date"], items["d1", "01"]["status"]) == ("2018-04-20", "in_progress")
    assert (items["d2", "01"]["content"], items["d2", "01"]["owner"], items["d2", "02"]["planned_date"]) == ("Check label", "Ann", "2018-04-20")


def test_click_stream_equals_batch(spark, tmp_path):
    from minuteflow.streaming.clicks import click_counts

    rows = spark.sql("select timestamp'2024-01-01 10:00:00' as created_at, 'm' as meeting_id, 'Red  ring' as query union all select timestamp'2024-01-01 11:00:00', 'm', 'red ring'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = click_counts(stream).writeStream.outputMode("complete").format("memory").queryName("clicks_out").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["query"], r["clicks"]) for r in spark.sql("select * from clicks_out").collect()] == [("red ring", 2)]


def test_questions_that_are_or_begin_with_a_name(spark):
    asked = ["王小明", "王小明 FDA 未完成", "Alice Wang", "FDA"]
    got = {r["question"]: r for r in routing.route(spark.createDataFrame([(q,) for q in asked], "question string")).collect()}
    assert [got[q]["person_name"] for q in asked] == ["王小明", "王小明", "Alice Wang", ""]
    assert got["王小明"]["graph_intent"] == "person_responsibility"


def test_keyword_types(spark):
    names = spark.createDataFrame([("髖臼 stem",), ("Conformity stem",), ("髖臼 plan",), ("FDA",)], "name string")
    assert [r[0] for r in names.select(extract.keyword_type(F.col("name"))).collect()] == ["product", "product", "mixed_term", "regulation"]


def test_claims_keep_known_evidence(spark):
    evidence_ = spark.createDataFrame([("e1", "m", "i1", "one", None, None), ("e2", "m", "i2", "two", None, None)], "evidence_id string, meeting_id string, item_id string, content string, matched_relation string, matched_entity string")
    claims = spark.createDataFrame([("a", ["e2", "e1", "e2", "x"]), ("b", ["x"]), (" ", ["e1"])], "claim string, evidence_ids array<string>")
    assert [(r["claim"], r["evidence_ids"]) for r in evidence.complete_claims(claims, evidence_, "open_qa").collect()] == [("a", ["e2", "e1"])]


def test_mapping_keeps_the_new_and_sorts(spark, tmp_path):
    stored = spark.createDataFrame([("p", "b", "1"), ("p", "a", "2")], "kind string, original string, anonymized string")
    new = spark.createDataFrame([("p", "a", "4"), ("p", "a", "3")], "kind string, original string, anonymized string")
    assert [tuple(r) for r in files.merge_mapping(stored, new).collect()] == [("p", "a", "3"), ("p", "b", "1")]


def test_questions_and_modes():
    assert graph_query.retrieval_modes(None) == graph_query.MODES and graph_query.retrieval_modes(["Follow_Up", "x", "keyword", "keyword"]) == ("follow_up", "keyword")
    assert graph_query.meeting_terms("which items has the FDA label meeting?") == ["HAS", "THE", "FDA", "LABEL"]
    assert graph_query.follow_up_keyword("follow up of ISO 13485 items") == "ISO 13485" and graph_query.follow_up_keyword("標籤 後續追蹤") == "標籤"
    assert answers.question_terms("列出這場 label 會議的項目") == ["label"]


def test_stored_values_are_replaced_everywhere(spark):
    names = ["王小明", "王小明二", "Customer#01", "Customer#011", "Li", "QA unit", "Room 1", "report_v1.pdf"]
    kinds = ["person", "person", "person", "person", "person", "unit", "location", "file"]
    texts = ["王小明二 and 王小明 met Customer#011, Customer#01 and Li in Room 1", "QA unitQA unit report_v1.pdf", "", None, "no one", "Lili Li" * 3, "x" * 5000 + "Customer#011"]
    rows = spark.createDataFrame([(str(i), t, names[i % 4], "n/a") for i, t in enumerate(texts)], "meeting_id string, raw_text string, chairperson string, recorder string")
    values = spark.createDataFrame(list(zip(kinds, names)), "kind string, original string")
    done = {r["meeting_id"]: r for r in privacy.deidentify_stored(rows, values, "meeting_id", "salt").collect()}
    for i, t in enumerate(texts):
        expected = t
        for kind, name in sorted(zip(kinds, names), key=lambda kv: -len(kv[1])):
            expected = expected and expected.replace(name, privacy.STORED_NOUNS[kind])
        assert done[str(i)]["raw_text"] == expected
        assert done[str(i)]["chairperson"].startswith("Person_")
        assert done[str(i)]["recorder"] == "n/a"
    empty = privacy.deidentify_stored(rows, values.where("false"), "meeting_id", "salt")
    assert empty.where("raw_text <=> 'no one'").count() == 1


def test_stored_values_of_tables(spark):
    rows = spark.createDataFrame([("m", "王小明", "--", ["李四", " ", None], "a.pdf")], "meeting_id string, chairperson string, recorder string, attendees array<string>, original_filename string")
    found = {tuple(r) for r in privacy.stored_values(rows, rows.select("meeting_id"), rows.select("meeting_id", F.lit("QA").alias("unit_name"))).collect()}
    assert found == {("person", "王小明"), ("person", "李四"), ("file", "a.pdf"), ("unit", "QA")}


def test_payloads(spark):
    points = spark.createDataFrame([("p", {"item_id": "王小明", "owner": "王小明", "content": "王小明 at a@b.org", "original_filename": "x.pdf", "name": None}), ("q", {}), ("r", None)], "id string, payload map<string,string>")
    values = spark.createDataFrame([("person", "王小明")], "kind string, original string")
    done = {r["id"]: r["payload"] for r in privacy.deidentify_properties(points, values, ["id"], "salt", "payload").collect()}
    assert done["p"]["item_id"] == "王小明"
    assert done["p"]["content"] == "人員 at 電子郵件"
    assert done["p"]["owner"].startswith("Person_")
    assert done["p"]["original_filename"].startswith("File_") and done["p"]["original_filename"].endswith(".pdf")
    assert done["p"]["name"] is None and done["q"] == {} and done["r"] == {}


def test_few_pieces_of_texts_are_shuffled(spark):
    """Of some forty pieces of a text only those go on that a value is filed under; one that stands in all texts is dealt over many keys."""
    rows = spark.range(300).select(F.col("id").cast("string").alias("k"), F.format_string("a long text about nothing: Guest#3 met Customer#%06d", "id").alias("t"))
    values = spark.range(0, 300, 2).select(F.lit("person").alias("kind"), F.format_string("Customer#%06d", "id").alias("original")).union(spark.createDataFrame([("person", "Guest#3")]))
    found = privacy.candidates_in(rows, ["k"], ["t"], values)
    assert found.count() < 3 * 300
    assert found.where("original = 'Guest#3'").select("k").distinct().count() == 300
    assert found.where("original like 'Customer%' and cast(right(original, 6) as int) = cast(k as int)").distinct().count() == 150
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan[plan.index("SortMergeJoin") if "SortMergeJoin" in plan else 0 :]
    nodes = rows.select(F.lit("Meeting").alias("type"), F.col("k").alias("id"), F.create_map(F.lit("content"), "t", F.lit("status"), "t").alias("properties"))
    done = {r["id"]: r["properties"] for r in privacy.deidentify_properties(nodes, values, ["type", "id"], "s").collect()}
    assert done["4"] == {"content": "a long text about nothing: 人員 met 人員", "status": "a long text about nothing: Guest#3 met Customer#000004"}
    assert done["5"]["content"] == "a long text about nothing: 人員 met Customer#000005"


def test_node_properties_of_repeated_rows(spark):
    rows = spark.createDataFrame([("a", "2", None), ("a", "1", "z"), (" ", "3", None), (None, "4", None)], "k string, x string, y string")
    assert [r.asDict() for r in graph_build.nodes_of(rows, "T", "k", "y", "x").collect()] == [{"type": "T", "id": "a", "properties": {"x": "1", "y": "z"}}]


@pytest.mark.parametrize(("tags", "expected"), [(None, []), ("", []), (" a, ,b ,", ["a", "b"])])
def test_tags(spark, tags, expected):
    assert value(spark, listing.normalize_tags(F.col("t")), t=tags) == expected


@pytest.mark.parametrize(
    ("question", "terms"),
    [
        ("1-URGENT machinery review 會議有哪些會議項目", ["URGENT machinery review"]),
        ("Conformity stem 相關 FDA 標籤審查？", ["Conformity stem FDA", "標籤審查"]),
        ("會議項目有哪些", []),
    ],
)
def test_keyword_terms(question, terms):
    assert asking.keyword_terms(question, {}) == terms


def test_blank_question(spark):
    empty = spark.createDataFrame([], "meeting_id string")
    with pytest.raises(ValueError):
        asking.ask("  ", empty, empty, empty, empty, empty)


def test_broken_patterns_fail_on_the_driver(spark):
    documents = spark.createDataFrame([("d", "A(b.pdf", "minutes", "parsed", 1, False)], "document_id string, original_filename string, doc_type string, status string, page_count int, is_deleted boolean").withColumn("created_at", F.lit(None).cast("timestamp"))
    meetings = spark.createDataFrame([("m", "Red", ["Ann"], "2001-01-01", "u")], "meeting_id string, meeting_name string, attendees array<string>, meeting_date string, responsible_unit string")
    with pytest.raises(ValueError, match="no pattern"):
        listing.list_documents(documents, keyword="A(b")
    with pytest.raises(ValueError, match="no pattern"):
        listing.list_meetings(meetings, keyword="[")
    with pytest.raises(ValueError, match="no pattern"):
        listing.list_meetings(meetings, name="*")
    assert listing.list_documents(documents, keyword=r"a\(b").count() == 1


def test_white_space_is_trimmed_and_dropped_as_by_patterns(spark):
    rows = spark.range(1, 0xD800).select(F.char(F.col("id") % 256).alias("_"), F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), "UTF-8"), "UTF-8").alias("c"))
    padded = rows.select("c", F.concat("c", F.lit("x y"), "c").alias("v"))
    wrong = padded.where((text.strip(F.col("v")) != F.regexp_replace("v", r"(?U)^\s+|\s+$", "")) | (text.normalize_placeholder(F.col("v")) != F.regexp_replace(F.translate(F.lower("v"), text.DASHES, "---"), r"(?U)\s+", "")))
    assert wrong.collect() == []
    assert padded.where(text.strip(F.col("v")) == "x y").count() == len(text.WHITE_SPACE)


def test_a_status_is_worked_out_once(spark):
    stored = spark.createDataFrame([("1", None, "Closed", "pending", "", "low", "--")], "item_id string, actual_completed_date string, tracking_result string, status string, status_source string, status_confidence string, planned_date string")
    repaired = maintenance.repair_statuses(stored)
    assert repaired._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4
    assert [(r.status, r.planned_date) for r in repaired.collect()] == [("completed", None)]


def test_words_of_all_rows_are_no_join_key(spark):
    meetings = spark.createDataFrame([(str(k), f"review {k % 3}", "2001-01-01", "u", ["A", " ", None]) for k in range(6)] + [("9", None, None, None, None)], "meeting_id string, meeting_name string, meeting_date string, responsible_unit string, attendees array<string>")
    items = spark.createDataFrame([(f"{k}-{n}", str(k), "01", f"check the {k % 2} pump", "O", None, "2001-02-01") for k in range(6) for n in range(2)], "item_id string, meeting_id string, item_no string, content string, owner string, tracking_result string, planned_date string")
    for found in (recommend.related_meetings(meetings, items, "0"), recommend.related_items(meetings, items, "0-0")):
        assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.meeting_id: (r.score, r.shared_attendees, r.shared_owners, r.shared_keywords) for r in recommend.related_meetings(meetings, items, "0").collect()}
    assert got == {"1": (15, 1, 1, 4), "2": (15, 1, 1, 5), "3": (15, 1, 1, 5), "4": (15, 1, 1, 5), "5": (15, 1, 1, 4)}
    assert {r.item_id: r.score for r in recommend.related_items(meetings, items, "0-0", 20).collect()} == {f"{k}-{n}": 15 for k in range(6) for n in range(2) if (k, n) != (0, 0)}


def test_composite_search_has_all_rows(spark):
    from minuteflow.plans import queries

    assert "Limit" not in queries.composite_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_never_broadcast(spark, monkeypatch):
    """Nothing but the bitmap goes to all tasks: neither the values' pieces nor their rows for each salt, which Spark takes for no larger than the values' file."""
    plans, write = [], privacy.materialize
    monkeypatch.setattr(privacy, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    values = spark.createDataFrame([("person", f"Customer#{k:05d}") for k in range(50)], "kind string, original string")
    rows = spark.createDataFrame([(k, f"of Customer#{k:05d}") for k in range(0, 100, 3)], "k int, t string")
    found = privacy.candidates_in(rows, ["k"], ["t"], values)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert [p.count("BroadcastExchange") for p in plans] == [0, 0, 1]
    assert {(r["k"], r["original"]) for r in found.collect()} >= {(k, f"Customer#{k:05d}") for k in range(0, 50, 3)}
