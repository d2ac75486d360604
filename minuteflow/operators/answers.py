"""Context, evidence paths and rendering for grounded answers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minuteflow.functions.text import matches_query, normalize_match
from minuteflow.operators.graph_query import NO_NAME, OF_MEETINGS, SEPARATORS

# Words of a question that name no meeting, node types and relations of evidence paths, and the summary's phrases.
QUESTION_CUES = (*NO_NAME, "這場", "該場")
ENTITY_TYPES = {
    "RESPONSIBLE_BY": "Person", "ATTENDED_BY": "Person", "CHAIRED_BY": "Person", "RECORDED_BY": "Person", "BELONGS_TO_UNIT": "Unit", "HAS_PLANNED_DATE": "Date", "HAS_COMPLETED_DATE": "Date",
    "MENTIONS_PRODUCT": "Product", "MENTIONS_REGULATION": "Regulation", "HAS_ACTION": "ActionItem", "HAS_DECISION": "Decision", "HAS_RISK": "Risk", "TRACKS_ISSUE": "Issue", "ASSIGNED_TO": "Person",
    "TARGETS_PRODUCT": "Product", "CONSTRAINED_BY": "Regulation",
}
COMPLETE_TYPES = ("structural_list", "relation_lookup", "composite_query", "follow_up_tracking")
COMPLETE_RELATIONS = ("HAS_ITEM", "RESPONSIBLE_BY", "ATTENDED_BY", "CHAIRED_BY", "RECORDED_BY", "BELONGS_TO_UNIT", "HAS_PLANNED_DATE", "HAS_COMPLETED_DATE", "TRACKS_ISSUE", "FOLLOW_UP_OF")
NO_SUMMARY, BY_RECORDS, BY_MEETINGS, POINTS, FURTHER = "無法由現有會議記錄整理摘要。", "根據會議記錄，", ("根據 ", " 的會議記錄，"), "重點可整理為：", ("；另有 ", " 項相關紀錄可作為補充")
PREVIEW, SUMMARY_CLAIMS, SUMMARY_MEETINGS = 6, 5, 3
CONTEXT_FIELDS = ("meeting_name", "responsible_unit", "attendees", "content", "owner", "planned_date", "actual_completed_date", "tracking_result")


def question_terms(question: str) -> list[str]:
    """At most 8 words of a question that may name a meeting."""
    for cue in QUESTION_CUES:
        question = re.sub(re.escape(cue), " ", question, flags=re.I)
    return [t.strip() for t in re.split(SEPARATORS, question) if len(t.strip()) >= 2][:8]


def meetings_of_question(meetings: DataFrame, question: str, hint: str = "") -> DataFrame:
    """meetings with match_score, those near the best: 100 for an id or name in the question, 10 and its length for each term in a field."""
    asked = " ".join(v.strip() for v in (question, hint) if v.strip())
    squashed = re.sub(r"\s+", "", asked).upper()
    fields = [normalize_match(F.coalesce(c, F.lit(""))) for c in ("meeting_id", "meeting_name", "document_id")]
    score = reduce(lambda a, f: a + F.when((f != "") & F.lit(squashed).contains(f), 100).otherwise(0), fields[:2], F.lit(0))
    for term in (re.sub(r"\s+", "", t).upper() for t in question_terms(asked)):
        score = score + F.when(reduce(lambda a, f: a | f.contains(term), fields, F.lit(False)), 10 + min(len(term), 10)).otherwise(0)
    scored = meetings.withColumn("match_score", score).where("match_score > 0")
    # One row: the largest score, by partial maxima.
    best = scored.agg(F.max("match_score").alias("best"))
    return scored.join(F.broadcast(best), F.col("match_score") >= F.greatest(0.75 * F.col("best"), F.col("best") - 10)).drop("best")


def item_order() -> list[Column]:
    """Items by meeting, the number in their item number, item number and id."""
    number = F.regexp_extract(F.coalesce("item_no", F.lit("")), r"\d+", 0)
    return [F.coalesce("meeting_id", F.lit("")), F.when(number == "", 9999).otherwise(number.cast("bigint")), F.coalesce("item_no", F.lit("")), F.coalesce("item_id", F.lit(""))]


def with_meeting(items: DataFrame, meetings: DataFrame) -> DataFrame:
    return items.join(meetings.select("meeting_id", "meeting_name", "meeting_date", "responsible_unit", "attendees"), "meeting_id", "left")


def meeting_items_context(meetings: DataFrame, items: DataFrame, question: str, limit: int, hint: str = "") -> DataFrame:
    """The first items of the meetings that a question names."""
    named = meetings_of_question(meetings, question, hint).select("meeting_id")
    return with_meeting(items.join(named, "meeting_id", "left_semi").orderBy(*item_order()).limit(limit), meetings).orderBy(*item_order())


def keyword_context(meetings: DataFrame, items: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Items that hold any of the terms in a field of their own or their meeting's, in item order."""
    rows = with_meeting(items, meetings)
    texts = [F.array_join(c, " ") if c == "attendees" else F.col(c) for c in CONTEXT_FIELDS]
    hit = reduce(lambda a, b: a | b, (matches_query(t, term) for t in texts for term in terms), F.lit(False))
    return rows.where(hit).orderBy(*item_order()).limit(limit)


def ranked_items(graph: DataFrame, semantic: DataFrame) -> DataFrame:
    """(item_id, place): each item once, graph rows first, by score and id; graph (item_id, graph_score), semantic (item_id, score)."""
    both = graph.select("item_id", F.lit(0).alias("source"), F.col("graph_score").alias("score")).unionByName(semantic.select("item_id", F.lit(1).alias("source"), "score"))
    return both.where("item_id is not null").groupBy("item_id").agg(F.min(F.struct("source", (-F.col("score")).alias("less"), "item_id")).alias("place"))


def structured_context(ranked: DataFrame, items: DataFrame, meetings: DataFrame, limit: int) -> DataFrame:
    """The best ranked items with their meetings, in order; ids without an item are passed over."""
    return with_meeting(ranked.join(items, "item_id").orderBy("place").limit(limit), meetings).orderBy("place").drop("place")


def graph_path() -> Column:
    """How a graph result was found, as a path; columns meeting_id, item_id, matched_relation, matched_entity, matched_keyword, matched_field, evidence_source."""

    def known(c: str, name: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(f"unknown_{name}"))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    meeting, item, entity, relation = known("meeting_id", "meeting"), known("item_id", "item"), known("matched_entity", "entity"), F.col("matched_relation")
    has_item = text("Meeting(", meeting, ")-[:HAS_ITEM]->MeetingItem(", item, ")")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])[relation], F.lit("Entity"))
    mention = text("Keyword(", known("matched_keyword", "keyword"), ")-[:MENTIONS {field: ", known("matched_field", "field"), "}]-MeetingItem(", item, ")<-[:HAS_ITEM]-Meeting(", meeting, ")")
    return (
        F.when((F.coalesce(relation, F.lit("")) == "") | (relation == "MENTIONS"), mention)
        .when(relation == "HAS_ITEM", text("Meeting(", meeting, ")-[:HAS_ITEM {source: ", F.coalesce(F.nullif("evidence_source", F.lit("")), F.lit("neo4j")), "}]->MeetingItem(", item, ")"))
        .when(relation.isin(*OF_MEETINGS), text("Meeting(", meeting, ")-[:", relation, "]->Entity(", entity, "); ", has_item))
        .when(relation == "FOLLOW_UP_OF", text(has_item, "-[:FOLLOW_UP_OF]->MeetingItem(", entity, ")"))
        .otherwise(text(has_item, "-[:", relation, "]->", kind, "(", entity, ")"))
    )


def evidence_paths(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(meeting_id, item_id, path) of rows with evidence relations (item_id, source_type, source_value, relation, target_type, target_label), which follow the item."""
    step = F.concat("source_type", F.lit("("), "source_value", F.lit(")-[:"), "relation", F.lit("]->"), "target_type", F.lit("("), "target_label", F.lit(")"))
    steps = evidence.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set(step)), "; ").alias("steps"))
    own = F.concat(F.lit("Meeting("), F.coalesce("meeting_id", F.lit("unknown_meeting")), F.lit(")-[:HAS_ITEM]->MeetingItem("), F.coalesce("item_id", F.lit("unknown_item")), F.lit(")"))
    return rows.join(steps, "item_id").select("meeting_id", "item_id", F.concat(own, F.lit("; "), "steps").alias("path")).distinct()


def select_graph_evidence(results: DataFrame, limit: int = 10, query_type: str = "", complete: bool = False) -> DataFrame:
    """results with selection: all of them as complete evidence, or the few near the best score as a preview.

    Results are complete where they answer alone (complete), by the query type, or if all relations are
    complete ones and none came by keyword or composite search.
    """
    found = results.where("coalesce(meeting_id, '') <> '' or coalesce(item_id, '') <> ''")
    if complete or query_type in COMPLETE_TYPES:
        return found.withColumn("selection", F.lit("answer_evidence" if complete else "complete_evidence"))
    whole = F.coalesce(F.col("matched_relation").isin(*COMPLETE_RELATIONS), F.lit(False)) & ~F.coalesce(F.col("retrieval_mode").isin("keyword", "composite"), F.lit(False))
    # One row, by partial aggregates.
    facts = found.agg(F.max(F.coalesce("graph_score", F.lit(0.0))).alias("best"), F.bool_and(whole).alias("whole"))
    marked = found.join(F.broadcast(facts), F.lit(True))
    near = marked.where(F.col("whole") | (F.coalesce("graph_score", F.lit(0.0)) >= F.greatest(F.col("best") - 0.75, F.col("best") * 0.82)))
    all_of_them = near.where("whole").withColumn("selection", F.lit("complete_evidence"))
    preview = near.where("not whole").orderBy(F.desc("graph_score"), F.coalesce("meeting_date", F.lit("")), "item_id").limit(max(1, min(limit, PREVIEW))).withColumn("selection", F.lit("ranked_preview"))
    return all_of_them.unionByName(preview).drop("best", "whole")


def graph_context(results: DataFrame, limit: int = 10, query_type: str = "", complete: bool = False) -> DataFrame:
    """The selected evidence, once for each path."""
    chosen = select_graph_evidence(results, limit, query_type, complete)
    chosen = chosen if "evidence_source" in chosen.columns else chosen.withColumn("evidence_source", F.lit(None).cast("string"))
    return chosen.withColumn("path", graph_path()).dropDuplicates(["path"])


def summary_answer(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row (answer): the first claims in one sentence, after the names of the first meetings they cite.

    claims (claim_no, claim, evidence_ids), evidence (evidence_id, meeting_name). Only bounded heads are collected.
    """
    said = claims.withColumn("text", F.regexp_replace(F.trim(F.coalesce("claim", F.lit(""))), "。+$", "")).where("text <> ''")
    cited = claims.select("claim_no", F.posexplode("evidence_ids").alias("at", "evidence_id")).join(evidence.select("evidence_id", "meeting_name"), "evidence_id").where("coalesce(meeting_name, '') <> ''")
    names = cited.groupBy("meeting_name").agg(F.min(F.struct("claim_no", "at", "meeting_name")).alias("first")).orderBy("first").limit(SUMMARY_MEETINGS).agg(F.array_sort(F.collect_list("first")).alias("names"))
    heads = said.orderBy("claim_no").limit(SUMMARY_CLAIMS).agg(F.array_sort(F.collect_list(F.struct("claim_no", "text"))).alias("heads"))
    both = heads.join(F.broadcast(said.agg(F.count("*").alias("n"))), F.lit(True)).join(F.broadcast(names), F.lit(True))
    named = F.array_join(F.transform("names", lambda x: x["meeting_name"]), "、")
    intro = F.when(named == "", BY_RECORDS).otherwise(F.concat(F.lit(BY_MEETINGS[0]), named, F.lit(BY_MEETINGS[1])))
    body = F.array_join(F.transform("heads", lambda x: x["text"]), "；")
    more = F.when(F.col("n") > SUMMARY_CLAIMS, F.concat(F.lit(FURTHER[0]), (F.col("n") - SUMMARY_CLAIMS).cast("string"), F.lit(FURTHER[1]))).otherwise("")
    answer = F.when(F.col("n") == 0, NO_SUMMARY).when(F.col("n") == 1, F.concat(intro, body, F.lit("。"))).otherwise(F.concat(intro, F.lit(POINTS), body, more, F.lit("。")))
    return both.select(answer.alias("answer"))
