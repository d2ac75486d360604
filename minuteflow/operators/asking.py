"""A question from its route to an answer with evidence, in one call.

The question, its route and its answer are single rows; everything that is searched stays distributed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from minuteflow.functions.routing import effective_limit, route
from minuteflow.operators import answers, evidence
from minuteflow.operators.graph_query import search_graph
from minuteflow.operators.planning import Planner, as_dict, with_plan
from minuteflow.operators.vectors import malformed_token
from minuteflow.session import materialize

# The answer without evidence, words that are no keywords, and relations whose items alone may answer.
INSUFFICIENT = "查無足夠的會議紀錄脈絡可供回答。"
KEYWORD_CUES = (
    "會議項目", "討論事項", "有哪些", "哪些", "相關", "會議", "項目", "事項", "議題", "內容", "提及", "提到", "關於", "的", "列出", "請問",
    "related", "overview", "mentions", "about", "meeting", "meetings", "items", "item", "agenda", "topic", "topics", "which", "what",
)
AUTHORITATIVE = ("HAS_RISK", "HAS_DECISION", "TRACKS_ISSUE", "FOLLOW_UP_OF")
TERM_ENTITIES = ("product_name", "regulation_name", "person_name", "unit_name", "date_value")
MEETING_LISTS = ("structural_list", "meeting_summary")
MAX_TERMS = 8


@dataclass(frozen=True)
class Answer:
    """route (one row, with its plan), limit, evidence (evidence_id, meeting_id, item_id, ...), claims (claim, evidence_ids), answer (one row, answer)."""

    route: Row
    limit: int
    evidence: DataFrame
    claims: DataFrame
    answer: DataFrame


def keyword_terms(question: str, entities: dict[str, str]) -> list[str]:
    """Entities, English phrases and words of a question, longest first, without English words that a longer term holds."""
    for cue in KEYWORD_CUES:
        question = re.sub(re.escape(cue), " ", question, flags=re.I)
    question = re.sub(r"\s+", " ", question)
    found = [entities.get(k) or "" for k in TERM_ENTITIES]
    found += re.findall(r"[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z][A-Za-z0-9-]*){0,5}", question)
    found += re.split(r"[\s,，。；;:：?？()（）\[\]【】]+", question)
    found = [t.strip(" \t\r\n,，。；;:：?？()（）[]【】\"'") for t in found]
    terms: dict[str, str] = {}
    for t in found:
        if len(t) >= 2:
            terms.setdefault(t.lower(), t)
    words = {t: re.findall(r"[a-z][a-z0-9-]*", low) for low, t in terms.items()}
    phrases = {w for of in words.values() if len(of) >= 2 for w in of}
    alone = [t for t, of in words.items() if not (len(of) == 1 and of[0] in phrases)]
    return sorted(alone, key=lambda t: (-len(t), t.lower()))[:MAX_TERMS]


def may_use_keywords(found: Row) -> bool:
    """Whether items that only hold a word of the question may fill up the context."""
    given = {k for k in ("person_name", "unit_name", "date_value") if (found[k] or "").strip()}
    if found["query_type"] == "relation_lookup" and given:
        return False
    return bool(found["keyword_fallback"]) and not (found["query_type"] == "composite_query" and "person_name" in given)


def ask(
    question: str, meetings: DataFrame, items: DataFrame, edges: DataFrame, sem: DataFrame, co: DataFrame,
    semantic: Callable[[str, int], DataFrame] | None = None, claims_of: Callable[[str, DataFrame], DataFrame] | None = None, plan: dict | None = None, limit: int | str | None = None,
    planner: Planner | None = None, planner_mode: str | None = None,
) -> Answer:
    """Route the question, search the graph, the vectors and the tables, fuse and number the evidence, and answer by claims.

    plan constrains the composite part; without one the question's own plan does, with planner's help
    where planner_mode asks for it. semantic(question, limit) gives (meeting_id, item_id, content, score); claims_of(question, evidence)
    gives (claim, evidence_ids). Without claims_of, or where none of its claims cites known evidence,
    each record is a claim. A blank question is an error; one with a broken pseudonym, or without any
    evidence, has the fixed answer of INSUFFICIENT and no evidence.
    """
    question, spark = (question or "").strip(), meetings.sparkSession
    if not question:
        raise ValueError("a question is required")
    asked = spark.createDataFrame([(question, None if limit is None else str(limit))], "question string, asked string")
    planned = with_plan(route(asked), planner=planner, mode=planner_mode)
    found = planned.withColumns({"limit": effective_limit(F.col("asked"), F.col("default_limit")), "broken": malformed_token(F.col("question"))}).first()
    most, entities = int(found["limit"]), {k: found[k] for k in TERM_ENTITIES}
    near = items.select("meeting_id", "item_id", "content", F.lit(0.0).alias("score")).where("false")
    if found["broken"]:
        return _answered(found, most, evidence.fuse(_empty_graph(items), near.drop("score"), near), None, question)
    if semantic is not None and found["use_semantic"]:
        near = materialize(semantic(question, most).select("meeting_id", "item_id", "content", "score").limit(most))
    whole = found["query_type"] in (*MEETING_LISTS, *evidence.EXPLICIT)
    graph = materialize(search_graph(edges, meetings, items, sem, co, question, list(found["retrieval_modes"]), found["graph_intent"], entities, as_dict(found["plan"]) if plan is None else plan, most if whole else 4 * most))
    ruled = False
    if found["query_type"] in ("semantic_summary", "follow_up_tracking"):
        alone = graph.where(F.col("matched_relation").isin(*AUTHORITATIVE)).select("item_id")
        ruled = not alone.isEmpty()
        near = near.join(alone.distinct(), "item_id", "left_semi").select("meeting_id", "item_id", "content", "score") if ruled else near
    columns = ["meeting_id", "item_id", "content"]
    structured = materialize(answers.structured_context(answers.ranked_items(graph, near), items, meetings, most).select(*columns))
    if found["query_type"] in MEETING_LISTS:
        structured = _filled(structured, answers.meeting_items_context(meetings, items, question, most, found["meeting_hint"] or "").select(*columns), most)
    if may_use_keywords(found) and not ruled:
        structured = _filled(structured, answers.keyword_context(meetings, items, keyword_terms(question, entities), most).select(*columns), most)
    rows = graph.select(*columns, "matched_relation", "matched_entity", "graph_score")
    return _answered(found, most, evidence.fuse(rows, structured, near), claims_of, question)


def _empty_graph(items: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return items.select("meeting_id", "item_id", "content", none.alias("matched_relation"), none.alias("matched_entity"), F.lit(0.0).alias("graph_score")).where("false")


def _filled(context: DataFrame, more: DataFrame, most: int) -> DataFrame:
    """context with rows of more, item by item, up to most; both have at most that many."""
    missing = most - context.count()
    if missing <= 0:
        return context
    fresh = more.join(context.select("item_id"), "item_id", "left_anti").select(*context.columns).orderBy("meeting_id", "item_id").limit(missing)
    return materialize(context.unionByName(fresh))


def _answered(found: Row, most: int, fused: DataFrame, claims_of: Callable[[str, DataFrame], DataFrame] | None, question: str) -> Answer:
    known = materialize(evidence.records(fused, 2 * most))
    nothing = known.select(F.col("content").alias("claim"), F.array("evidence_id").alias("evidence_ids")).where("false")
    given = claims_of(question, known) if claims_of is not None else nothing
    claims = materialize(evidence.complete_claims(given, known, found["query_type"]))
    cited = evidence.cited_evidence(known, claims)
    text = evidence.render_answer(claims, cited).select(F.coalesce(F.nullif("answer", F.lit("")), F.lit(INSUFFICIENT)).alias("answer"))
    return Answer(found, most, cited, claims, text)
