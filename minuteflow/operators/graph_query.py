"""Graph patterns as bounded join chains over the edge table and the row tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minuteflow.functions.text import is_meaningful, strip
from minuteflow.operators.graph_build import item_text
from minuteflow.operators.planning import Planner, plan_question
from minuteflow.session import materialize

# Scores of the retrieval modes and relations.
MODE_SCORES = {"structural": 5.2, "follow_up": 4.7, "relation": 4.0, "keyword": 3.0}
RELATION_SCORES = {"HAS_ACTION": 3.8, "HAS_DECISION": 4.8, "HAS_RISK": 4.9, "TRACKS_ISSUE": 4.5, "FOLLOW_UP_OF": 4.4}
OTHER_RELATION = 4.2
MODES = ("structural", "composite", "relation", "keyword")
SUPPORTED = (*MODES, "follow_up")
# What a question for a meeting's items says, and words that name no meeting.
MEETING_CUES, ITEM_CUES = ("會議", "meeting"), ("項目", "事項", "討論事項", "議題", "item", "agenda", "topic", "內容", "包含", "有哪些", "哪些")
NO_NAME = ("會議", "項目", "討論事項", "事項", "議題", "內容", "包含", "有哪些", "哪些", "列出", "請問", "的", "which", "items", "agenda", "topics", "topic", "included", "include", "meeting", "content")
FOLLOW_UP_CUES = ("跨會議追蹤", "追蹤事項", "後續追蹤", "後續狀況", "後來怎麼處理", "後來如何處理", "相關", "整理", "有哪些", "哪些", "會議", "事項", "狀況")
REGULATION = r"\b(FDA|TFDA|CFDA|PMDA|CE|ISO\s*\d*)\b"
SEPARATORS = r"[\s,，。；;:：?？()（）\[\]【】]+"
# The relation that answers an intent, and the entity it needs.
INTENTS = {
    "person_responsibility": ("RESPONSIBLE_BY", "person_name"),
    "person_attendance": ("ATTENDED_BY", "person_name"),
    "meeting_chair": ("CHAIRED_BY", "person_name"),
    "meeting_recorder": ("RECORDED_BY", "person_name"),
    "unit_meetings": ("BELONGS_TO_UNIT", "unit_name"),
    "planned_date": ("HAS_PLANNED_DATE", "date_value"),
    "completed_date": ("HAS_COMPLETED_DATE", "date_value"),
    "product_related": ("MENTIONS_PRODUCT", "product_name"),
    "regulation_related": ("MENTIONS_REGULATION", "regulation_name"),
}
OF_MEETINGS = ("ATTENDED_BY", "CHAIRED_BY", "RECORDED_BY", "BELONGS_TO_UNIT")
FIELDS = {"RESPONSIBLE_BY": "owner", "BELONGS_TO_UNIT": "responsible_unit", "HAS_PLANNED_DATE": "planned_date", "HAS_COMPLETED_DATE": "actual_completed_date", "MENTIONS_PRODUCT": "content", "MENTIONS_REGULATION": "content"}
CONSTRAINTS = ("person_name", "unit_name", "product_name", "regulation_name", "status", "keyword")


def retrieval_modes(modes: str | list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    """The supported modes among those asked for, in order; all but follow_up by default."""
    asked = [modes] if isinstance(modes, str) else list(modes or [])
    named = [str(m or "").strip().lower() for m in asked]
    return tuple(dict.fromkeys(m for m in named if m in SUPPORTED)) or MODES


def asks_for_meeting_items(question: str) -> bool:
    low = question.lower()
    return any(c in low for c in MEETING_CUES) and any(c in low for c in ITEM_CUES)


def meeting_terms(question: str) -> list[str]:
    """At most 8 upper-case words of a question that may name a meeting."""
    for cue in NO_NAME:
        question = re.sub(re.escape(cue), " ", question, flags=re.I)
    return [t.strip().upper() for t in re.split(SEPARATORS, question) if len(t.strip()) >= 2][:8]


def follow_up_keyword(question: str) -> str:
    """A regulation, else the longest English phrase, else the first word without follow-up cues."""
    text = question.strip()
    if regulation := re.search(REGULATION, text, re.I):
        return regulation[1]
    phrases = [m.strip() for m in re.findall(r"[A-Za-z][A-Za-z0-9_-]*(?:\s+[A-Za-z][A-Za-z0-9_-]*){0,3}", text)]
    if named := [m for m in phrases if m.lower() not in ("follow up", "issue tracking")]:
        return max(named, key=len)
    for cue in FOLLOW_UP_CUES:
        text = text.replace(cue, " ")
    return next((t.strip() for t in re.split(SEPARATORS, text) if len(t.strip()) >= 2), "")


def of(edges: DataFrame, relation: str, src: str, dst: str) -> DataFrame:
    return edges.where(F.col("relation") == relation).select(F.col("src_id").alias(src), F.col("dst_id").alias(dst))


def same(c: str, value: str) -> F.Column:
    return F.upper(c) == value.upper()


def holds(c: str | F.Column, value: str | None) -> F.Column:
    """Case-insensitive substring; a blank value holds everywhere."""
    return F.upper(c).contains(value.upper()) if value else F.lit(True)


def newest_first(rows: DataFrame, *more: str) -> DataFrame:
    return rows.orderBy(F.col("meeting_date").desc_nulls_first(), *[F.col(c).asc_nulls_last() for c in ("item_no", "item_id", *more) if c in rows.columns])


def related_keywords(co: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    """(keyword, weight, count) of keywords that occur with one, over both directions."""
    # Both directions in one pass over the pairs.
    other = lambda end, name: F.when(same(end, keyword), F.struct(F.col(name).alias("keyword"), "weight", "count"))
    both = co.where(same("left", keyword) | same("right", keyword)).select(F.inline(F.array_compact(F.array(other("left", "right"), other("right", "left")))))
    return both.groupBy("keyword").agg(F.max("weight").alias("weight"), F.max("count").alias("count")).orderBy(F.desc("weight"), F.desc("count"), "keyword").limit(limit)


def placed(rows: DataFrame, meetings: DataFrame, items: DataFrame) -> DataFrame:
    """rows (item_id, ...) with what results show of their items and meetings."""
    shown = items.select("item_id", "meeting_id", "item_no", "content")
    return rows.join(shown, "item_id").join(meetings.select("meeting_id", "meeting_name", "meeting_date"), "meeting_id")


def items_of(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows (meeting_id, ...) with each item of the meeting."""
    return rows.join(items.select("meeting_id", "item_id"), "meeting_id").drop("meeting_id")


def keyword_hits(edges: DataFrame, meetings: DataFrame, items: DataFrame, keywords: list[str] | DataFrame) -> DataFrame:
    """Items that mention any of the keywords, and all items of meetings that do, without repeats."""
    named = F.upper("dst_id")
    mentions = edges.where("relation = 'MENTIONS'")
    if isinstance(keywords, DataFrame):
        hit = mentions.join(keywords.select(F.upper("keyword").alias("_k")).distinct(), named == F.col("_k"), "left_semi")
    else:
        hit = mentions.where(named.isin([k.upper() for k in keywords]))
    own = hit.where("src_type = 'MeetingItem'").select(F.col("src_id").alias("item_id"), F.col("dst_id").alias("matched_keyword"))
    through = items_of(hit.where("src_type = 'Meeting'").select(F.col("src_id").alias("meeting_id"), F.col("dst_id").alias("matched_keyword")), items)
    return placed(own.unionByName(through).distinct(), meetings, items)


def relation_items(edges: DataFrame, meetings: DataFrame, items: DataFrame, relation: str, value: str | None) -> DataFrame:
    """Items whose edge of a relation, or whose meeting's, ends at a node that contains value: people, units, dates, products, regulations."""
    if relation in OF_MEETINGS:
        hit = items_of(of(edges, relation, "meeting_id", "entity").where(holds("entity", value)), items)
    else:
        hit = of(edges, relation, "item_id", "entity").where(holds("entity", value))
    rows = placed(hit, meetings, items).select("meeting_id", "meeting_name", "meeting_date", "item_id", "item_no", "content", F.col("entity").alias("matched_entity"))
    return newest_first(rows.withColumns({"matched_relation": F.lit(relation), "matched_field": F.lit(FIELDS.get(relation, relation.lower().replace("_by", "")))}), "matched_entity")


def meeting_items_by_question(meetings: DataFrame, items: DataFrame, question: str, terms: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Items of the best-matching meetings: 100 the name is in the question, 95 the id is, 90 the question is in the name, else matching terms."""
    q = F.lit(question.upper())
    name, number = F.upper("meeting_name"), F.upper("meeting_id")
    hits = reduce(lambda a, t: a + F.when(name.contains(t.upper()) | number.contains(t.upper()), 1).otherwise(0), meeting_terms(question) if terms is None else terms, F.lit(0))
    score = F.when(q.contains(name), 100).when(q.contains(number), 95).when(name.contains(q), 90).otherwise(hits)
    scored = meetings.withColumn("match_score", score.cast("bigint")).where("match_score > 0").select("meeting_id", "meeting_name", "meeting_date", "match_score")
    # One row: the largest score, by partial maxima.
    best = scored.agg(F.max("match_score").alias("best"))
    kept = scored.join(F.broadcast(best), F.col("match_score") == F.col("best")).drop("best")
    rows = newest_first(kept.join(items.select("meeting_id", "item_id", "item_no", "content"), "meeting_id").withColumns({"matched_entity": F.col("meeting_name"), "matched_relation": F.lit("HAS_ITEM"), "matched_field": F.lit("meeting_items")}))
    return rows.limit(limit) if limit else rows


def status_condition(status: str) -> F.Column:
    """Over an item's dates and its action's status."""
    done = is_meaningful(F.col("actual_completed_date"))
    if status == "completed":
        return done | ((F.col("status") == "completed") & (F.col("status_confidence") == "high"))
    if status == "not_completed":
        return ~done & ~F.coalesce("status", F.lit("pending")).isin("completed", "not_applicable")
    return F.col("status") == status


TARGETS = {"action_items": "HAS_ACTION", "decisions": "HAS_DECISION", "risks": "HAS_RISK", "issues": "TRACKS_ISSUE"}
NODES = {"HAS_ACTION": "ActionItem", "HAS_DECISION": "Decision", "HAS_RISK": "Risk", "TRACKS_ISSUE": "Issue"}
#: Constraint, the item's relation, the action's relation, and the type of their ends.
ENTITY_CONSTRAINTS = (("person_name", "RESPONSIBLE_BY", "ASSIGNED_TO", "Person"), ("product_name", "MENTIONS_PRODUCT", "TARGETS_PRODUCT", "Product"), ("regulation_name", "MENTIONS_REGULATION", "CONSTRAINED_BY", "Regulation"))


def given(constraints: dict[str, str]) -> dict[str, str]:
    return {k: str(constraints[k]).strip() for k in CONSTRAINTS if str(constraints.get(k) or "").strip()}


def may_match(items: DataFrame, constraints: dict[str, str]) -> DataFrame:
    """The items that can meet the constraints on people, products and regulations; every one that does is among them.

    Edges and semantics need be made of these only. items holds each item's mentions in a column (mentions, an array
    of structs). A person is an item's owner or stands in its text; products and regulations are mentions. Other constraints are left to composite().
    """
    wanted, rows = given(constraints), items
    if person := wanted.get("person_name"):
        rows = rows.where(F.coalesce(holds("owner", person), F.lit(False)) | F.coalesce(holds(item_text(), person), F.lit(False)))
    for key, kind in (("product_name", "product"), ("regulation_name", "regulation")):
        if value := wanted.get(key):
            rows = rows.where(F.exists("mentions", lambda m: (m["type"] == kind) & F.coalesce(holds(m["name"], value), F.lit(False))))  # noqa: B023 - used at once
    return rows


def titles(sem: DataFrame) -> DataFrame:
    """(item_id, title, issue_title) of the semantic nodes of items."""
    return sem.select("item_id", F.substring("text", 1, 96).alias("title"), F.col("issue.title").alias("issue_title"), F.col("issue.signature").alias("issue_signature"))


def composite(edges: DataFrame, meetings: DataFrame, sem: DataFrame, target: str, constraints: dict[str, str], limit: int | None = 50) -> DataFrame:
    """Items with a node of the target kind under all given constraints (CONSTRAINTS), and the columns of results.

    Each constraint is a semi-join that is built only when it is given. meeting_items, and
    action_items without any constraint, give no rows; an unknown target means action_items. A limit
    of None gives all rows. sem: items with status fields and semantics.
    """
    wanted = given(constraints)
    relation = TARGETS.get(target, "HAS_ACTION")
    nothing = target == "meeting_items" or (target == "action_items" and not wanted)
    node = of(edges, relation, "item_id", "matched_node_id")
    rows = sem.withColumns({"title": F.substring("text", 1, 96), "issue_title": F.col("issue.title")}).join(node.where("false") if nothing else node, "item_id").join(meetings.select("meeting_id", "meeting_name", "meeting_date", "responsible_unit"), "meeting_id")
    for key, of_item, of_action, _ in ENTITY_CONSTRAINTS:
        if value := wanted.get(key):
            through = of(edges, of_action, "action_id", "entity").join(of(edges, "HAS_ACTION", "item_id", "action_id"), "action_id").select("item_id", "entity")
            found = of(edges, of_item, "item_id", "entity").unionByName(through).where(holds("entity", value))
            rows = rows.join(found, "item_id", "left_semi")
    if unit := wanted.get("unit_name"):
        rows = rows.where(holds("responsible_unit", unit))
    if status := wanted.get("status"):
        rows = rows.where(status_condition(status))
    if keyword := wanted.get("keyword"):
        mentioned = of(edges, "MENTIONS", "item_id", "entity").where(holds("entity", keyword)).select("item_id", F.lit(True).alias("mentioned")).distinct()
        said = reduce(lambda a, c: a | F.coalesce(holds(c, keyword), F.lit(False)), ("title", "issue_title"), F.coalesce(holds("content", keyword), F.lit(False)))
        rows = rows.join(mentioned, "item_id", "left").where(said | F.coalesce("mentioned", F.lit(False)))
    entity = F.col("issue_title" if relation == "TRACKS_ISSUE" else "title")
    out = rows.select(
        "meeting_id", "meeting_name", "meeting_date", "item_id", "item_no", "content", entity.alias("matched_entity"), "matched_node_id", F.lit(relation).alias("matched_relation"), F.lit(target).alias("matched_field"),
        F.lit(RELATION_SCORES.get(relation, OTHER_RELATION)).alias("graph_score"), "status", F.col("status_source").alias("semantic_status_source"), F.col("status_confidence").alias("semantic_status_confidence"),
    )
    rows = newest_first(out, "matched_node_id")
    return rows if limit is None else rows.limit(limit)


def composite_evidence(rows: DataFrame, edges: DataFrame, meetings: DataFrame, constraints: dict[str, str]) -> DataFrame:
    """(item_id, source_type, source_value, relation, target_type, target_value, target_label) that show why composite rows match."""
    wanted, names = given(constraints), ["item_id", "source_type", "source_value", "relation", "target_type", "target_value", "target_label"]
    kind = F.create_map(*[x for pair in NODES.items() for x in map(F.lit, pair)])[F.col("matched_relation")]
    label = F.coalesce(F.nullif("matched_entity", F.lit("")), "matched_node_id")
    parts = [rows.select("item_id", F.lit("MeetingItem"), "item_id", "matched_relation", kind, "matched_node_id", label).toDF(*names)]

    def ends(keyed: DataFrame, source_type: str, source: str, relation: str, target_type: str, value: str) -> None:
        hit = of(edges, relation, "_src", "_dst").where(holds("_dst", value))
        parts.append(keyed.select("item_id", F.col(source).alias("_src")).join(hit, "_src").select("item_id", F.lit(source_type), "_src", F.lit(relation), F.lit(target_type), "_dst", F.col("_dst").alias("l")).toDF(*names))

    for key, of_item, of_action, target_type in ENTITY_CONSTRAINTS:
        if value := wanted.get(key):
            ends(rows, "MeetingItem", "item_id", of_item, target_type, value)
            ends(rows.where("matched_relation = 'HAS_ACTION'"), "ActionItem", "matched_node_id", of_action, target_type, value)
    if unit := wanted.get("unit_name"):
        ends(rows, "Meeting", "meeting_id", "BELONGS_TO_UNIT", "Unit", unit)
    if keyword := wanted.get("keyword"):
        ends(rows, "MeetingItem", "item_id", "MENTIONS", "Keyword", keyword)
    return reduce(DataFrame.unionByName, parts).distinct()


def entity_lists(edges: DataFrame, items: DataFrame) -> DataFrame:
    """items with sorted owner, product, regulation and keyword name arrays, empty where there are none."""
    out = items
    for relation, name in (("RESPONSIBLE_BY", "owner_names"), ("MENTIONS_PRODUCT", "product_names"), ("MENTIONS_REGULATION", "regulation_names"), ("MENTIONS", "keyword_names")):
        listed = edges.where((F.col("relation") == relation) & (F.col("src_type") == "MeetingItem")).groupBy(F.col("src_id").alias("item_id")).agg(F.array_sort(F.collect_set("dst_id")).alias(name))
        out = out.join(listed, "item_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def follow_up_pairs(edges: DataFrame, meetings: DataFrame, items: DataFrame, sem: DataFrame, keyword: str | None = None) -> DataFrame:
    """Items that follow another; keyword is looked for in the item, the one before it and the issue's title (None: all)."""
    before = items.select(F.col("item_id").alias("previous_item_id"), F.col("meeting_id").alias("previous_meeting_id"), F.col("content").alias("previous_content"))
    rows = placed(of(edges, "FOLLOW_UP_OF", "item_id", "previous_item_id"), meetings, items).join(before, "previous_item_id", "left").join(titles(sem).select("item_id", "issue_title"), "item_id", "left")
    said = reduce(lambda a, c: a | F.coalesce(holds(c, keyword), F.lit(False)), ("previous_content", "issue_title"), F.coalesce(holds("content", keyword), F.lit(not keyword)))
    shown = {"matched_entity": F.col("previous_item_id"), "matched_node_id": F.col("previous_item_id"), "matched_relation": F.lit("FOLLOW_UP_OF"), "matched_field": F.lit("follow_up"), "graph_score": F.lit(RELATION_SCORES["FOLLOW_UP_OF"])}
    return newest_first(rows.where(said).drop("previous_content", "issue_title").withColumns(shown), "previous_item_id")


def issue_timeline(edges: DataFrame, meetings: DataFrame, items: DataFrame, sem: DataFrame, keyword: str | None, limit: int | None = None) -> DataFrame:
    """Items of issues that hold keyword in the issue's title or signature, their content, or a mentioned name, numbered in time, with the items before and after."""
    tracks = placed(of(edges, "TRACKS_ISSUE", "item_id", "issue_id"), meetings, items).join(titles(sem).drop("title"), "item_id", "left")
    if keyword:
        named = edges.where(F.col("relation").isin("MENTIONS", "MENTIONS_PRODUCT", "MENTIONS_REGULATION") & (F.col("src_type") == "MeetingItem")).where(holds("dst_id", keyword))
        mentioned = named.select(F.col("src_id").alias("item_id"), F.lit(True).alias("mentioned")).distinct()
        said = reduce(lambda a, c: a | F.coalesce(holds(c, keyword), F.lit(False)), ("issue_title", "issue_signature", "content"), F.coalesce("mentioned", F.lit(False)))
        tracks = tracks.join(mentioned, "item_id", "left").where(said).drop("mentioned")
    for relation, side in (("previous", ("item_id", "previous_item_id")), ("next", ("next_item_id", "item_id"))):
        other = items.select(F.col("item_id").alias(f"{relation}_item_id"), F.col("meeting_id").alias(f"{relation}_meeting_id"))
        tracks = tracks.join(of(edges, "FOLLOW_UP_OF", *side), "item_id", "left").join(other, f"{relation}_item_id", "left")
    order = [F.coalesce(c, F.lit("")) for c in ("meeting_date", "meeting_id", "item_no", "item_id")]
    if limit:
        tracks = tracks.orderBy("issue_id", *order).limit(limit)
    numbered = tracks.withColumn("sequence_no", F.row_number().over(Window.partitionBy("issue_id").orderBy(*order)))
    return numbered.withColumns({"matched_entity": F.coalesce("issue_title", "issue_id"), "matched_relation": F.lit("TRACKS_ISSUE"), "matched_field": F.lit("issue_timeline"), "graph_score": F.lit(MODE_SCORES["follow_up"])})


def timeline_evidence(timeline: DataFrame) -> DataFrame:
    """(item_id, source_type, source_value, relation, target_type, target_value) of a timeline's rows: the issue, the item before and the item after."""
    item = F.lit("MeetingItem")

    def relation(source: str, name: str, kind: F.Column, target: str) -> F.Column:
        return F.struct(item.alias("source_type"), F.col(source).alias("source_value"), F.lit(name).alias("relation"), kind.alias("target_type"), F.col(target).alias("target_value"))

    three = F.array(relation("item_id", "TRACKS_ISSUE", F.lit("Issue"), "issue_id"), relation("item_id", "FOLLOW_UP_OF", item, "previous_item_id"), relation("next_item_id", "FOLLOW_UP_OF", item, "item_id"))
    return timeline.select("item_id", F.explode(three).alias("e")).select("item_id", "e.*").where("source_value is not null and target_value is not null").distinct()


def keyword_scores(hits: DataFrame, query: str, weights: DataFrame) -> DataFrame:
    """graph_score of keyword hits: 3 for the query itself, else 2.5 times the keyword's weight, at least half a point."""
    related = weights.select(F.upper("keyword").alias("_k"), "weight").groupBy("_k").agg(F.max("weight").alias("weight"))
    joined = hits.join(related, F.upper("matched_keyword") == F.col("_k"), "left")
    score = F.when(F.col("matched_keyword") == query, MODE_SCORES["keyword"]).otherwise(F.greatest(F.round(2.5 * F.coalesce("weight", F.lit(0.0)), 2), F.lit(0.5)))
    return joined.withColumn("graph_score", score).drop("_k", "weight")


def dedupe_results(results: DataFrame) -> DataFrame:
    """The best row of each (meeting, item, relation, entity, keyword); seq is the order of arrival."""
    key = [F.coalesce(c, F.lit("")) for c in ("meeting_id", "item_id", "matched_relation", "matched_entity", "matched_keyword")]
    best = Window.partitionBy(*key).orderBy(F.desc("graph_score"), "seq")
    return results.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def score_context(results: DataFrame, key: str) -> DataFrame:
    """(key, graph): summed graph scores of a meeting or an item, as boosts of the ranked search."""
    return results.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("graph_score").alias("graph"))


RESULT = ("meeting_id", "meeting_name", "meeting_date", "item_id", "item_no", "content", "matched_keyword", "matched_entity", "matched_relation", "matched_field", "retrieval_mode", "graph_score")


def _results(rows: DataFrame, mode: str, score: float | None = None) -> DataFrame:
    blank = {c: F.lit(None).cast("string") for c in ("matched_keyword", "matched_entity") if c not in rows.columns}
    return rows.withColumns(blank | {"retrieval_mode": F.lit(mode)} | ({} if score is None else {"graph_score": F.lit(score)})).select(*RESULT)


def search_graph(
    edges: DataFrame, meetings: DataFrame, items: DataFrame, sem: DataFrame, co: DataFrame, question: str, modes: str | list[str] | tuple[str, ...] | None = None, intent: str = "keyword_related", entities: dict[str, str] | None = None, plan: dict | None = None, limit: int = 50,
    planner: Planner | None = None, planner_mode: str | None = None,
) -> DataFrame:
    """Rows of the asked retrieval modes, merged, deduplicated and sorted by score, date and item.

    Items of a named meeting, or of a date that is asked for, answer alone; related keywords count
    only where no other mode finds anything. intent and entities come from the routing functions,
    plan is {target, constraints, include_followups}; without one, the composite mode plans the
    question itself, with planner's help where planner_mode asks for it. Each part has at most limit rows but the
    keyword rows and is written, as its being empty decides what follows. A blank question gives no rows.
    """
    asked, question = retrieval_modes(modes), question.strip()
    parts: list[DataFrame] = []
    nothing = _results(relation_items(edges, meetings, items, "HAS_ITEM", None), "none", 0.0).where("false")
    if not question:
        return nothing
    if "structural" in asked and asks_for_meeting_items(question):
        found = materialize(_results(meeting_items_by_question(meetings, items, question, limit=limit), "structural", MODE_SCORES["structural"]))
        if not found.isEmpty():
            return found
    if "follow_up" in asked:
        parts.append(materialize(_results(issue_timeline(edges, meetings, items, sem, follow_up_keyword(question), limit), "follow_up")))
    by_relation = None
    if "relation" in asked and intent in INTENTS:
        relation, entity = INTENTS[intent]
        by_relation = materialize(_results(relation_items(edges, meetings, items, relation, str((entities or {}).get(entity) or "").strip()).limit(limit), "relation", MODE_SCORES["relation"]))
        if intent in ("planned_date", "completed_date") and not by_relation.isEmpty():
            return by_relation
    if "composite" in asked and plan is None:
        plan = plan_question(meetings.sparkSession, question, planner, planner_mode)
    if "composite" in asked and plan.get("target", "meeting_items") != "meeting_items":
        constraints = plan.get("constraints") or {}
        parts.append(materialize(_results(composite(edges, meetings, sem, plan["target"], constraints, limit), "composite")))
        if plan.get("include_followups") and (plan["target"] != "action_items" or given(constraints)):
            keyword = next((v for k in ("keyword", "product_name", "regulation_name") if (v := given(constraints).get(k))), None)
            parts.append(materialize(_results(follow_up_pairs(edges, meetings, items, sem, keyword).limit(limit), "composite")))
    if by_relation is not None:
        parts.append(by_relation)
    if "keyword" in asked:
        related = materialize(related_keywords(co, question, 8))
        own = related.sparkSession.createDataFrame([(question,)], "keyword string")
        direct_only = any(not p.isEmpty() for p in parts)
        found = keyword_hits(edges, meetings, items, [question] if direct_only else related.select("keyword").unionByName(own))
        rows = keyword_scores(found, question, related).withColumns({"matched_entity": F.col("matched_keyword"), "matched_relation": F.lit("MENTIONS"), "matched_field": F.lit("content")})
        parts.append(_results(rows.where(F.col("matched_keyword") == question) if direct_only else rows, "keyword"))
    if not parts:
        return nothing
    ordered = [p.withColumn("seq", F.lit(k)) for k, p in enumerate(parts)]
    return dedupe_results(reduce(DataFrame.unionByName, ordered)).drop("seq").orderBy(F.desc("graph_score"), F.coalesce("meeting_date", F.lit("")), "item_id").limit(limit)


# Named aggregate templates.


def product_meeting_counts(edges: DataFrame, limit: int = 20) -> DataFrame:
    """Products by distinct meetings that mention them."""
    return of(edges, "MENTIONS_PRODUCT", "item_id", "product").join(of(edges, "HAS_ITEM", "meeting_id", "item_id"), "item_id").groupBy("product").agg(F.countDistinct("meeting_id").alias("meeting_count")).orderBy(F.desc("meeting_count"), "product").limit(limit)


def person_item_counts(edges: DataFrame, limit: int = 20) -> DataFrame:
    return of(edges, "RESPONSIBLE_BY", "item_id", "person").groupBy("person").agg(F.countDistinct("item_id").alias("item_count")).orderBy(F.desc("item_count"), "person").limit(limit)


def meetings_with_both(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Meetings whose items mention both regulations."""
    hit = of(edges, "MENTIONS_REGULATION", "item_id", "regulation").where(same("regulation", first) | same("regulation", second))
    return hit.join(of(edges, "HAS_ITEM", "meeting_id", "item_id"), "item_id").groupBy("meeting_id").agg(F.countDistinct(F.upper("regulation")).alias("n")).where("n = 2").select("meeting_id")


def product_regulation_counts(edges: DataFrame) -> DataFrame:
    """Items that mention a product and a regulation."""
    return of(edges, "MENTIONS_PRODUCT", "item_id", "product").join(of(edges, "MENTIONS_REGULATION", "item_id", "regulation"), "item_id").groupBy("product", "regulation").agg(F.countDistinct("item_id").alias("item_count"))


def issues_without_follow_up(edges: DataFrame) -> DataFrame:
    """Issues none of whose items follows or is followed."""
    chained = of(edges, "FOLLOW_UP_OF", "item_id", "other").select("item_id").union(of(edges, "FOLLOW_UP_OF", "other", "item_id").select("item_id")).distinct()
    tracks = of(edges, "TRACKS_ISSUE", "item_id", "issue_id")
    busy = tracks.join(chained, "item_id", "left_semi").select("issue_id").distinct()
    return tracks.join(busy, "issue_id", "left_anti").groupBy("issue_id").agg(F.count("*").alias("item_count"))


def product_people(edges: DataFrame, product: str) -> DataFrame:
    hit = of(edges, "MENTIONS_PRODUCT", "item_id", "product").where(holds("product", product)).select("item_id").distinct()
    return of(edges, "RESPONSIBLE_BY", "item_id", "person").join(hit, "item_id", "left_semi").groupBy("person").agg(F.countDistinct("item_id").alias("item_count"))


def expand_node(edges: DataFrame, node_type: str, node_id: str, relations: tuple[str, ...] | None = None, limit: int = 10) -> DataFrame:
    """Neighbours of one node in either direction, optionally of some relations."""
    out = edges.where((F.col("src_type") == node_type) & same("src_id", node_id)).select("relation", F.col("dst_type").alias("type"), F.col("dst_id").alias("id"), F.lit("out").alias("direction"))
    back = edges.where((F.col("dst_type") == node_type) & same("dst_id", node_id)).select("relation", F.col("src_type").alias("type"), F.col("src_id").alias("id"), F.lit("in").alias("direction"))
    both = out.union(back)
    if relations:
        both = both.where(F.col("relation").isin(*relations))
    return both.distinct().orderBy("relation", "type", "id", "direction").limit(limit)


def project_graph(results: DataFrame) -> DataFrame:
    """Result rows -> distinct edges (src, label, dst) with 'src->label->dst' ids."""
    entity = F.when(F.col("matched_entity").isNotNull(), F.struct(F.concat(F.lit("MeetingItem:"), "item_id").alias("src"), F.col("matched_relation").alias("label"), F.concat(F.lit("Entity:"), "matched_entity").alias("dst")))
    owner = F.when(F.col("item_id").isNotNull(), F.struct(F.concat(F.lit("Meeting:"), "meeting_id").alias("src"), F.lit("HAS_ITEM").alias("label"), F.concat(F.lit("MeetingItem:"), "item_id").alias("dst")))
    return results.select(F.explode(F.array_compact(F.array(owner, entity))).alias("e")).select("e.*").distinct().withColumn("id", F.concat_ws("->", "src", "label", "dst"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id) at neither end of an edge (src, dst)."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.join(ends, "id", "left_anti").where(strip(F.col("id")) != "")
