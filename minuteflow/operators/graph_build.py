"""The property graph as one node table and one edge table, rebuilt as a snapshot.

mentions: (owner_type 'Meeting' or 'MeetingItem', owner_id, field, name, type, score, method), as the
keyword extraction gives them. Products and regulations are the mentions of those types in content.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from minuteflow.functions.extract import PRODUCT_CUES, has_decision, has_risk, issue_of, people_from_text, risk_severity, with_keywords
from minuteflow.functions.status import with_status
from minuteflow.functions.text import has_owner, is_meaningful, squash, strip, truncate
from minuteflow.session import materialize

ACTION_TITLE = 96


def edge(rows: DataFrame, src_type: str, src: str, relation: str, dst_type: str, dst: str, once: bool = False) -> DataFrame:
    """Distinct edges of one relation; blank ends are left out. once: rows hold no pair of ends twice, so nothing is shuffled."""
    ends = rows.select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id")).where((strip(F.coalesce("src_id", F.lit(""))) != "") & (strip(F.coalesce("dst_id", F.lit(""))) != ""))
    ends = ends if once else ends.distinct()
    return ends.select(F.lit(src_type).alias("src_type"), "src_id", F.lit(relation).alias("relation"), F.lit(dst_type).alias("dst_type"), "dst_id")


MENTION_FIELDS = ("content", "tracking_result")


def extracted_mentions(meetings: DataFrame, items: DataFrame, cues: tuple[str, ...] = PRODUCT_CUES) -> DataFrame:
    """The mentions that keyword extraction finds in meeting names and in the items' texts, a row for each owner, field and keyword."""
    texts = [meetings.select(F.lit("Meeting").alias("owner_type"), F.col("meeting_id").alias("owner_id"), F.lit("meeting_name").alias("field"), F.col("meeting_name").alias("text"))]
    texts += [items.select(F.lit("MeetingItem").alias("owner_type"), F.col("item_id").alias("owner_id"), F.lit(f).alias("field"), F.col(f).alias("text")) for f in MENTION_FIELDS]
    rows = reduce(DataFrame.union, texts).where(is_meaningful(F.col("text")))
    keyed = rows.select(F.struct("owner_type", "owner_id", "field").alias("owner"), "text")
    return with_keywords(keyed, "owner", "text", cues=cues).select("owner.*", "name", "type", "score", "method")


def item_text() -> F.Column:
    return squash(F.concat_ws(" ", "content", "tracking_result"))


def semantics(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """(item_id, meeting_id, people, products, regulations, text, issue, has_decision, has_risk, severity) of each item."""
    return described(with_status(items), mentions)


def described(items: DataFrame, mentions: DataFrame | None) -> DataFrame:
    """semantics() of items whose status is known, or isn't asked for.

    Without mentions, each item has its own in a column (mentions, an array of structs), and nothing is shuffled.
    """
    of_type = lambda kind: F.sort_array(F.array_distinct(F.transform(F.filter("found", lambda m: (m["type"] == kind) & m["name"].isNotNull()), lambda m: m["name"])))
    lists = {"products": of_type("product"), "regulations": of_type("regulation")}
    if mentions is None:
        known = items.withColumn("found", F.transform("mentions", lambda m: F.struct(m["type"].alias("type"), m["score"].cast("double").alias("score"), m["name"].alias("name")))).drop("mentions").withColumns(lists)
    else:
        own = mentions.where("owner_type = 'MeetingItem'")
        # A mention is shuffled once, for whatever list it belongs to.
        found = own.groupBy(F.col("owner_id").alias("item_id")).agg(F.collect_set(F.struct("type", F.col("score").cast("double").alias("score"), "name")).alias("found"))
        known = items.join(found.withColumns(lists), "item_id", "left")
    keywords = F.array_distinct(F.transform(F.coalesce("found", F.expr("cast(array() as array<struct<type:string,score:double,name:string>>)")), lambda m: F.struct((-m["score"]).alias("s"), F.lower(m["name"]).alias("low"), m["name"].alias("name"))))
    none = F.array().cast("array<string>")
    joined = known.withColumns({c: F.coalesce(c, none) for c in ("products", "regulations")}).withColumn("text", item_text())
    core = F.concat("products", "regulations")
    anchors = F.when(F.size(core) > 0, core).otherwise(F.transform(F.slice(F.sort_array(keywords), 1, 3), lambda k: k["name"]))
    owner = F.when(has_owner(F.col("owner")), F.array(strip(F.col("owner")))).otherwise(none)
    return joined.withColumns({"anchors": anchors, "people": F.array_distinct(F.concat(owner, people_from_text(F.col("text"))))}).drop("found").withColumns(
        {"issue": F.when(F.col("text") != "", issue_of(F.col("anchors"), F.col("text"))), "decided": has_decision(F.col("text")), "risky": has_risk(F.col("text")), "severity": risk_severity(F.col("text"))}
    )


def cooccurrence(mentions: DataFrame) -> DataFrame:
    """(left, right, count, weight): items that mention both names; weight is relative to the left name's largest count."""
    # An item's names meet in its row, and pairs are summed where they are: only names and partial counts are shuffled.
    return _pair_counts(mentions.where("owner_type = 'MeetingItem' and owner_id is not null").groupBy("owner_id").agg(F.collect_set("name").alias("names")))


def _pair_counts(listed: DataFrame) -> DataFrame:
    """cooccurrence() of items' lists of names without repeats."""
    pairs = listed.select("names", F.explode_outer("names").alias("left")).select("left", F.explode_outer("names").alias("right"))
    counted = pairs.where("left <> right").groupBy("left", "right").agg(F.count("*").alias("count"))
    return counted.withColumn("weight", F.round(F.col("count") / F.max("count").over(Window.partitionBy("left")), 4))


def follow_ups(issue_items: DataFrame) -> DataFrame:
    """(item_id, previous_item_id, issue_id): each item of an issue after the one before it by date, meeting, number and id."""
    order = [F.coalesce(c, F.lit("")) for c in ("meeting_date", "meeting_id", "item_no", "item_id")]
    previous = F.lag("item_id").over(Window.partitionBy("issue_id").orderBy(*order))
    return issue_items.withColumn("previous_item_id", previous).where("previous_item_id is not null and previous_item_id <> item_id").select("item_id", "previous_item_id", "issue_id")


FROM_SEMANTICS = ("RESPONSIBLE_BY", "HAS_ACTION", "ASSIGNED_TO", "TARGETS_PRODUCT", "CONSTRAINED_BY", "HAS_DECISION", "HAS_RISK", "TRACKS_ISSUE", "DECIDES_ON", "RISK_OF", "FOLLOW_UP_OF")


def build_edges(meetings: DataFrame, items: DataFrame, mentions: DataFrame, relations: tuple[str, ...] | None = None, store: bool = True) -> DataFrame:
    """Edges (src_type, src_id, relation, dst_type, dst_id) of the asked relations, or of all.

    The item semantics feed several kinds of edges, so they are written once where more than one is asked for.
    store=False writes nothing: a reader that takes few of the relations has Spark make only those.
    """
    needed = [r for r in FROM_SEMANTICS if relations is None or r in relations]
    sem = described(items.select("item_id", "owner", "content", "tracking_result"), mentions).select("item_id", "people", "products", "regulations", "issue", "decided", "risky")
    once = False
    if store and len(needed) > 1:
        # Where no item_id comes twice, as this job sees, neither do the edges of items, whose lists have no repeats.
        seen = Observation()
        counted = sem.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("item_id"))).observe(seen, F.coalesce(F.max("_n"), F.lit(1)).alias("most"))
        sem = materialize(counted.drop("_n"))
        once = seen.get.get("most") == 1
    act, dec, risk = (F.concat(F.lit(p), "item_id") for p in ("action_", "decision_", "risk_"))
    sem = sem.withColumns({"action_id": act, "decision_id": F.when(F.col("decided"), dec), "risk_id": F.when(F.col("risky"), risk), "issue_id": F.col("issue.issue_id")})
    people = sem.select("item_id", "action_id", F.explode_outer("people").alias("person"))
    products = sem.select("item_id", "action_id", F.explode_outer("products").alias("name"))
    regulations = sem.select("item_id", "action_id", F.explode_outer("regulations").alias("name"))
    attended = meetings.select("meeting_id", F.explode(F.array_distinct(F.concat(F.array("chairperson", "recorder"), F.coalesce("attendees", F.array().cast("array<string>"))))).alias("person")).where(has_owner(F.col("person")))
    dated = items.join(meetings.select("meeting_id", "meeting_date"), "meeting_id", "left").select("item_id", "meeting_id", "item_no", "meeting_date")
    chained = follow_ups(sem.select("item_id", "issue_id").where("issue_id is not null").join(dated, "item_id"))
    own = mentions.where("owner_type = 'MeetingItem'")
    builders = [
        ("HAS_MEETING", lambda: edge(meetings, "Document", "document_id", "HAS_MEETING", "Meeting", "meeting_id")),
        ("HAS_ITEM", lambda: edge(items, "Meeting", "meeting_id", "HAS_ITEM", "MeetingItem", "item_id", once)),
        ("BELONGS_TO_UNIT", lambda: edge(meetings, "Meeting", "meeting_id", "BELONGS_TO_UNIT", "Unit", "responsible_unit")),
        ("CHAIRED_BY", lambda: edge(meetings, "Meeting", "meeting_id", "CHAIRED_BY", "Person", "chairperson")),
        ("RECORDED_BY", lambda: edge(meetings, "Meeting", "meeting_id", "RECORDED_BY", "Person", "recorder")),
        ("ATTENDED_BY", lambda: edge(attended, "Meeting", "meeting_id", "ATTENDED_BY", "Person", "person")),
        ("HAS_PLANNED_DATE", lambda: edge(items.where(is_meaningful(F.col("planned_date"))), "MeetingItem", "item_id", "HAS_PLANNED_DATE", "Date", "planned_date", once)),
        ("HAS_COMPLETED_DATE", lambda: edge(items.where(is_meaningful(F.col("actual_completed_date"))), "MeetingItem", "item_id", "HAS_COMPLETED_DATE", "Date", "actual_completed_date", once)),
        ("RESPONSIBLE_BY", lambda: edge(people, "MeetingItem", "item_id", "RESPONSIBLE_BY", "Person", "person", once)),
        ("MENTIONS", lambda: edge(own, "MeetingItem", "owner_id", "MENTIONS", "Keyword", "name")),
        ("MENTIONS", lambda: edge(mentions.where("owner_type = 'Meeting'"), "Meeting", "owner_id", "MENTIONS", "Keyword", "name")),
        ("MENTIONS_PRODUCT", lambda: edge(own.where("type = 'product' and field = 'content' and name like '% %'"), "MeetingItem", "owner_id", "MENTIONS_PRODUCT", "Product", "name")),
        ("MENTIONS_REGULATION", lambda: edge(own.where("type = 'regulation' and field = 'content'"), "MeetingItem", "owner_id", "MENTIONS_REGULATION", "Regulation", "name")),
        ("HAS_ACTION", lambda: edge(sem, "MeetingItem", "item_id", "HAS_ACTION", "ActionItem", "action_id", once)),
        ("ASSIGNED_TO", lambda: edge(people, "ActionItem", "action_id", "ASSIGNED_TO", "Person", "person", once)),
        ("TARGETS_PRODUCT", lambda: edge(products, "ActionItem", "action_id", "TARGETS_PRODUCT", "Product", "name", once)),
        ("CONSTRAINED_BY", lambda: edge(regulations, "ActionItem", "action_id", "CONSTRAINED_BY", "Regulation", "name", once)),
        ("HAS_DECISION", lambda: edge(sem, "MeetingItem", "item_id", "HAS_DECISION", "Decision", "decision_id", once)),
        ("HAS_RISK", lambda: edge(sem, "MeetingItem", "item_id", "HAS_RISK", "Risk", "risk_id", once)),
        ("TRACKS_ISSUE", lambda: edge(sem, "MeetingItem", "item_id", "TRACKS_ISSUE", "Issue", "issue_id", once)),
        ("DECIDES_ON", lambda: edge(sem, "Decision", "decision_id", "DECIDES_ON", "Issue", "issue_id", once)),
        ("RISK_OF", lambda: edge(sem, "Risk", "risk_id", "RISK_OF", "Issue", "issue_id", once)),
        ("FOLLOW_UP_OF", lambda: edge(chained, "MeetingItem", "item_id", "FOLLOW_UP_OF", "MeetingItem", "previous_item_id")),
        ("CO_OCCURS_WITH", lambda: edge(cooccurrence(mentions), "Keyword", "left", "CO_OCCURS_WITH", "Keyword", "right")),
    ]
    return reduce(DataFrame.union, [build() for relation, build in builders if relations is None or relation in relations])


#: Relations that an item's row tells, its mentions being a column of it.
OF_ROWS = ("HAS_ITEM", "HAS_PLANNED_DATE", "HAS_COMPLETED_DATE", "RESPONSIBLE_BY", "MENTIONS", "MENTIONS_PRODUCT", "MENTIONS_REGULATION")


def are_unique(items: DataFrame) -> bool:
    """Whether no item_id comes twice; only ids and their counts are shuffled."""
    return items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def row_edges(items: DataFrame, relations: tuple[str, ...], deal: Callable[[DataFrame], DataFrame] = lambda rows: rows, unique: bool | None = None) -> DataFrame:
    """Edges of some relations (OF_ROWS) with the meeting_id that they come from, as build_edges and graph_store.owned give them.

    items holds each item's mentions in a column (mentions, an array of structs), so a row gives all its edges in one pass and
    no join. deal may shuffle the rows (meeting_id, item_id, ...) before they are taken apart. Equal edges are
    dropped unless the items are unique, which is looked up if it isn't given.
    """
    said = lambda keep: F.transform(F.filter("mentions", keep), lambda m: m["name"])
    none = F.array().cast("array<string>")
    dated = lambda c: F.when(is_meaningful(F.col(c)), F.array(c))
    ends = {
        "HAS_ITEM": ("Meeting", "meeting_id", "MeetingItem", lambda: F.array("item_id")),
        "HAS_PLANNED_DATE": ("MeetingItem", "item_id", "Date", lambda: dated("planned_date")),
        "HAS_COMPLETED_DATE": ("MeetingItem", "item_id", "Date", lambda: dated("actual_completed_date")),
        "RESPONSIBLE_BY": ("MeetingItem", "item_id", "Person", lambda: F.concat(F.when(has_owner(F.col("owner")), F.array(strip(F.col("owner")))).otherwise(none), people_from_text(F.col("_text")))),
        "MENTIONS": ("MeetingItem", "item_id", "Keyword", lambda: said(lambda m: F.lit(True))),
        "MENTIONS_PRODUCT": ("MeetingItem", "item_id", "Product", lambda: said(lambda m: (m["type"] == "product") & (m["field"] == "content") & m["name"].contains(" "))),
        "MENTIONS_REGULATION": ("MeetingItem", "item_id", "Regulation", lambda: said(lambda m: (m["type"] == "regulation") & (m["field"] == "content"))),
    }
    # Generated rows: a text is made once, however often it is used.
    texts = items.select("*", F.inline_outer(F.array(F.struct(item_text().alias("_text"))))) if "RESPONSIBLE_BY" in relations else items
    # What begins with a printable ASCII character isn't blank; the test is cheaper than trimming.
    filled = lambda c: F.coalesce(F.col(c).between("!", "~") | (strip(F.col(c)) != ""), F.lit(False))
    listed = texts.select("meeting_id", "item_id", *[F.coalesce(F.array_distinct(ends[r][3]()), none).alias(r) for r in relations])
    of = lambda r: F.transform(r, lambda d: F.struct(F.lit(ends[r][0]).alias("src_type"), F.col(ends[r][1]).alias("src_id"), F.lit(r).alias("relation"), F.lit(ends[r][2]).alias("dst_type"), d.alias("dst_id")))
    # The outer form keeps Spark from inferring a filter on the array and so computing it twice.
    edges = deal(listed).select("meeting_id", F.inline_outer(F.concat(*map(of, relations)))).where(filled("src_id") & filled("dst_id"))
    edges = edges.select("src_type", "src_id", "relation", "dst_type", "dst_id", "meeting_id")
    return edges if (are_unique(items) if unique is None else unique) else edges.distinct()


def row_cooccurrence(items: DataFrame, unique: bool | None = None) -> DataFrame:
    """cooccurrence() of items that hold their mentions in a column: only partial counts of pairs are shuffled, where no item_id comes twice."""
    names = F.array_distinct(F.filter(F.transform("mentions", lambda m: m["name"]), lambda n: n.isNotNull()))
    known = items.where("item_id is not null")
    if are_unique(known) if unique is None else unique:
        return _pair_counts(known.select(names.alias("names")))
    return _pair_counts(known.select("item_id", F.explode_outer(names).alias("name")).groupBy("item_id").agg(F.collect_set("name").alias("names")))


def build_nodes(edges: DataFrame) -> DataFrame:
    """Distinct (type, id) over both ends of the edges."""
    ends = F.array(*[F.struct(F.col(f"{end}_type").alias("type"), F.col(f"{end}_id").alias("id")) for end in ("src", "dst")])
    return edges.select(F.inline(ends)).distinct()


def descriptor_title() -> F.Column:
    """At most 96 characters of the item's text, or its id where it has none."""
    return truncate(F.when(F.col("text") != "", F.col("text")).otherwise(F.col("item_id")), ACTION_TITLE)


def actions(sem: DataFrame) -> DataFrame:
    """Action rows: title of at most 96 characters, status, texts and dates."""
    texts = [squash(F.coalesce(c, F.lit(""))).alias(c) for c in ("content", "tracking_result")]
    return sem.select(F.concat(F.lit("action_"), "item_id").alias("action_id"), "item_id", descriptor_title().alias("title"), "status", "status_source", "status_confidence", *texts, "planned_date", "actual_completed_date")


def decisions(sem: DataFrame) -> DataFrame:
    """(decision_id, item_id, title, evidence) of the items that decide something."""
    return sem.where("decided").select(F.concat(F.lit("decision_"), "item_id").alias("decision_id"), "item_id", descriptor_title().alias("title"), F.col("text").alias("evidence"))


def risks(sem: DataFrame) -> DataFrame:
    """(risk_id, item_id, name, evidence, severity) of the items that name a risk."""
    return sem.where("risky").select(F.concat(F.lit("risk_"), "item_id").alias("risk_id"), "item_id", descriptor_title().alias("name"), F.col("text").alias("evidence"), "severity")


def nodes_of(rows: DataFrame, kind: str, key: str, *properties: str) -> DataFrame:
    """(type, id, properties) of rows, one for each key: the smallest set of properties where they differ; null properties are left out."""
    entries = F.filter(F.array(*[F.struct(F.lit(p).alias("key"), F.col(p).cast("string").alias("value")) for p in sorted(properties)]), lambda e: e["value"].isNotNull())
    known = rows.where(strip(F.coalesce(key, F.lit(""))) != "").groupBy(F.col(key).alias("id")).agg(F.min(entries).alias("entries"))
    return known.select(F.lit(kind).alias("type"), "id", F.map_from_entries("entries").alias("properties"))


def build_node_properties(meetings: DataFrame, items: DataFrame, mentions: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Nodes (type, id, properties map) of the whole graph; documents (document_id, original_filename) names the files.

    A date that is both planned and completed is two nodes. A keyword takes the type of its best mention.
    """
    sem = materialize(semantics(items, mentions))
    files = documents if documents is not None else meetings.withColumn("original_filename", F.lit(None).cast("string"))
    named = lambda rows, c: rows.select(F.col(c).alias("name"))
    attended = meetings.select(F.explode_outer(F.concat(F.array("chairperson", "recorder"), F.coalesce("attendees", F.array().cast("array<string>")))).alias("name")).where(has_owner(F.col("name")))
    people = attended.union(sem.select(F.explode_outer("people").alias("name"))).distinct()
    dated = [nodes_of(sem.select(F.col(c).alias("date_value"), F.lit(kind).alias("date_type")), "Date", "date_value", "date_type", "date_value") for c, kind in (("planned_date", "planned"), ("actual_completed_date", "completed"))]
    keywords = mentions.groupBy("name").agg(F.max_by("type", F.struct("score", "type")).alias("type"))
    of_content = mentions.where("owner_type = 'MeetingItem' and field = 'content'")
    parts = [
        nodes_of(files, "Document", "document_id", "document_id", "original_filename"),
        nodes_of(meetings, "Meeting", "meeting_id", "meeting_id", "meeting_name", "meeting_date", "responsible_unit"),
        nodes_of(sem, "MeetingItem", "item_id", "item_id", "item_no", "content", "planned_date", "actual_completed_date", "status", "status_source", "status_confidence"),
        *dated,
        nodes_of(people, "Person", "name", "name"),
        nodes_of(named(meetings, "responsible_unit"), "Unit", "name", "name"),
        nodes_of(keywords, "Keyword", "name", "name", "type"),
        nodes_of(of_content.where("type = 'product'"), "Product", "name", "name"),
        nodes_of(of_content.where("type = 'regulation'"), "Regulation", "name", "name"),
        nodes_of(actions(sem), "ActionItem", "action_id", "action_id", "title", "status", "status_source", "status_confidence", "content", "tracking_result", "planned_date", "actual_completed_date"),
        nodes_of(decisions(sem), "Decision", "decision_id", "decision_id", "title", "evidence"),
        nodes_of(risks(sem), "Risk", "risk_id", "risk_id", "name", "evidence", "severity"),
        nodes_of(sem.select("issue.*"), "Issue", "issue_id", "issue_id", "title", "signature"),
    ]
    return reduce(DataFrame.union, parts)


def mention_edges(mentions: DataFrame) -> DataFrame:
    """MENTIONS edges, one for each owner, keyword and field, with the score and method of the best mention."""
    best = F.max_by(F.struct("score", "method"), F.struct("score", "method"))
    found = mentions.where((strip(F.coalesce("owner_id", F.lit(""))) != "") & (strip(F.coalesce("name", F.lit(""))) != ""))
    one = found.groupBy("owner_type", "owner_id", "name", "field").agg(best.alias("b"))
    return one.select(F.col("owner_type").alias("src_type"), F.col("owner_id").alias("src_id"), F.lit("MENTIONS").alias("relation"), F.lit("Keyword").alias("dst_type"), F.col("name").alias("dst_id"), "field", "b.score", "b.method")


def cooccurrence_edges(mentions: DataFrame) -> DataFrame:
    """CO_OCCURS_WITH edges with their count and weight."""
    return cooccurrence(mentions).select(F.lit("Keyword").alias("src_type"), F.col("left").alias("src_id"), F.lit("CO_OCCURS_WITH").alias("relation"), F.lit("Keyword").alias("dst_type"), F.col("right").alias("dst_id"), "count", "weight")


def build_summary(edges: DataFrame) -> DataFrame:
    """(relation, edges): how many edges of each kind."""
    return edges.groupBy("relation").agg(F.count("*").alias("edges"))
