"""Node expansion by scope, and result rows and paths as nodes and edges."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from minuteflow.operators import graph_build, graph_view
from minuteflow.session import materialize


@pytest.fixture(scope="module")
def world(spark):
    meetings = spark.createDataFrame(
        [("m1", "d", "FDA review", "2018-04-03", "QA", "Carol", "Dan", ["Eve"]), ("m2", "d", None, None, "QA", "Carol", "Dan", None)],
        "meeting_id string, document_id string, meeting_name string, meeting_date string, responsible_unit string, chairperson string, recorder string, attendees array<string>",
    )
    items = spark.createDataFrame(
        [(f"i{k}", "m1" if k < 4 else "m2", f"{k:02d}", f"Check {k} approved critical risk", "Carol" if k % 2 else "--", "2018-05-01", "2018-05-02" if k == 1 else None, None) for k in range(1, 6)],
        "item_id string, meeting_id string, item_no string, content string, owner string, planned_date string, actual_completed_date string, tracking_result string",
    )
    said = [("MeetingItem", f"i{k}", "content", n, t, 0.7, "x") for k in range(1, 6) for n, t in (("Red stem", "product"), ("FDA", "regulation"))]
    mentions = spark.createDataFrame(said, "owner_type string, owner_id string, field string, name string, type string, score double, method string")
    # Written tables keep plans short.
    meetings, items, mentions = map(materialize, (meetings, items, mentions))
    return materialize(graph_build.build_edges(meetings, items, mentions)), meetings, items, materialize(graph_build.semantics(items, mentions))


def expanded(spark, world, *ids, limit=10, scope="default"):
    nodes = spark.createDataFrame([(i,) for i in ids], "node_id string")
    return nodes, graph_view.expand_nodes(nodes, *world, limit=limit, scope=scope)


EVERY = [
    ("Product:red STEM", ["i4", "i5", "i1", "i2", "i3"], "product", "Red stem"),
    ("Regulation:fda", ["i4", "i5", "i1", "i2", "i3"], "regulation", "FDA"),
    ("Keyword:FDA", ["i4", "i5", "i1", "i2", "i3"], "keyword", "FDA"),
    ("Person:carol", ["i5", "i1", "i3"], "person_relation", "RESPONSIBLE_BY"),
    ("Date:2018-05-02", ["i1"], "date_relation", "HAS_COMPLETED_DATE"),
    ("Meeting:M1", ["i1", "i2", "i3"], "product", None),
    ("Meeting:fda REVIEW", ["i1", "i2", "i3"], "product", None),
    ("MeetingItem:I2", ["i2"], "people", None),
    ("ActionItem:action_i2", ["i2"], "action", "Check 2 approved critical risk"),
    ("ActionItem:check 2 APPROVED critical risk", ["i2"], "action", "Check 2 approved critical risk"),
    ("Decision:decision_i3", ["i3"], "decision", "Check 3 approved critical risk"),
    ("Risk:risk_i3", ["i3"], "risk", "Check 3 approved critical risk"),
    ("Issue:red stem / fda", ["i4", "i5", "i1", "i2", "i3"], "issue", "Red stem / FDA"),
    ("Unit:qa", [None, None], "unit", "QA"),
]


@pytest.fixture(scope="module")
def around(spark, world):
    found = {}
    for r in expanded(spark, world, *[e[0] for e in EVERY])[1].orderBy("seq").collect():
        found.setdefault(r["node_id"], []).append(r)
    return found


@pytest.mark.parametrize("case", EVERY, ids=lambda e: e[0])
def test_every_type_of_node(around, case):
    node, items, column, value = case
    rows = around[node]
    assert [r["item_id"] for r in rows] == items
    assert rows[0][column] == value if value is not None else not rows[0][column]
    assert all(r["meeting_id"] for r in rows)


def test_scopes_of_an_item(spark, world):
    nodes = spark.createDataFrame([("MeetingItem:i1", scope.upper() + " ") for scope in (*graph_view.SCOPES, "odd")], "node_id string, scope string")
    shown = {r["scope"]: {c: r[c] for c, *_ in graph_view.ITEM_LISTS if r[c]} for r in graph_view.expand_nodes(nodes, *world).collect()}
    title = "Check 1 approved critical risk"
    everything = {"people": ["Carol"], "planned_dates": ["2018-05-01"], "completed_dates": ["2018-05-02"], "products": ["Red stem"], "regulations": ["FDA"], "keywords": ["FDA", "Red stem"], "actions": [title], "decisions": [title], "risks": [title], "issues": ["Red stem / FDA"]}
    groups = {"default": (), "meeting": (), "owner": ("people",), "dates": ("planned_dates", "completed_dates"), "product_regulation": ("products", "regulations"), "keyword": ("keywords",), "semantic": ("actions", "decisions", "risks", "issues"), "all": tuple(everything)}
    assert shown == {scope: {c: everything[c] for c in columns} for scope, columns in groups.items()}


def test_limits_and_warnings(spark, world):
    nodes, rows = expanded(spark, world, "Product:Red stem", "Person:Carol", "Person:Nobody", "Planet:Mars", "nothing", "Product:", None, limit=3)
    assert {r["node_id"]: r["n"] for r in rows.groupBy("node_id").agg(F.count("*").alias("n")).collect()} == {"Product:Red stem": 3, "Person:Carol": 3}
    said = {r["node_id"]: r["warning"] for r in graph_view.expansion_warnings(nodes, rows, 3).collect()}
    assert said == {
        "Product:Red stem": "Expansion limited to 3 relations.", "Person:Carol": "Expansion limited to 3 relations.", "Person:Nobody": "No expandable relationships found for this node.",
        "Planet:Mars": "Node type 'Planet' cannot be expanded.", "nothing": "node_id must use '<Type>:<value>' format.", "Product:": "node_id must use '<Type>:<value>' format.", None: "node_id must use '<Type>:<value>' format.",
    }
    assert [graph_view.limit_of(x) for x in (None, "7", 0, 99, "x")] == [20, 7, 1, 50, 20]


def test_rows_make_nodes_and_edges(spark):
    rows = spark.createDataFrame([(1, "m1", "FDA meeting", "i1", "01", "Conformity stem", "FDA", ["Carol", "", "Carol"], 3), (2, "m1", "later name", None, None, "Cup", None, None, None)], "seq int, meeting_id string, meeting_name string, item_id string, item_no string, product string, regulation string, people array<string>, item_count int")
    nodes, edges = graph_view.row_graph(rows)
    found = {r["id"]: (r["label"], r["title"]) for r in nodes.collect()}
    assert found == {
        "Meeting:m1": ("FDA meeting", "FDA meeting"), "MeetingItem:i1": ("01", "i1"), "Product:Conformity stem": ("Conformity stem", "Conformity stem (item_count: 3)"),
        "Regulation:FDA": ("FDA", "FDA (item_count: 3)"), "Person:Carol": ("Carol", "Carol (item_count: 3)"), "Product:Cup": ("Cup", "Cup"),
    }
    assert {r["id"] for r in edges.collect()} == {
        "Meeting:m1->HAS_ITEM->MeetingItem:i1", "MeetingItem:i1->MENTIONS_PRODUCT->Product:Conformity stem", "MeetingItem:i1->MENTIONS_REGULATION->Regulation:FDA", "Product:Conformity stem->CO_MENTIONED_WITH->Regulation:FDA",
        "MeetingItem:i1->RESPONSIBLE_BY->Person:Carol", "Person:Carol->ASSOCIATED_WITH->Product:Conformity stem", "Meeting:m1->MENTIONS_PRODUCT->Product:Cup",
    }


def test_paths_make_nodes_and_edges(spark):
    path = {
        "nodes": [
            {"_type": "Node", "_labels": ["Odd", "Meeting"], "_element_id": "4:1", "meeting_id": "m1", "meeting_name": "Review"},
            {"_type": "Node", "_labels": ["MeetingItem"], "_element_id": "4:2", "item_id": "i1", "item_no": "01", "content": "Check"},
            {"_type": "Node", "_labels": ["Product"], "_element_id": "4:3", "name": "stem"},
            {"_type": "Node", "_labels": ["Odd"], "_element_id": "4:4", "name": "x"},
            {"_type": "Node", "_labels": ["Risk"], "_element_id": "4:5", "risk_id": "", "name": "Late"},
            {"_type": "Node", "_labels": ["Unit"], "_element_id": "4:6"},
        ],
        "relationships": [{"_relationship_type": "HAS_ITEM", "_source_index": 0, "_target_index": 1}, {"_relationship_type": "MENTIONS_PRODUCT"}, {"_relationship_type": "LOST", "_source_index": 0, "_target_index": 3}, {"_relationship_type": "FAR", "_source_index": 0, "_target_index": 9}, {"_relationship_type": ""}, {"_relationship_type": "NEAR"}],
    }
    text = spark.createDataFrame([(1, json.dumps([path, path])), (2, None)], "seq int, text string")
    rows = text.select("seq", F.from_json("text", graph_view.PATHS).alias("paths"))
    nodes, edges = graph_view.row_graph(rows)
    assert {r["id"]: (r["type"], r["label"], r["title"]) for r in nodes.collect()} == {
        "Meeting:m1": ("Meeting", "Review", "Review"), "MeetingItem:i1": ("MeetingItem", "01", "Check"), "Product:stem": ("Product", "stem", "stem"), "Risk:Late": ("Risk", "Late", "Late"), "Unit:4:6": ("Unit", "4:6", "4:6"),
    }
    assert {(r["source"], r["label"], r["target"]) for r in edges.collect()} == {("Meeting:m1", "HAS_ITEM", "MeetingItem:i1"), ("MeetingItem:i1", "MENTIONS_PRODUCT", "Product:stem")}
    assert graph_view.path_count(rows).first()["paths"] == 2


def test_isolated_nodes_are_expanded(spark, world):
    rows = spark.createDataFrame([(1, "Red stem", None), (2, None, "m9")], "seq int, product string, meeting_id string")
    graph = graph_view.row_graph(rows)
    assert graph[1].count() == 0 and {r["id"] for r in graph[0].collect()} == {"Product:Red stem", "Meeting:m9"}
    nodes, edges = graph_view.expand_isolated(graph, *world, limit=2)
    assert {r["id"] for r in nodes.collect()} == {"Product:Red stem", "Meeting:m9", "Meeting:m2", "MeetingItem:i4", "MeetingItem:i5"}
    assert {r["label"] for r in edges.collect()} == {"HAS_ITEM", "MENTIONS_PRODUCT"} and edges.count() == 4


def test_edge_ids_are_not_shuffled(spark):
    """The id of an edge repeats its ends, so it is made after equal edges have met."""
    rows = spark.createDataFrame([("m", "i", 1), ("m", "i", 2)], "meeting_id string, item_id string, seq int")
    linked = graph_view.row_graph(rows)[1]
    assert [tuple(r) for r in linked.collect()] == [("Meeting:m->HAS_ITEM->MeetingItem:i", "Meeting:m", "MeetingItem:i", "HAS_ITEM")]
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [source#" in plan and "Aggregate [id#" not in plan
