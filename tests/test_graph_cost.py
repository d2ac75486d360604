"""The graph's steps shuffle and write no more than they need, and lose nothing by it."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from minuteflow.functions import text
from minuteflow.functions.extract import HANDLED_BY, OWNER_CHANGED, people_from_text
from minuteflow.operators import graph_build, graph_query, graph_store, graph_view
from minuteflow.plans import queries
from minuteflow.session import fresh_path, materialize, shared_dir

ITEMS = "item_id string, meeting_id string, item_no string, content string, owner string, planned_date string, actual_completed_date string, tracking_result string"
MEETINGS = "meeting_id string, document_id string, meeting_name string, meeting_date string, responsible_unit string, chairperson string, recorder string, attendees array<string>"
MENTIONS = "owner_type string, owner_id string, field string, name string, type string, score double, method string"


def tables(spark, repeat=False):
    rows = [("a", "1", "01", "red ring approved", "Ann", "2000-01-01", "--", None), ("b", "1", "02", "blue bolt", "--", None, None, "done")]
    items = spark.createDataFrame(rows + rows[:1] * repeat, ITEMS)
    meetings = spark.createDataFrame([("1", "d", "one", "2000-01-01", "U", "Ann", "Bob", ["Ann"])], MEETINGS)
    said = [("MeetingItem", i, "content", n, t, s, "regex") for i, n, t, s in (("a", "red ring", "product", 0.7), ("a", "FDA", "regulation", 0.6), ("a", "red ring", "product", 0.7), ("b", "blue bolt", "product", 0.7), ("b", None, "product", 0.7))]
    return meetings, items, spark.createDataFrame(said, MENTIONS)


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def stored(spark):
    path = os.path.join(shared_dir(spark), "minuteflow")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


def test_names_of_an_item_meet_without_a_join(spark):
    co = graph_build.cooccurrence(tables(spark)[2])
    assert "Join" not in plan(co)
    assert sorted(map(tuple, co.collect())) == [("FDA", "red ring", 1, 1.0), ("red ring", "FDA", 1, 1.0)]
    near = graph_query.related_keywords(co, "fda")
    assert "Union" not in plan(near) and [tuple(r) for r in near.collect()] == [("red ring", 1.0, 1)]


def test_edges_of_a_question_are_not_stored(spark):
    before = stored(spark)
    lazy = graph_build.build_edges(*tables(spark), store=False)
    assert stored(spark) == before
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, graph_build.build_edges(*tables(spark)).collect()))


def test_edges_of_items_are_distinct_and_need_no_aggregate(spark):
    relations = ("HAS_ACTION", "RESPONSIBLE_BY", "ASSIGNED_TO", "TARGETS_PRODUCT", "TRACKS_ISSUE")
    once, twice = (graph_build.build_edges(*tables(spark, repeat), relations) for repeat in (False, True))
    assert "Aggregate" not in plan(once) and "Aggregate" in plan(twice)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_edges_of_no_items(spark):
    meetings, items, mentions = tables(spark)
    assert graph_build.build_edges(meetings, items.where("false"), mentions.where("false"), ("HAS_ACTION", "TRACKS_ISSUE")).count() == 0


def test_nodes_come_of_one_pass_over_the_edges(spark):
    edges = graph_build.build_edges(*tables(spark), ("HAS_MEETING",))
    assert "Union" not in plan(graph_build.build_nodes(edges))
    assert sorted(map(tuple, graph_build.build_nodes(edges).collect())) == [("Document", "d"), ("Meeting", "1")]


def test_plain_texts_are_squashed_like_others(spark):
    texts = ["", " a  b ", "a\tb", "a b", "Brand#21 x_y-z", "é  É", "a b", "\x7fa b", "由王五負責", "Owner CHANGED to Ann; x", "一　二, 三!", None, "~`^[]\\{}|\"'"]
    c = F.col("t")
    squashed = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    signed = F.regexp_replace(F.regexp_replace(F.lower(text.strip(c)), r"(?U)\s+", " "), rf"(?U)[^\w{text.CJK} ]+", "")
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.squash(c), squashed, text.normalize_signature(c), signed, people_from_text(c)).collect()
    for t, a, b, s, u, people in found:
        assert (a, s) == (b, u), t
        assert bool(people) == bool(t and (re.search(OWNER_CHANGED, t) or re.search(HANDLED_BY, t))), t


def test_expansion_needs_no_status(spark):
    meetings, items, mentions = tables(spark)
    edges = graph_build.build_edges(meetings, items, mentions, ("HAS_ACTION", "TRACKS_ISSUE"))
    titled = graph_build.described(items, mentions).select("item_id", "text", "issue", "decided", "risky")
    nodes = spark.createDataFrame([("ActionItem:action_b",)], "node_id string")
    assert [r["action"] for r in graph_view.expand_nodes(nodes, edges, meetings, items, titled).collect()] == ["blue bolt done"]


def with_mentions(items, mentions):
    said = mentions.where("owner_type = 'MeetingItem'").groupBy(F.col("owner_id").alias("item_id")).agg(F.collect_list(F.struct("field", "name", "type", "score")).alias("mentions"))
    return items.join(said, "item_id", "left")


def test_an_items_row_tells_its_edges(spark):
    for repeat in (False, True):
        meetings, items, mentions = tables(spark, repeat)
        relations = graph_build.OF_ROWS
        rows = graph_build.row_edges(with_mentions(items, mentions), relations)
        own = graph_build.build_edges(meetings, items, mentions.where("owner_type = 'MeetingItem'"), relations)
        # The general way meets a repeated item once for each of its rows.
        assert sorted(map(tuple, rows.collect())) == sorted(set(map(tuple, graph_store.owned(own, items).collect())))
        co = graph_build.row_cooccurrence(with_mentions(items, mentions))
        assert sorted(map(tuple, co.collect())) == sorted(map(tuple, graph_build.cooccurrence(mentions).collect()))


def test_edges_of_rows_need_no_join(spark):
    items = tables(spark)[1].withColumn("mentions", F.array(F.struct(F.lit("content").alias("field"), F.lit("a b").alias("name"), F.lit("product").alias("type"), F.lit(0.7).alias("score"))))
    made = plan(graph_build.row_edges(items, graph_build.OF_ROWS))
    assert "Join" not in made and "Exchange" not in made and "Aggregate" not in made and "Union" not in made


def test_replaced_meetings_are_told_without_another_table(spark, monkeypatch):
    edge = "src_type string, src_id string, relation string, dst_type string, dst_id string, meeting_id string"
    rows = [("Meeting", f"m{k}", "HAS_ITEM", "MeetingItem", f"m{k}-1", f"m{k}") for k in range(200)]
    path, written = fresh_path(spark), []
    graph_store.write_graph(spark.createDataFrame(rows, edge), path, 8)
    monkeypatch.setattr(graph_store, "materialize", lambda df: written.append(df) or materialize(df))
    # One bit for all: every stored row is doubtful, and the exact way keeps what isn't named.
    for bits, named in ((graph_store.BITS, "m3"), (1, "m4")):
        monkeypatch.setattr(graph_store, "BITS", bits)
        graph_store.replace_meetings(spark, path, spark.createDataFrame([(named,)], "meeting_id string"), spark.createDataFrame([], edge), 8)
    assert len(written) == 4
    assert sorted(map(tuple, graph_store.read_graph(spark, path).select(*edge.replace(" string", "").split(", ")).collect())) == sorted(r for r in rows if r[-1] not in ("m3", "m4"))


def test_items_that_cannot_match_are_left_out_first(spark):
    meetings, items, mentions = tables(spark)
    more = spark.createDataFrame([("c", "1", "03", "owner changed to Annabel; x", "Bob", None, None, None), ("d", "1", "04", None, None, None, None, None)], ITEMS)
    items = items.union(more)
    mentions = mentions.union(spark.createDataFrame([("MeetingItem", "c", "tracking_result", "fda", "regulation", 0.6, "regex"), ("MeetingItem", "c", "content", "Red Ring", "product", 0.6, "regex")], MENTIONS))
    relations = ("HAS_ACTION", "RESPONSIBLE_BY", "ASSIGNED_TO", "MENTIONS_PRODUCT", "TARGETS_PRODUCT", "MENTIONS_REGULATION", "CONSTRAINED_BY", "MENTIONS")

    def found(rows, constraints):
        said = mentions.join(rows.select(F.col("item_id").alias("owner_id")), "owner_id", "left_semi").select(*mentions.columns)
        edges = graph_build.build_edges(meetings, rows, said, relations)
        return sorted(map(tuple, graph_query.composite(edges, meetings, graph_build.semantics(rows, said), "action_items", constraints, None).collect()))

    for constraints, left in (({"person_name": "ann"}, "ac"), ({"product_name": "red ring"}, "ac"), ({"regulation_name": "FDA"}, "ac"), ({"person_name": "annabel", "regulation_name": "FDA"}, "c"), ({"keyword": "blue"}, "abcd")):
        near = graph_query.may_match(with_mentions(items, mentions), constraints).select(*items.columns)
        assert sorted(r["item_id"] for r in near.collect()) == list(left)
        assert found(near, constraints) == found(items, constraints) != []


def test_a_question_on_a_person_makes_edges_of_its_items_only(spark):
    meetings, items, _ = tables(spark)
    edges, sem = queries._graph_of(meetings, items.withColumns({"product": F.lit("red ring"), "regulation": F.lit("FDA")}), {"person_name": "ANN"}, "HAS_ACTION", "RESPONSIBLE_BY")
    assert sorted((r["src_id"], r["dst_id"]) for r in edges.collect()) == [("a", "Ann"), ("a", "action_a")]
    assert [r["item_id"] for r in sem.collect()] == ["a"]


def test_semantics_shuffle_nothing(spark):
    """Items hold their mentions in their rows; the semantics equal those of mentions that are joined."""
    d = "/root/testdata/sf0.001"
    told = queries.semantics(spark, d)
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()
    joined = graph_build.semantics(queries.I(spark, d), queries.mentions(spark, d)).select(*told.columns)
    assert told.exceptAll(joined).isEmpty() and joined.exceptAll(told).isEmpty()
