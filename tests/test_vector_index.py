"""The vector index: recall, exactness, upserts and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from minuteflow.operators import vector_index
from minuteflow.session import fresh_path, table


def brute(stored: dict, queries: dict, k: int) -> dict:
    ids = sorted(stored)
    units = vector_index.unit(np.array([stored[i] for i in ids], dtype=np.float32))
    out = {}
    for q, v in queries.items():
        scores = units @ vector_index.unit(np.array([v], dtype=np.float32))[0]
        best = np.lexsort((np.array(ids), -np.round(scores, 9)))[:k]
        out[q] = [ids[b] for b in best]
    return out


def results(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows, {r["id"]: list(r["vector"]) for r in rows.collect()}


def test_recall_at_ten(spark, embeddings):
    rows, stored = embeddings
    index = vector_index.build(rows, fresh_path(spark))
    queries = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    got, want = results(index.search(queries)), brute(stored, {k: v for k, v in stored.items() if k % 20 == 0}, 10)
    assert set(got) == set(want) and all(len(g) == 10 for g in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want])
    print("recall", recall, "cells", len(index.centroids), "probes", index.probes)
    assert index.probes < len(index.centroids)
    assert recall >= 0.9
    assert results(index.search(queries, exact=True)) == want
    one = results(index.search(queries, probes=len(index.centroids)))
    assert np.mean([len(set(one[q]) & set(want[q])) / 10 for q in want]) >= 0.99
    assert index.blocks(spark).select(F.explode("ids")).count() == len(stored)


def test_small_blocks_and_query_blocks_change_nothing(spark, embeddings, monkeypatch):
    rows, stored = embeddings
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    index = vector_index.build(rows.where("id < 300"), fresh_path(spark), n_cells=5)
    sizes = [r["n"] for r in index.blocks(spark).select(F.size("ids").alias("n")).collect()]
    assert max(sizes) <= 7 and sum(sizes) == 300 and len(sizes) <= 300 / 7 + 5 * 8
    queries = rows.where("id between 280 and 310").withColumnRenamed("id", "query_id")
    want = brute({k: v for k, v in stored.items() if k < 300}, {k: v for k, v in stored.items() if 280 <= k <= 310}, 4)
    assert results(index.search(queries, k=4, exact=True)) == want
    assert results(index.search(queries, k=4, probes=5)) == want


def test_upsert_touches_its_cells_only(spark, embeddings):
    rows, stored = embeddings
    index = vector_index.build(rows.where("id < 400"), fresh_path(spark), n_cells=12)
    before = {r["block"]: (r["cell"], r["ids"]) for r in index.blocks(spark).collect()}
    moved = spark.createDataFrame([(5, stored[399]), (1000, stored[398]), (5, stored[399])], "id bigint, vector array<float>")
    changed = index.upsert(moved)
    after = {r["block"]: (r["cell"], r["ids"]) for r in index.blocks(spark).collect()}
    kept = {b: v for b, v in before.items() if v[0] not in changed}
    assert len(changed) <= 3 and kept and all(after.get(b) == v for b, v in kept.items())
    ids = sorted(i for _, own in after.values() for i in own)
    assert ids == sorted([*range(400), 1000])
    now = {k: v for k, v in stored.items() if k < 400} | {5: stored[399], 1000: stored[398]}
    queries = rows.where("id in (5, 398, 399)").withColumnRenamed("id", "query_id")
    assert results(index.search(queries, k=5, exact=True)) == brute(now, {k: stored[k] for k in (5, 398, 399)}, 5)
    assert index.upsert(moved.limit(0)) == []


def test_a_cell_that_empties_is_gone(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.001 * k]) for k in range(20)] + [(99, [-1.0, 0.0])], "id bigint, vector array<float>")
    index = vector_index.build(rows, fresh_path(spark), n_cells=2)
    assert len(index.upsert(spark.createDataFrame([(99, [1.0, 0.5])], rows.schema))) == 2
    assert index.blocks(spark).select("cell").distinct().count() == 1
    assert index.blocks(spark).select(F.explode("ids")).count() == 21


def test_odd_rows(spark):
    schema = "id string, vector array<float>"
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), (None, [1.0, 1.0]), ("d", [1.0]), ("e", [2.0, 0.0]), ("e", [2.0, 0.0]), ("f", [float("nan"), 1.0]), ("g", [-1.0, 0.0]), ("h", [None, 1.0])], schema)
    index = vector_index.build(rows, fresh_path(spark))
    queries = spark.createDataFrame([("q", [3.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0])], "query_id string, vector array<float>")
    for exact in (True, False):
        got = index.search(queries, probes=9, exact=exact)
        assert results(got) == {"q": ["a", "e", "b", "g"], "z": ["a", "b", "e", "g"]}
        assert [r["id"] for r in index.search(queries, probes=9, exact=exact, threshold=0.7).collect()] == ["a", "e"]
    assert index.search(queries.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_index.build(rows.limit(0), fresh_path(spark))


def test_a_task_gets_one_pair_of_blocks_at_a_time(spark, embeddings, monkeypatch):
    rows = embeddings[0].where("id < 60")
    index = vector_index.build(rows, fresh_path(spark), n_cells=2)
    queries = rows.where("id < 3").withColumnRenamed("id", "query_id")
    found = index.search(queries, k=3, exact=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "MapInPandas" not in plan.replace("FlatMapGroupsInPandas", "")
    monkeypatch.setattr(vector_index, "NEAR", 1)
    assert sorted(map(tuple, index.search(queries, k=3, exact=True).collect())) == sorted(map(tuple, found.collect()))
