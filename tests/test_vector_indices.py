"""Approximate vector search against exact search: recall, full products, pruned lists, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from docweft.operators import vector_graph, vector_lists, vectors


def _frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = _unit(rng.normal(size=(40, 24)))
    x = _unit(centres[rng.integers(0, 40, 2000)] + 0.08 * rng.normal(size=(2000, 24)))
    return _frame(spark, x).cache()


def _exact(v, q, k=10):
    return {(r.query_id, r.vec_id) for r in vectors.top_k(v, "vec_id", q, "query_id", k).collect()}


def _asked(v):
    return v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


def test_lists_prune_and_reach_their_recall(spark, clustered):
    q, index = _asked(clustered), vector_lists.build(clustered, "vec_id")
    found = vector_lists.search(index, "vec_id", q, "query_id", share=0.15, rescored=60)
    wanted = _exact(clustered, q)
    assert len(wanted & {(r.query_id, r.vec_id) for r in found.collect()}) >= 0.9 * len(wanted)
    cost = vector_lists.work(index, q, "query_id", share=0.15, rescored=60).groupBy().avg("codes", "products", "bytes").first()
    assert cost[0] < 0.3 * 2000 and cost[1] <= 60 and cost[2] == cost[0] * 24
    one = vector_lists.search(index, "vec_id", q.filter("query_id = 0"), "query_id", share=0.05)
    assert one.count() == 10
    read = index.table.filter(index.table.list_id.isin([3, 5])).select("key", "code")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan and "ReadSchema: struct<key:bigint,code:binary>" in plan
    assert {f.split("list_id=")[1].split("/")[0] for f in read.inputFiles()} <= {str(i) for i in index.sizes}
    assert sum(index.sizes.values()) == 2000


def test_codes_stand_for_their_vectors():
    x = np.random.default_rng(2).normal(size=(600, 10))
    q = vector_lists.Quantiser.fit(x, 8, 4)
    at, codes = q.encode(x)
    assert codes.shape == (600, 4) and ((q.decode(at, codes) - x) ** 2).sum() < 0.2 * (x**2).sum()


def test_graph_reaches_its_recall_with_few_products(spark, clustered):
    q, graph = _asked(clustered), vector_graph.build(clustered, "vec_id")
    found, cost = vector_graph.search(graph, "vec_id", q, "query_id", beam=32, rescored=60)
    wanted = _exact(clustered, q)
    assert len(wanted & {(r.query_id, r.vec_id) for r in found.collect()}) >= 0.9 * len(wanted)
    spent = cost.groupBy().avg("codes", "products").first()
    assert cost.count() == 100 and spent[1] <= 60 and spent[0] < 0.2 * 2000
    # the graph itself: nearest neighbours of nodes, and the products that it took
    x = np.array([r.embedding for r in clustered.orderBy("vec_id").collect()])
    near = x @ x.T
    np.fill_diagonal(near, -2)
    true = {(i, int(j)) for i, row in enumerate(np.argsort(-near, 1)[:, :8]) for j in row}
    held = {(r.node, j) for r in graph.neighbours.collect() for j in r.others}
    assert len(true & held) >= 0.9 * len(true) and graph.built_with < 2000 * 2000 / 2


def test_equal_null_and_no_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(_unit(rng.normal(size=(1, 8))), (60, 1)), _unit(rng.normal(size=(80, 8)))])
    rows = _frame(spark, x).union(spark.createDataFrame([(900, None)], "vec_id long, embedding array<float>"))
    q = rows.filter("vec_id in (0, 70, 139, 900)").withColumnRenamed("vec_id", "query_id")
    wanted = _exact(rows, q)
    graph, index = vector_graph.build(rows, "vec_id"), vector_lists.build(rows, "vec_id")
    assert {(r.query_id, r.vec_id) for r in vector_graph.search(graph, "vec_id", q, "query_id")[0].collect()} == wanted
    assert {(r.query_id, r.vec_id) for r in vector_lists.search(index, "vec_id", q, "query_id", share=1.0).collect()} == wanted
    none = rows.limit(0)
    assert vector_lists.search(vector_lists.build(none, "vec_id"), "vec_id", q, "query_id").count() == 0
    assert vector_graph.search(vector_graph.build(none, "vec_id"), "vec_id", q, "query_id")[0].count() == 0
    assert vector_lists.search(index, "vec_id", q.limit(0), "query_id").count() == 0


def test_a_table_written_anew_is_read_anew(spark, tmp_path):
    from docweft.queries.base import Tables

    def once(text):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return {r.term for r in Tables(spark, str(tmp_path)).index().postings.collect()}

    assert once("momentum") == {"momentum"} and once("entropy") == {"entropy"}
