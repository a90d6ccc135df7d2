"""Vector search by blocks against one plain search, with ties, bad vectors and small blocks."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import retrieval


def plain(questions, vectors, k):
    """query_id, vec_id and rank by sorting all distances of each question."""
    out = set()
    for query_id, q, group in questions:
        if q is None or not np.isfinite(q).all() or not np.any(q):
            continue
        found = []
        for vec_id, v, own in vectors:
            if own == group and group is not None and v is not None and len(v) == len(q) and all(x is not None and np.isfinite(x) for x in v) and any(v):
                a, b = np.array(q), np.array(v)
                found.append((1 - (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), vec_id))
        out |= {(query_id, vec_id, rank) for rank, (_, vec_id) in enumerate(sorted(found)[:k], 1)}
    return out


def made(rng, n, groups):
    vectors = [(i, np.round(rng.normal(size=4) * 2).tolist(), groups[int(rng.integers(len(groups)))]) for i in range(n)]
    bad = [(n, None, "a"), (n + 1, [0.0] * 4, "a"), (n + 2, [1.0, 2.0], "a"), (n + 3, [None, 1.0, 1.0, 1.0], "a"), (n + 4, [float("nan")] * 4, "a"), (n + 5, [1.0] * 4, None)]
    return vectors + bad


@pytest.mark.parametrize("block_bytes", [2 << 20, 700])
def test_blocks_find_what_a_plain_search_finds(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(retrieval, "TILE", 64)
    vectors = made(np.random.default_rng(1), 300, ["a", "a", "a", "b", "c"])
    questions = [r for r in vectors if r[0] % 7 == 0 or r[0] >= 300]
    q = spark.createDataFrame(questions, "query_id long, query array<double>, g string")
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, g string")
    found = {(r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.top_k(q, v, 5, "g").collect()}
    assert found == plain([x for x in questions if x[1] and None not in x[1]], vectors, 5)
    one = [(i, x, "all") for i, x, _ in vectors]
    found = {(r["query_id"], r["vec_id"], r["rank"]) for r in retrieval.top_k(q.drop("g"), v.drop("g"), 400).collect()}
    assert found == plain([(i, x, "all") for i, x, _ in questions if x and None not in x], one, 400)


def test_no_broadcast_and_no_cross_join(spark):
    v = spark.range(100).selectExpr("id AS vec_id", "array(1.0D + id, 2.0D) AS embedding", "id % 3 AS g")
    q = v.selectExpr("vec_id AS query_id", "embedding AS query", "g")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (retrieval.top_k(q, v, 2, "g"), retrieval.top_k(q.drop("g"), v.drop("g"), 2)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_company_retriever_takes_null_for_the_entries_of_no_company(spark):
    store = spark.createDataFrame([(1, "A", [1.0, 0.0], "x"), (2, None, [1.0, 0.1], "y"), (3, "B", [1.0, 0.0], "z"), (4, None, [0.0, 1.0], "w")], "vec_id long, company_id string, embedding array<double>, source string")
    asked = spark.createDataFrame([(10, "A", [1.0, 0.0]), (11, None, [1.0, 0.0]), (12, "C", [1.0, 0.0])], "query_id long, company_id string, query array<double>")
    rows = retrieval.company_retriever(asked, store, 1).collect()
    assert {(r["query_id"], r["vec_id"], r["source"], r["rank"]) for r in rows} == {(10, 1, "x", 1), (11, 2, "y", 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert retrieval.top_k(none.toDF("query_id", "query"), some, 3).collect() == []
    assert retrieval.top_k(some.toDF("query_id", "query"), none, 3).collect() == []
