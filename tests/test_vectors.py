"""Dense searches by blocks: what is told pair by pair, for a small part of the rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gneiss.operators import retrieval, vectors
from gneiss.plans import registry


def _table(spark, n=700):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.25, 0.0005, 1.0, r.uniform(-1, 1)]) for _ in range(8)], i % 7) for i in range(n)]
    rows += [(n + i, rows[3][1], 3) for i in range(400)]  # copies
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [], None), (2003, [float("inf"), float("-inf"), 0.0], 2), (2004, [1.0], 99), (2100, [2.0, 1.0, 3.0], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _told(df):
    return sorted(map(repr, df.collect()))


def test_blocks_find_what_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_VECTORS", 64)
    monkeypatch.setattr(vectors, "_QUERIES", 16)
    monkeypatch.setattr(vectors, "_IN_TASK", 200)
    monkeypatch.setattr(vectors, "_ASKED", 20)
    e = _table(spark).localCheckpoint()
    asked = e.filter("vec_id % 50 = 0 or vec_id > 1990").withColumnRenamed("vec_id", "query_id")
    every = retrieval.dense(e, asked.select("query_id", "embedding")).localCheckpoint()
    got = vectors.best(e, asked, 10).localCheckpoint()
    assert _told(retrieval.top(got, 10)) == _told(retrieval.top(every, 10)) and got.count() < every.count() / 2
    assert not retrieval.top(got, 10).filter("score is null").isEmpty()
    # ranks by what the order by says: not-a-numbers first, nulls last, then the smaller id
    others = every.filter("query_id <> doc_id").withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, doc_id)"))
    names = e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b"))
    right = others.join(asked.select("query_id", F.col("label").alias("a")), "query_id").join(names, "doc_id").filter("a = b").groupBy("query_id").agg(F.min("rank").cast("int").alias("rank"))
    assert _told(vectors.first_right(e, asked)) == _told(asked.select("query_id").join(right, "query_id", "left"))


def test_ranks_are_those_of_whole_rankings(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_VECTORS", 64)
    monkeypatch.setattr(vectors, "_QUERIES", 16)
    e = _table(spark).localCheckpoint()
    asked = e.filter("vec_id % 50 = 0 or vec_id > 1990").select(F.col("vec_id").alias("query_id"), "embedding")
    every = retrieval.dense(e, asked).localCheckpoint()
    ranked = every.withColumn("rank", F.expr("cast(row_number() over (partition by query_id order by score desc, doc_id) as int)")).filter("doc_id % 9 = 0 or doc_id > 1990")
    assert _told(vectors.ranks(e, asked, ranked.select("query_id", "doc_id", "score"))) == _told(ranked.select("query_id", "doc_id", "rank"))


def test_fusion_keeps_no_pair_of_a_vector(spark, monkeypatch):
    """the dense scores of all pairs were kept in a table and sorted by query."""
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda df, name, f=retrieval.stored: kept.append(name) or f(df, name))
    monkeypatch.setattr(retrieval, "dense", None)
    assert registry.rrf_hybrid(spark, "/root/testdata/sf0.001").count() > 0
    assert "semantic" not in kept


def test_rounds_as_spark_rounds(spark):
    import numpy as np

    r = random.Random(1)
    xs = [k / 10**7 for k in (5, 15, 25, -5, -15, 1234565, -1234565, 1234575)] + [0.0, -0.0, -1e-9, 1e300, -7.5e15, 123456789.0000005, float("inf"), float("nan")]
    xs += [r.uniform(-1, 1) * 10 ** r.randrange(-8, 12) for _ in range(2000)] + [round(r.uniform(-50, 50), 6) + 5e-7 for _ in range(500)]
    want = [x.y for x in spark.createDataFrame([(x,) for x in xs], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert list(map(repr, vectors.rounded(np.array([xs]))[0].tolist())) == list(map(repr, want))


def test_no_row_for_a_pair(spark):
    """every pair of a query and a vector was a row, told by interpreted lambdas and sorted by query."""
    for query in (registry.dense_topk, registry.ir_metrics):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "zip_with" not in plan and "MapInArrow" in plan and "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan
