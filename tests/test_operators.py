from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions.text import coverage, described, tokens
from gneiss.operators import evaluate, graph, retrieval


def test_tokens(spark):
    df = spark.createDataFrame([("The CUSTOMERS' payments, 30 days a b",), ("",)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["customer", "payment", "30", "day"], []]


def test_coverage_of_nothing_is_zero(spark):
    df = spark.sql("select array() a, array('x') b, array('x', 'y', 'x') c")
    a, b, c = F.col("a").cast("array<string>"), F.col("b"), F.col("c")
    assert df.select(coverage(a, b), coverage(c, b), coverage(b, c)).first() == (0.0, 0.5, 1.0)


def test_described(spark):
    df = spark.createDataFrame([("PERFORM  check of WS-late-fee.",)], "t string")
    assert df.select(described(F.col("t"))).first()[0] == "The implemented regulatory rule requires the system to execute check of late fee."


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma delta"), (3, "beta gamma")], "doc_id long, text string")
    once = spark.createDataFrame([(1, "gamma")], "query_id long, text string")
    twice = spark.createDataFrame([(1, "gamma gamma")], "query_id long, text string")
    one = {r.doc_id: r.score for r in retrieval.bm25(docs, once).collect()}
    two = {r.doc_id: r.score for r in retrieval.bm25(docs, twice).collect()}
    assert set(one) == {2, 3} and one[2] > one[3]
    assert all(two[k] == pytest.approx(2 * one[k], abs=2e-6) for k in one)


def test_top_breaks_ties_by_id(spark):
    scores = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.7)], "query_id long, doc_id long, score double")
    assert [(r.doc_id, r["rank"]) for r in retrieval.top(scores, 2).orderBy("rank").collect()] == [(4, 1), (3, 2)]


def test_anchored_keeps_first_rank_and_best_score(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.2), (1, "b", 2, 0.9), (1, "a", 3, 0.8), (1, None, 4, 0.9)], "query_id long, anchor string, rank int, score double")
    assert [(r.anchor, r.best_score) for r in retrieval.anchored(hits, 5).orderBy("place").collect()] == [("a", 0.8), ("b", 0.9)]


def test_reach_on_a_cycle_and_dead_nodes(spark):
    edges = spark.createDataFrame([("a", "b", "call"), ("b", "c", "call"), ("c", "a", "call"), ("x", "y", "call")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([("p", n, i) for i, n in enumerate("abcxy")], "program string, node string, ord int")
    seeds = spark.createDataFrame([("a",), ("unknown",)], "node string")
    assert {r.node: r.depth for r in graph.depths(edges, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "unknown": 0}
    assert {r.node for r in graph.dead(nodes, edges, seeds).collect()} == {"x", "y"}
    assert {r.node for r in graph.forest_roots(nodes, edges).collect()} == {"x"}


def test_fallthrough_stops_at_a_transfer(spark):
    nodes = spark.createDataFrame([("p", 1, "a", False), ("p", 2, "b", True), ("p", 3, "c", False)], "program string, ord int, node string, transfers boolean")
    assert [(r.src, r.dst) for r in graph.fallthrough(nodes).collect()] == [("a", "b")]


def test_detection_counts_abstention_as_a_miss_only_if_gold(spark):
    rows = [(True, True, False), (True, False, True), (False, True, True), (False, False, False)]
    r = evaluate.detection(spark.createDataFrame(rows, "gold boolean, predicted boolean, abstained boolean")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.answered, r.precision, r.recall) == (1, 0, 1, 1, 2, 1.0, 0.5)


def test_empty_detection_is_zero(spark):
    r = evaluate.detection(spark.createDataFrame([(False, False, False)], "gold boolean, predicted boolean, abstained boolean")).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_auc_with_ties_and_one_class(spark):
    rows = [(True, 1), (True, 2), (False, 1), (False, 0)]
    assert evaluate.auc(spark.createDataFrame(rows, "positive boolean, v int"), "v").first().auc == 0.875
    assert evaluate.auc(spark.createDataFrame([(True, 1)], "positive boolean, v int"), "v").first().auc == 0.5


def test_versioned_needs_exactly_two(spark):
    rows = [("l", "1", "a", True), ("l", "2", "b", True), ("m", "1", "a", True), ("m", "2", "a", True)]
    assert [r.locus for r in evaluate.versioned(spark.createDataFrame(rows, "locus string, version string, verdict string, correct boolean")).collect()] == ["l"]


def test_exact_interval():
    low, high = evaluate.exact_interval(15, 15)
    assert low == pytest.approx(0.782, abs=1e-3) and high == 1.0
    assert evaluate.exact_interval(0, 10)[0] == 0.0


def test_entry_imports_and_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_resampling_makes_the_draws_of_the_reference(spark, tmp_path):
    from gneiss.plans import registry

    rnd = random.Random(4)
    rows = [(i, *rnd.choice([(0, 0), (1, 0), (1, 0), (1, 1)])) for i in range(400)] + [(900, None, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert registry.queries()["randomization_p"](spark, str(tmp_path)).first().p == round(1 / 20_001, 6)
    deltas = [q - t for _, q, t in rows if q is not None]
    pairs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(deltas)], "id long, delta double")
    means = [r["mean"] for r in evaluate.resampled(pairs, 10_000, 4405).collect()]
    mean = sum(deltas) / 400
    spread = (sum((x - mean) ** 2 for x in deltas) / 400 / 400) ** 0.5
    assert len(means) == 10_000 and abs(sum(means) / 10_000 - mean) < spread / 20
    out = registry.queries()["bootstrap_delta"](spark, str(tmp_path)).first()
    assert abs(out.low - mean + 1.96 * spread) < spread / 5 and abs(out.high - mean - 1.96 * spread) < spread / 5
    assert registry.queries()["bootstrap_delta"](spark.newSession(), str(tmp_path)).first() == out
    # sign flips of (1, 1, 1): all alike in 2 of 8
    small = spark.createDataFrame([(i, 1.0) for i in range(3)], "id long, delta double")
    assert abs(evaluate.randomization_p(small, 20_000, 1).first().p - 0.25) < 0.02 and evaluate.randomization_p(small.limit(0), 9, 1).first().p is None
