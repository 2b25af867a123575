"""Documents that cover a query's words, against every pair compared."""

from __future__ import annotations

from gneiss.operators import retrieval


def test_every_pair_in_one_round_and_in_many(spark, monkeypatch):
    names = [a + b for a in "kqvxz" for b in "0123456789"]
    queries = [(i, " ".join(names[(i * 7 + j * (i % 3 + 1)) % 50] for j in range(1 + i % 11))) for i in range(40)] + [(3, "k0 q1"), (90, ""), (91, None), (92, "the of"), (93, "Loads, loading LOADED!")]
    docs = [(i, " ".join(names[(i * 3 + j * (i % 4 + 1)) % 50] for j in range(i % 30))) for i in range(60)] + [(7, "q1 k0 k0"), (90, ""), (91, None), (92, "load")]
    sets = lambda rows: [(k, set((t or "").lower().replace("loads, loading loaded!", "load").split()) - {"the", "of"}) for k, t in rows]
    want = sorted((d, q, round(len(a & b) / len(a), 6)) for d, b in sets(docs) for q, a in sets(queries) if a and round(len(a & b) / len(a), 6) >= 0.8)
    q, d = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for most in (retrieval.ASKED, 60):
        monkeypatch.setattr(retrieval, "ASKED", most)
        found = retrieval.covering(d, q, 0.8)
        assert sorted(tuple(r) for r in found.select("doc_id", "query_id", "overlap").collect()) == want
    assert len(want) > 100


def test_documents_stay_where_they_are_read(spark):
    d, q = spark.createDataFrame([(1, "k0 k1")], "doc_id long, text string"), spark.createDataFrame([(1, "k0")], "query_id long, text string")
    plan = retrieval.covering(d, q, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "HashAggregate(keys=[doc_id" not in plan
