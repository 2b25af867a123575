"""Guards, the ladder, evaluation, splits, sources, clauses, text helpers, retrieval modes and streams, on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gneiss import streaming
from gneiss.functions import source
from gneiss.operators import clauses, evaluate, hunts, retrieval, splits
from gneiss.sources import files

STEP = "struct<tool: string, failed: boolean, observation: string>"
LINE = "struct<program: string, file: string, line: int>"
FINDING = f"""drift_type string, predicted_type string, has_prediction boolean, same_clause boolean, loci array<struct<program: string, paragraph: string, file: string, line_start: int, line_end: int>>, is_interprocedural boolean,
rationale string, target_path string, line_level array<{LINE}>, program_level string, paragraph_level string, literal string, comparator string, dead_paragraph string, transcript array<{STEP}>, clause_kind string,
clause_values array<string>, clause_comparator string, leaves map<string, struct<values: array<string>, comparator: string>>"""


def finding(kind, **more):
    read = [("read_paragraph", False, '{"code": "x"}')]
    row = dict(drift_type=kind, predicted_type=kind, has_prediction=True, same_clause=True, loci=[("P", "A", None, 1, 2)], is_interprocedural=False, rationale="the limit is 30 days", target_path=None, line_level=[], program_level="drift", paragraph_level="drift", literal="45", comparator=None, dead_paragraph=None, transcript=read, clause_kind="scalar", clause_values=["30"], clause_comparator="at_most", leaves={})
    return tuple((row | more).values())


def errors(spark, *rows):
    return [r.errors for r in hunts.guarded(spark.createDataFrame(list(rows), FINDING)).collect()]


def test_guards_of_every_class(spark):
    d = hunts.TYPES
    read = ("read_paragraph", False, '{"code": "x"}')
    absent = [("grep", False, '{"matches": []}'), ("find_callers", False, "[]"), ("find_callees", False, "[]"), ("slice_on", False, '{"statements": []}')]
    two = [("P", "A", None, 1, 2), ("Q", "B", None, 1, 2)]
    good = [
        finding(d[0]), finding(d[1], transcript=absent, line_level=[("P", None, 3)]), finding(d[2], transcript=[read, read], loci=two, is_interprocedural=True, rationale="they conflict"),
        finding(d[3], transcript=[("resolve_copybook", False, "{}")], clause_kind="enum_set"), finding(d[4], comparator="<"), finding(d[5], dead_paragraph="X"), finding(d[6], program_level="conformant", paragraph_level="conformant", comparator="<="),
    ]
    assert errors(spark, *good) == [[]] * 7
    bad = errors(
        spark,
        finding(d[0], rationale="no", literal=None, transcript=[("grep", True, "{}")], loci=[("P", "A", "f", 1, 2)]),
        finding(d[1], transcript=[("grep", False, '{"matches": [1]}'), *absent[1:3]]),
        finding(d[2]), finding(d[3]), finding(d[4], comparator="<="), finding(d[5], transcript=[]), finding(d[6]), finding("D9"),
        finding(d[0], predicted_type="x", same_clause=False), finding(d[0], has_prediction=False),
        finding(d[4], comparator="<", clause_kind="composite"), finding(d[4], comparator="<", clause_kind="composite", target_path="a.b", leaves={"a.c": (["1"], "at_least")}),
        finding(d[0], clause_kind="composite", target_path="a", leaves={"a": (["30"], "at_least")}),
    )
    assert bad[0] == ["missing tools: read_paragraph", "missing tools: resolve_copybook", "rationale lacks the value", "no literal"]
    assert bad[1] == ["missing tools: slice_on", "grep: not absent", "slice_on: nothing seen", "no insertion point"]
    assert bad[2] == ["two paragraphs have to be read", "one locus only", "no conflict named"]
    assert bad[3] == ["missing tools: resolve_copybook", "no set of values"] and bad[4] == ["comparators agree"]
    assert bad[5] == ["missing tools: read_paragraph", "no dead paragraph"] and bad[6] == ["labels aren't conformant"] and bad[7] == ["no hunt for D9"]
    assert bad[8] == ["type differs", "clause differs"] and bad[9] == ["no prediction"]
    assert bad[10] == ["no target path", "clause has no comparator"] and bad[11] == ["target path leads nowhere", "clause has no comparator"] and bad[12] == []


def test_the_ladder(spark):
    rows = spark.createDataFrame([(1, "OK", "MOVE 45", "45", None, True, True), (2, "NO", "MOVE 45", "45", None, True, True), (3, None, None, "45", None, True, True), (4, None, "MOVE 45", "46", None, False, True), (5, None, "MOVE 45", "45", None, True, False), (6, None, None, None, False, False, True)], "id int, probe string, code string, literal string, reached boolean, holds boolean, cited boolean")
    none = F.lit(None).cast("string")
    ran = F.struct(F.lit(True).alias("available"), F.lit(True).alias("compiled"), F.lit("OK\n").alias("stdout"))
    out = hunts.verified(rows, hunts.executed(F.col("probe"), ran), hunts.static(F.col("code"), F.col("literal"), none, F.when(F.col("id") == 6, "DEAD"), F.col("reached")), hunts.entailed(F.col("holds"), F.lit(0.7)), F.col("cited"))
    got = {r.id: (r.tier, r.verified, [a.outcome for a in r.attempts], r.rejected, r.confidence) for r in out.collect()}
    assert got == {
        1: (1, True, ["verified"], None, 0.95), 2: (2, True, ["refuted", "verified"], None, 0.85), 3: (3, True, ["unavailable", "unavailable", "verified"], None, 0.6),
        4: (None, False, ["unavailable", "refuted", "refuted"], "unverifiable", None), 5: (None, False, ["unavailable", "verified"], "citation", None), 6: (2, True, ["unavailable", "verified"], None, 0.85),
    }
    assert "forest_roots + reachable_from" in out.filter("id = 6").first().evidence and out.filter("id = 5").first().evidence
    best = spark.createDataFrame([("a", "D2", True, 0.85, 2), ("a", "D1", True, 0.85, 2), ("a", "D3", False, None, None), ("b", "D5", False, None, None), ("b", "D4", False, None, None)], "instance_id string, hunt string, verified boolean, confidence double, tier int")
    assert {r.instance_id: r.hunt for r in hunts.best_of(best).collect()} == {"a": "D1", "b": "D4"}


def test_trajectories(spark):
    schema = f"id int, predicted_type string, transcript array<{STEP}>, tier int, evidence string, verified boolean, has_finding boolean, gold_lines array<{LINE}>, predicted_lines array<{LINE}>, token_counts array<long>, tokens_used long, max_steps int, max_tool_calls int, max_tokens long"
    seen, at = [("read_paragraph", False, "ACCT line 12")], [("ACCT", None, 12)]
    rows = [
        (1, "D5_boundary_error", seen, 2, "e", True, True, at, at, [5, 6], 11, 8, 8, 100), (2, "D5_boundary_error", [("grep", False, "git log ACCT 12")], 2, "e", False, True, at, at, [5], 6, 8, 8, 100),
        (3, None, None, None, None, None, False, at, None, None, None, 8, 8, 100), (4, "D6_dead_code", seen, 2, "forest_roots + reachable_from", True, True, at, [], [5], 5, 8, 8, 4),
    ]
    out = {r.id: r for r in hunts.assessed(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].reasons == [] and out[1].replayable and out[2].reasons == ["evidence path", "budget", "shortcut", "unverified finding"] and not out[2].replayable
    assert out[3].reasons == ["no trajectory"] and out[3].shortcut_free and out[4].reasons == ["budget"] and out[4].code_fact_ok


# evaluation ---------------------------------------------------------------------------------------------------------


def test_evaluation_rules(spark):
    recs = spark.createDataFrame([(True, True, False, False), (True, False, True, False), (False, True, False, True), (False, False, False, False)], "gold boolean, predicted boolean, abstained boolean, infra boolean")
    r = evaluate.detection(recs).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.n, r.answered, r.answered_accuracy) == (1, 0, 1, 1, 3, 2, 1.0)
    with pytest.raises(Exception, match="several records of 1"):
        evaluate.unique(spark.createDataFrame([(1,), (1,)], "id int"), "id").collect()
    for k, n in ((0, 0), (3, 2), (-1, 2)):
        with pytest.raises(ValueError):
            evaluate.exact_interval(k, n)
    floors = spark.createDataFrame([("a", 2), ("b", 1)], "name string, floor int")
    counts = spark.createDataFrame([("a", 1)], "name string, n long")
    assert {r.name: r.short for r in evaluate.shortfalls(counts, floors).collect()} == {"a": 1, "b": 1}
    with pytest.raises(Exception, match="floor not met"):
        evaluate.shortfalls(counts, floors, strict=True).collect()
    verdicts = spark.createDataFrame([(i, "plausible") for i in range(20)], "instance_id int, verdict string")
    assert evaluate.agreement(verdicts.limit(15), verdicts).first().rate == 1.0
    with pytest.raises(Exception, match="15 reviews"):
        evaluate.agreement(verdicts.limit(14), verdicts).collect()


def test_sums_before_by_ranges(spark):
    rows = spark.createDataFrame([(g, float(v), 1 + v % 3) for g in ("a", "b") for v in range(200)], "g string, v double, q long").repartition(7)
    for r in evaluate.before(rows, ["g"], "v", "q").collect():
        assert r.before == sum(1 + i % 3 for i in range(int(r.v)))
    assert evaluate.auc(rows.select((F.col("v") > 100).alias("positive"), "v"), "v").first().auc == 1.0


def test_probe_and_interval(spark):
    rows = spark.createDataFrame([(int(i > 50), float(i), 1.0) for i in range(100)], "label int, a double, b double")
    bias, (a, b) = evaluate.logistic_probe(rows, ["a", "b"])
    assert a > 1 and b == 0 and abs(bias) < 0.5
    recs = spark.createDataFrame([(True, True, False)] * 30 + [(True, True, True)] * 30 + [(False, False, False)] * 40, "gold boolean, a boolean, b boolean")
    delta, low, high = evaluate.interval(recs, 500, 4405)
    assert abs(delta - (1 - 2 * 30 / 90)) < 1e-9 and 0 < low < delta < high
    assert evaluate.interval(recs, 500, 4405) == (delta, low, high)


def test_go_no_go(spark):
    schema = "n_agent int, n_dense int, n_oracle int, labels_complete boolean, pairs int, infra int, fully_paired boolean, f1 double, delta double, low double, p double"
    rows = [(9, 9, 9, True, 20, 0, True, 0.7, 0.1, 0.01, 0.04), (9, 9, 9, True, 20, 0, True, 0.7, 0.1, 0.0, 0.04), (9, 0, 9, False, 0, 1, False, 0.9, 0.9, 0.9, 0.0), (9, 9, 9, True, 19, 1, True, 0.9, 0.9, 0.9, 0.0)]
    out = evaluate.go_no_go(spark.createDataFrame(rows, schema)).collect()
    assert [r.status for r in out] == ["GO", "NO_GO", "NOT_EVALUABLE", "NOT_EVALUABLE"]
    assert out[2].issues == ["dense: no records", "labels are incomplete"] and out[3].issues == ["pairs: 19", "infrastructure failures"]


# splits and policy --------------------------------------------------------------------------------------------------


def test_splits(spark):
    rows = [(f"b{i % 30}", ("D1", "D2")[i % 2], i % 5 == 0, i % 30 == 7) for i in range(300)]
    dealt = splits.build_splits(spark.createDataFrame(rows, "base string, drift_type string, is_interprocedural boolean, real boolean"), 2600)
    assert dealt.groupBy("base").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty() and {r.split for r in dealt.filter("base = 'b7'").collect()} == {"test"}
    n = {r.split: r["count"] for r in dealt.groupBy("split").count().collect()}
    assert abs(n["train"] - 150) <= 20 and abs(n["dev"] - 50) <= 20 and abs(n["test"] - 100) <= 20
    floors = spark.createDataFrame([("train", "D1", 10), ("dev", "D9", 1)], "split string, drift_type string, floor int")
    assert [(r.problem, r.what) for r in splits.split_errors(dealt, floors).collect()] == [("below its floor", "dev/D9")]
    drawn = splits.group_split(spark.createDataFrame([(f"g{i}",) for i in range(900)], "g string"), "g", 1).groupBy("split").count().collect()
    assert {r.split for r in drawn} == set(splits.SPLITS) and all(100 < r["count"] < 520 for r in drawn)


def test_stratified_sample(spark):
    rows = [(f"i{i:03}", f"D{i % 7 + 1}", i == 250) for i in range(300)]
    df = spark.createDataFrame(rows, "instance_id string, drift_type string, is_interprocedural boolean")
    out = splits.stratified_sample(df, 10, "2400").collect()
    assert len(out) == 10 and len({r.drift_type for r in out}) == 7 and "i250" in {r.instance_id for r in out}
    assert out == splits.stratified_sample(df.repartition(5), 10, "2400").collect()


def test_policy(spark):
    v = lambda *rows: spark.createDataFrame(list(rows), "instance_id string, verdict string")
    out = splits.drop_policy(v(("a", "plausible"), ("b", "unsure"), ("c", "unsure"), ("d", "plausible")), v(("d", "implausible")), v(("b", "plausible")))
    assert {r.instance_id: (r.effective, r.fate) for r in out.collect()} == {"a": ("plausible", "kept"), "b": ("plausible", "kept"), "c": ("unsure", "held"), "d": ("implausible", "dropped")}
    assert splits.override_metrics(out).first().rate == 0.25
    for over in (("a", "plausible"), ("x", "implausible")):
        with pytest.raises(Exception, match="override"):
            splits.drop_policy(v(("a", "plausible")), v(over), v(("z", "plausible"))).collect()
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(splits.parse_verdict(F.col("t")).alias("v")).first().v
    assert one('{"verdict": "plausible", "reason": "fits"}').verdict == "plausible"
    for bad in ("yes", '{"verdict": "maybe", "reason": "x"}', '{"verdict": "unsure", "reason": ""}', '{"verdict": "unsure", "reason": "x", "more": 1}', None):
        with pytest.raises(Exception, match="no verdict"):
            one(bad)
    f = spark.createDataFrame([("gpt-4o", "openai", "google"), ("gpt-4o", "meta", "google"), ("local", "", "google"), ("x/llama-3", "Meta", "meta")], "m string, f string, s string").select(splits.independent(F.col("m"), F.col("f"), F.col("s")).alias("e")).collect()
    assert [r.e for r in f] == [None, "name and family differ", "no family", "judge is of the system's family"]
    both = splits.reconstructed(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "instance_id string, text string"), spark.createDataFrame([("a", "x"), ("b", "Y"), ("d", "z")], "instance_id string, text string"))
    assert {r.instance_id: r.problem for r in both.collect()} == {"b": "differs", "c": "not rebuilt", "d": "not known"}


# sources ------------------------------------------------------------------------------------------------------------


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"id": "a", "status": "pinned"}, {"id": "b", "status": "draft"}]}))
    assert [r.id for r in files.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["a"]
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "m.json"), ("id", "status", "sha256"))
    cache = spark.createDataFrame([("v1", "k", "0.5"), ("v1", "l", "0.7")], "version string, key string, score string")
    digest = files.cache_digest(cache, ["key", "score"])
    assert files.checked_cache(cache.orderBy(F.desc("key")), "v1", ["key", "score"], digest).count() == 2
    for version, d in (("v2", digest), ("v1", "0")):
        with pytest.raises(ValueError):
            files.checked_cache(cache, version, ["key", "score"], d)
    now = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"3"))], "id string, content binary")
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    prior = spark.createDataFrame([("a", sha(b"1"), 1), ("b", "old", 1), ("z", "gone", 1)], "id string, sha256 string, bytes long")
    assert {r.id: r.status for r in files.pinned(now, prior).collect()} == {"a": "same", "b": "changed", "c": "new", "z": "missing"}
    inst = spark.createDataFrame([(i, f"i{i}") for i in range(5)], "ord int, instance_id string")
    check = spark.createDataFrame([(0, "i0", "plausible"), (1, "i1", "unsure")], "ord int, instance_id string, verdict string")
    done, rest = files.to_judge(inst, check, spark.createDataFrame([("i3", "plausible")], "instance_id string, verdict string"))
    assert {r.instance_id for r in done.collect()} == {"i0", "i1", "i3"} and {r.instance_id for r in rest.collect()} == {"i2", "i4"}
    with pytest.raises(Exception, match="checkpoint differs"):
        files.to_judge(inst, check.filter("ord = 0").withColumn("instance_id", F.lit("i9")), check.limit(0))[0].collect()
    assert "| a | 1 |" in files.write_report(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "r"), "T") and json.loads((tmp_path / "r.json").read_text()) == [{"x": "a", "y": 1}]
    paths = spark.createDataFrame([("/x/a.cbl",), ("/y/b.cbl",), ("/z/b.cbl",)], "file string")
    assert files.unique_path(paths, "a.cbl") == "/x/a.cbl"
    for name in ("b.cbl", "c.cbl"):
        with pytest.raises(ValueError):
            files.unique_path(paths, name)
    needs = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "E")], "name string, needs string")
    out = files.copy_closure(needs, spark.createDataFrame([("p", "A"), ("q", "D")], "root string, name string"))
    assert sorted(map(tuple, out.collect())) == [("p", "A"), ("p", "B"), ("p", "C"), ("q", "D"), ("q", "E")]
    (tmp_path / "q.jsonl").write_text('{"query_id": "1", "text": "t", "record_id": "r"}\n\n')
    assert files.read_records(spark, str(tmp_path / "q.jsonl"), "queries").count() == 1
    rows = [("r1", ("d", "1", "v", None, "old", None), None, 1), ("r2", ("d", "1", "v", None, "new", None), None, 2)]
    looked = files.clause_lookup(spark.createDataFrame(rows, files.SCHEMAS["clauses"] + ", line_no int"))
    assert [(r.clause_id, r.text) for r in looked.collect()] == [("1", "new")]


# clauses ------------------------------------------------------------------------------------------------------------


def test_segments_and_pages(spark):
    texts = ["Front words", "1. Scope ........ 3", "Chapter I – General", "1. Scope:", "(1) first", "(a) under one", "A. Letters", "2. Terms", "(b) of note 2", "(b) bee", "Chapter II - Last", "3. End"]
    lines, at = [], 0
    for i, t in enumerate(texts):
        lines.append(("d", at, at + len(t), 1 + i // 4, t))
        at += len(t) + 1
    df = spark.createDataFrame([*lines, ("e", 0, 4, 1, "none")], "doc string, start int, end int, page int, text string")
    out = clauses.segments(df).orderBy("doc", "ord").collect()
    assert [(r.kind, r.clause_id, r.path) for r in out if r.doc == "d"] == [
        ("front", None, ["Front matter"]), ("front", None, ["Chapter I – General"]), ("clause", "1", ["Chapter I – General", "1. Scope"]), ("clause", "1(1)", ["Chapter I – General", "1. Scope", "(1)"]),
        ("clause", "1(1)(a)", ["Chapter I – General", "1. Scope", "(1)", "(a)"]), ("front", None, ["Chapter I – General", "A. Letters"]), ("clause", "2", ["Chapter I – General", "A. Letters", "2. Terms"]),
        ("clause", "2(b)", ["Chapter I – General", "A. Letters", "2. Terms", "(b)"]), ("front", None, ["Chapter II – Last"]), ("clause", "3", ["Chapter II – Last", "3. End"]),
    ]
    assert [(r.path, r.start, r.end) for r in out if r.doc == "e"] == [(["Document"], 0, 4)]
    d = [r for r in out if r.doc == "d"]
    assert all(a.end == b.start for a, b in zip(d, d[1:], strict=False)) and d[-1].page_end == 3
    pages = clauses.page_of(spark.createDataFrame([("d", 0), ("d", 12), ("d", 10_000)], "doc string, offset int"), df)
    assert {r.offset: r.page for r in pages.collect()} == {0: 1, 12: 1, 10_000: 3}


def test_reconciled_clauses(spark):
    chunks = spark.createDataFrame([("d", "c1", None, "customers receive updated statements monthly", 0), ("d", "c2", "9", "other", 50), ("d", "c3", None, "customers receive updated statements monthly and yearly", 90)], "doc string, chunk_id string, clause_id string, text string, start int")
    vocab = spark.createDataFrame([(1, "d", "5(i)", "customer receives updating of statements"), (2, "d", "9", "whatever"), (3, "d", "7", "nothing alike here"), (4, "x", "1", "customers")], "ord int, doc string, clause_id string, text string")
    assert {r.chunk_id: r.clause_id for r in clauses.reconciled(chunks, vocab).collect()} == {"c1": "5(i)", "c2": "9", "c3": None}


# text helpers -------------------------------------------------------------------------------------------------------


def test_source_expressions(spark):
    one = lambda f, *values: spark.createDataFrame([values], ", ".join(f"c{i} {'string' if isinstance(v, str) or v is None else 'double'}" for i, v in enumerate(values))).select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x
    assert one(source.control_text, "MOVE 'IF' TO X. \"A\"") == "MOVE      TO X.    "
    assert one(source.canonical_fragment, "  move  'a  b'   to x ") == "MOVE 'a  b' TO X"
    assert one(source.note_segments, "MO-1; old='a;b'; new=\"c\\\";d\" ; e") == ["MO-1", "old='a;b'", "new=\"c\\\";d\"", "e"]
    assert one(source.note_values, "MO-1; old='30'; new='45'; x") == {"old": "'30'", "new": "'45'"}
    assert one(source.wrapped_snippet, "DISPLAY 'A'").split("\n")[4] == "           DISPLAY 'A'" and one(source.wrapped_snippet, "ID DIVISION.") == "ID DIVISION."
    assert one(source.displayed, "DISPLAY 'A'. display \"B\"") == "A\nB\n" and one(source.displayed, "EXEC CICS X") is None
    cut = one(source.summarised, "x" * 5000)
    assert len(cut.text) == 4000 and cut.text.endswith("…") and cut.truncated
    assert one(source.clean_pic, "PIC S9(10)V99") == "S9(10)V99" and one(source.clause_id, "5 (XIV) (A)") == "5(xiv)(a)"
    assert str(one(source.iso_date, "2025-02-28")) == "2025-02-28" and one(source.iso_date, "28/02/2025") is None and one(source.iso_date, "2025-02-31") is None
    got = spark.createDataFrame([({"b": "2", "a": "1"},)], "m map<string,string>").select(source.files_hash(F.col("m")).alias("h")).first().h
    import hashlib

    assert got == hashlib.sha256(b"a\0001\0b\0002\0").hexdigest()
    assert one(source.number_like, "10.50", 12.0) == "12.00" and one(source.number_like, "10", 12.0) == "12"
    leaf = one(source.leaves, '{"kind": "composite", "value": {"a": {"kind": "x", "value": 3}, "b": {"kind": "composite", "value": {"c": {"kind": "y", "value": true}}}}}')
    assert [(x.path, x.value) for x in leaf] == [("a", "3"), ("b.c", "true")] and [(x.path, x.value) for x in one(source.leaves, '{"kind": "x", "value": [1, 2]}')] == [(None, "[1,2]")]


# retrieval ----------------------------------------------------------------------------------------------------------


def brute_hybrid(lexical, semantic, k):
    """Whole rankings by plain sorts."""
    total: dict = {}
    for ranking in (lexical, semantic):
        for rank, doc in enumerate(sorted(ranking, key=lambda d: (-ranking[d], d)), 1):
            total[doc] = total.get(doc, 0) + 1 / (60 + rank)
    return sorted(total, key=lambda d: (-round(total[d], 9), d))[:k]


def test_search_modes(spark):
    import random

    rnd = random.Random(4)
    vocabulary = "credit limit account balance penalty charge customer statement branch notice".split()
    docs = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 9)))) for i in range(0, 900, 2)]
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(0, 900, 3)]
    d, v = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = [(1, "credit limits of accounts"), (2, "penalty penalty"), (3, "zebra")]
    q = spark.createDataFrame([(i, t, vectors[i][1]) for i, t in asked], "query_id long, text string, embedding array<double>")
    lexical, semantic = {}, {}
    for r in retrieval.bm25(d, q).collect():
        lexical.setdefault(r.query_id, {})[r.doc_id] = r.score
    for r in retrieval.dense(v, q).collect():
        semantic.setdefault(r.query_id, {})[r.doc_id] = r.score
    for k in (3, 10):
        got: dict = {}
        for r in retrieval.search("hybrid", q, d, k, vectors=v).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        for i, _ in asked:
            every = {doc: lexical.get(i, {}).get(doc, 0.0) for doc, _ in docs}
            assert got[i] == brute_hybrid(every, semantic[i], k)
    zero = retrieval.search("bm25", q, d, 4).filter("query_id = 3").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in zero] == [(0, 0.0), (2, 0.0), (4, 0.0), (6, 0.0)]
    only = spark.createDataFrame([(i,) for i in (10, 20, 30, 40, 50)], "doc_id long")
    assert {r.doc_id for r in retrieval.search("bm25", q, d, 9, only=only).collect()} == {10, 20, 30, 40, 50}
    assert retrieval.search("hybrid_rerank", q, d, 2, vectors=v).filter("query_id = 1").count() == 2 and retrieval.search("dense", q, d, 2, vectors=v).count() == 6
    for mode, more in (("sparse", {}), ("dense", {}), ("hybrid_rerank", {"vectors": v, "scorer": None})):
        with pytest.raises(ValueError):
            retrieval.search(mode, q, d, 2, **more)
    assert retrieval.search("bm25", q, d.limit(0), 2).count() == 0 and retrieval.search("hybrid", q, d.limit(0), 2, vectors=v.limit(0)).count() == 0
    assert retrieval.stub_search(q, d, 5).filter("query_id = 3").isEmpty()


def test_gold_and_descriptions(spark):
    q = spark.createDataFrame([("1", "r1"), ("2", "r2")], "query_id string, record_id string")
    c = spark.createDataFrame([("r1", "d", "5"), ("r2", "d", "6")], "record_id string, doc string, clause_id string")
    assert {r.query_id: r.clause_id for r in retrieval.gold(q, c).collect()} == {"1": "5", "2": "6"}
    for bad in (c.limit(1), c.union(c.limit(1))):
        with pytest.raises(Exception, match="record"):
            retrieval.gold(q, bad).collect()
    asked = spark.createDataFrame([("1", "a"), ("2", "b")], "query_id string, text string")
    cache = spark.createDataFrame([("a", "said")], "raw_query string, description string")
    made = retrieval.described_queries(asked, cache, F.upper)
    assert {r.query_id: r.described for r in made.collect()} == {"1": "said", "2": "B"}
    with pytest.raises(Exception, match="cached twice"):
        retrieval.described_queries(asked, cache.union(cache), F.upper).collect()
    ranks = spark.createDataFrame([("bm25", 1, 1), ("bm25", 2, None)], "mode string, query_id int, rank int")
    assert {r.variant: r.hit_1 for r in retrieval.compared(ranks, ranks.filter("query_id = 1")).collect()} == {"raw": 0.5, "described": 1.0}


# streams ------------------------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", True, 5, 1.0), ("a", False, 6, 1.0), ("b", True, 1, 9.0)], "run_id string, is_tool boolean, tokens long, seconds double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for turn in range(2):
        streaming.append_once(stream().select("run_id"), str(tmp_path / "out"), "run_id", str(tmp_path / f"c{turn}")).awaitTermination()
        assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    q = streaming.budgets(stream(), {"steps": 8, "tool_calls": 8, "tokens": 10, "seconds": 5.0}).writeStream.format("memory").queryName("spent").outputMode("update").option("checkpointLocation", str(tmp_path / "c9")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.run_id: (r.steps, r.tool_calls, r.tokens, r.breach) for r in spark.table("spent").collect()} == {"a": (2, 1, 11, "tokens"), "b": (1, 1, 1, "seconds")}


# runs ---------------------------------------------------------------------------------------------------------------


def test_runs(spark):
    from gneiss import __main__ as command
    from gneiss.operators import runs

    gold = spark.createDataFrame([("a", "D1", "P", "text"), ("b", "D7", "P", "text"), ("c", "D2", "P", "text")], "instance_id string, drift_type string, program string, clause_text string")
    assert runs.context(gold).columns == ["instance_id", "program", "clause_text"]
    answers = spark.createDataFrame([("a", "D1", False, None), ("b", "D1", False, "timeout")], "instance_id string, predicted_type string, abstained boolean, failure string")
    got = {r.instance_id: (r.infra, r.failure, r.predicted_type) for r in runs.outcomes(gold, answers).collect()}
    assert got == {"a": (False, None, "D1"), "b": (True, "timeout", None), "c": (True, "no answer", None)}
    hits = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 9, "z")], "instance_id string, rank int, text string")
    assert {r.instance_id: r.passages for r in runs.retrieval_context(gold, hits).collect()} == {"a": ["x", "y"], "b": [], "c": []}
    keys = gold.select(runs.run_key(F.col("instance_id"), F.col("drift_type")).alias("run_key"))
    assert runs.left_to_do(keys, keys.limit(1)).count() == 2
    assert {r.instance_id: r.drift_type for r in runs.upsert(gold, gold.filter("instance_id = 'a'").withColumn("drift_type", F.lit("D9")), "instance_id").collect()} == {"a": "D9", "b": "D7", "c": "D2"}
    lines = spark.createDataFrame([("P", i, f"line {i}") for i in range(1, 40)], "program string, line_no int, text string")
    loci = spark.createDataFrame([("a", 1, "P", 20, 21)], "instance_id string, ord int, program string, line_start int, line_end int")
    shown = runs.shown(lines, loci)
    assert len(shown.first().excerpt.split("\n")) == 22 and ">   20  line 20" in shown.first().excerpt
    assert "line 20" in runs.judge_prompts(gold.withColumn("rationale", F.lit("r")), shown).filter("instance_id = 'a'").first().prompt
    pairs = spark.createDataFrame([("p", "h"), ("p", "g")], "premise string, hypothesis string")
    scored = runs.entailment_cache(pairs, lambda p: p.withColumn("score", F.when(F.col("hypothesis") == "h", 0.9).otherwise(0.1)))
    assert {r.hypothesis: r.holds for r in runs.entailed(pairs, scored).collect()} == {"h": True, "g": False}
    with pytest.raises(Exception, match="not cached"):
        runs.entailed(pairs, scored.limit(1)).collect()
    assert runs.entailed(pairs, scored.limit(1), lambda p: p.withColumn("score", F.lit(1.0))).filter("holds").count() >= 1
    plan, skipped = runs.seed_plan(spark.createDataFrame([("P", "r1")], "program string, record_id string"), spark.createDataFrame([("r1",), ("r2",)], "record_id string"))
    assert plan.count() == 1 and [r.record_id for r in skipped.collect()] == ["r2"]
    leaves = spark.createDataFrame([("30",), ("30.0",), ("true",), ('"x"',)], "value string")
    assert [r.value for r in runs.regulated(leaves).collect()] == [30.0]
    assert command.main(["queries"]) == 0 and command.main(["run", "nothing", "x"]) == 2
