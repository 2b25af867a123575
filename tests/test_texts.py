"""What is told of whole texts in one walk is what is told of their lines by windows and joins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_outline import CODE

from gneiss.operators import parse, program, slices, texts
from gneiss.plans import programs, trees
from gneiss.sources import files

ODD = [
    CODE, CODE.replace("\n", "\r\n"), "", "\n", "       PROCEDURE DIVISION.", "       PROCEDURE DIVISION.\n           GO TO P1.\n       P1.\n       p1.\n           PERFORM P1 P2.\n",
    # continued literals, with and without an end; NOT=; a comment between; a continuation of nothing
    "       01  A PIC X VALUE IS 'abc\n      -    'def'.\n       01  B PIC X VALUE \"a\n      *    no\n      -    'x'.\n      -    y.\n       PROCEDURE DIVISION.\n           IF A NOT= B AND C not=D DISPLAY 'NOT=' .\n      *    NOT= A\n           MOVE 'x\n      -    'y' TO A",
    # blocks that overlap, and that end with and without a full stop
    "       PROCEDURE DIVISION.\n       A1.\n           COPY B REPLACING X\n               BY EXEC SQL Y.\n           EXEC SQL SELECT END-EXEC\n           EXEC CICS LINK\n      *    no end here\n               PROGRAM('Q') END-EXEC.\n           MOVE 1 TO B. EXIT.\n           PERFORM A1. EXIT.\n           STOP RUN.\n       B1 SECTION.\n       B1-X.\n           EXIT PROGRAM.\n       END-X.\n       STOP.\n           GO TO A1, B1-X DEPENDING ON X.\n           GO.\n           CALL X. PERFORM. PERFORM A1 3 TIMES. perform a1 through b1-x.",
]
WORDS = "IF ELSE END-IF READ AT END NOT END-READ EVALUATE WHEN END-EVALUATE PERFORM UNTIL TIMES END-PERFORM P1 P2 GO TO DEPENDING EXIT STOP RUN GOBACK CALL 'x y' 'P2' \"q\" ON SIZE ERROR EXCEPTION OVERFLOW INVALID KEY MOVE ADD NEXT SENTENCE A B, 1 (I) XML GENERATE THEN ENTRY RAISE JSON SEARCH . ; EOP WRITE SEARCH TO".split(" ")


def _random(seed: int) -> str:
    r = random.Random(seed)
    out = ["       PROCEDURE DIVISION."]
    for _ in range(r.randint(1, 60)):
        kind = r.random()
        if kind < 0.12:
            out.append(f"       P{r.randint(1, 3)}.")
        elif kind < 0.2:
            out.append(r.choice(["", "      * PERFORM P1.", "       X SECTION.", "      /"]))
        else:
            out.append("           " + " ".join(r.choice(WORDS) for _ in range(r.randint(1, 6))) + r.choice(["", "", ".", " ."]))
    return "\n".join(out)


def _programs(spark, more=()):
    rows = [(f"A{k}", f"a{k}", t) for k, t in enumerate([*ODD, *(_random(k) for k in range(60))])]
    return spark.createDataFrame([*rows, ("NIL", "nil", None), *more], "program string, file string, text string")


def _told(df, columns=None):
    return sorted(map(repr, df.select(columns or df.columns).collect()))




def test_texts_give_what_lines_give(spark):
    own = _programs(spark).cache()
    left = program.masked(files.program_lines(own)).cache()
    got = {r.program: r.text for r in own.collect() if r.text is not None}
    want: dict = {}
    for r in left.orderBy("program", "line_no").collect():
        want.setdefault(r.program, []).append(r.masked)
    assert {p: texts.masks(texts.cut(t))[0] for p, t in got.items()} == want
    text = left.select("program", "file", "line_no", F.col("masked").alias("text"))
    stmts = program.statements(text)
    assert _told(program.statements_of(own)) == _told(stmts)
    assert _told(program.outline_of(own)) == _told(program.outline(left))
    spans, blocks = program.paragraphs(text), program.blocks(left)
    assert _told(program.arrived(program.flows_of(own))) == _told(program.transfers(spans, stmts, blocks))
    assert _told(program.arrived(program.flows_of(own, blocks=False))) == _told(program.transfers(spans, stmts))
    near = program.transfers(spans, stmts).filter("reason is null and kind in ('perform', 'goto')").select("program", "src", "dst").unionByName(program.fallthrough(spans, stmts).select("program", "src", "dst")).cache()
    reach = program.reach_of(own)
    assert _told(reach, ["program", "name", "distance"]) == _told(slices.reach(spans, near), ["program", "name", "distance"])
    led = spans.select("program", "name").join(near.select("program", F.col("dst").alias("name")).distinct(), ["program", "name"], "left_semi")
    assert _told(reach.filter("led_to"), ["program", "name"]) == _told(led)


def test_trees_are_those_of_all_statements(spark):
    own = _programs(spark)
    text = lambda c: F.col(c).cast("string")
    line = F.concat_ws(" ", text("ord"), "kind", "verb", text("line_start"), text("depth"), F.coalesce("parent", F.lit(0)).cast("string"), F.coalesce("branch", F.lit("-")), F.concat(F.lit("["), F.array_join("guards", ","), F.lit("]")), text("block_end"))
    held = program.statements_of(own).groupBy("program", "file", "paragraph").agg(F.count("*").alias("n_statements"), F.max("depth").alias("deepest"), F.max(F.size("guards")).alias("most_guards"), F.count("parent").alias("inner_statements"), F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("ls"))
    want = held.select("program", "file", "paragraph", "n_statements", "deepest", "most_guards", "inner_statements", F.md5(F.array_join(F.transform("ls", lambda x: x["line"]), "\n").cast("binary")).alias("tree"))
    assert _told(program.trees_of(own)) == _told(want)
    # a row for every statement was gathered by paragraph
    plan = trees.program_tree(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "line_no" not in plan


def test_runs_are_what_whole_files_give():
    for seed in range(300):
        lines = [x for x in _random(seed).split("\n")[1:]]
        bodies, nos, heads, _ = texts.procedure(["       PROCEDURE DIVISION.", *lines])
        names = parse.named(nos, heads, "-")
        want: dict = {}
        for r in parse.segments(bodies, nos):
            want.setdefault((names[r["at"]], r["sentence"]), []).append(r)
        plain = sorted(repr((r["at"], (r["ord"], r["kind"], r["verb"], r["text"], r["line_start"], r["line_end"], *place))) for rs in want.values() for r, *place in parse.nest(rs))
        assert sorted(map(repr, parse.statements(bodies, nos, names))) == plain, seed


@pytest.mark.parametrize("text, why", [("       PROCEDURE DIVISION.\n           EXEC SQL X.", "unterminated exec_sql at line 2"), ("       PROCEDURE DIVISION.\n       P1.\n           EXEC CICS LINK END-EXEC.", "no PROGRAM")])
def test_what_is_refused(spark, text, why):
    with pytest.raises(Exception, match=why):
        program.flows_of(_programs(spark, [("Z", "z", text)])).collect()


def test_no_row_for_a_line(spark):
    """F1 to F3, F15, F17: lines were rows, sorted, masked by windows, and their ways met their own paragraphs by a join."""
    d = "/root/testdata/sf0.001"
    for query, joins, deals in ((programs.program_call_graph, 1, 2), (trees.program_computed_jumps, 1, 2), (programs.program_dead_paragraphs, 0, 1), (programs.program_forest_roots, 0, 1), (programs.program_unresolved, 0, 1)):
        plan = query(spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "explode" not in plan and plan.count("Join ") == joins and plan.count("Exchange ") <= deals, query
