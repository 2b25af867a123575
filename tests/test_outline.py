"""Ways of control are told in one pass over the lines, without a row for any other statement, and are what all the statements give."""

from __future__ import annotations

from gneiss.operators import parse, program
from gneiss.plans import programs, trees

CODE = """\
       DATA DIVISION.
           EXEC SQL INCLUDE X END-EXEC.
           EXEC CICS LINK PROGRAM('EARLY') END-EXEC.
       PROCEDURE DIVISION.
           PERFORM P1 THRU P3.
       MAIN SECTION.
       P1.
           IF A = 1 MOVE 'X. GO TO P9' TO B
               ELSE READ F AT END GO TO P1 P9 DEPENDING ON C
           END-IF.
      *    GO TO P3.
           PERFORM P3 THRU P1 ADD 1
               TO D
       P2.
           NEXT SENTENCE CALL 'b'. CALL NAME.
           EXEC CICS
      *    kept
               XCTL PROGRAM('B') END-EXEC.
       P3.
           PERFORM NONE. PERFORM UNTIL D = 1 PERFORM P2 END-PERFORM.
           EXEC CICS LINK PROGRAM(NAME) END-EXEC. STOP RUN.
       P2.
           GO.
       P4.

"""


def _lines(spark):
    rows = [(p, f"{p}.cbl", k, t) for p in ("A", "B") for k, t in enumerate(CODE.split("\n"), 1)]
    rows += [("E", "e", 1, "       PROCEDURE DIVISION."), ("E", "e", 2, None), ("N", "n", 1, "       DATA DIVISION."), ("X", None, 1, "       PROCEDURE DIVISION."), ("X", None, 2, "           GO TO P1.")]
    return spark.createDataFrame(rows, "program string, file string, line_no int, text string")


def _told(df):
    return sorted(map(repr, df.collect()))


def test_outline_is_what_all_statements_give(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    left = program.masked(_lines(spark))
    text = left.select("program", "file", "line_no", left["masked"].alias("text"))
    spans, stmts, blocks = program.paragraphs(text), program.statements(text), program.blocks(left)
    ways, falls = _told(program.transfers(spans, stmts, blocks)), _told(program.fallthrough(spans, stmts))
    try:
        for n in ("1", "3", "10000"):
            spark.conf.set(key, n)
            own = program.outlined_parts(program.outline(left))
            assert _told(own[0]) == _told(spans.select(own[0].columns)) and _told(own[2]) == _told(blocks)
            assert _told(program.transfers(*own)) == ways and _told(program.fallthrough(own[0], own[1])) == falls
            kept = stmts.filter(stmts["kind"].isin(program.WAYS)).select(own[1].columns)
            assert _told(own[1].filter(own[1]["kind"].isin(program.WAYS))) == _told(kept)
    finally:
        spark.conf.set(key, before)
    reasons = {w.split("reason=")[1] for w in ways}
    assert len(ways) > 20 and {"'backwards')", "'unknown paragraph')", "'dynamic')", "'outside any paragraph')", "None)"} <= reasons
    bare = program.outlined_parts(program.outline(text))
    assert _told(bare[0]) == _told(spans.select(bare[0].columns)) and bare[2].isEmpty()


def test_lines_are_rendered_once(spark):
    """F5 to F7: programs were rendered, masked and read for paragraphs, for statements and for blocks, and every label was a join of its own."""
    for query in (programs.program_call_graph, trees.program_computed_jumps):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and plan.count("Join ") <= 4, query


def test_shapes_are_told_from_their_first_line():
    body = ["IF A = 1 READ F AT END", "GO TO P1 ELSE CONTINUE END-IF.", "MOVE 1 TO B."]
    for nos in ([1, 2, 3], [7, 19, 20]):
        rows = list(parse.segments([*body, *body], [*nos, *(n + 40 for n in nos)]))
        for sentence in {r["sentence"] for r in rows}:
            own = [r for r in rows if r["sentence"] == sentence]
            assert list(map(tuple, parse._nested(own))) == list(parse.nest(own))
