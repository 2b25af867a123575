"""Statements are told line by line: no row for a word, nothing gone through anew for every line, and the same whatever batches the lines come in."""

from __future__ import annotations

from gneiss.operators import program

CODE = """\
       PROCEDURE DIVISION.
       P1.
           IF A = 1 MOVE 'X. Y' TO B
               ELSE READ F AT END GO TO P1 P2 DEPENDING ON C
           END-IF.
           PERFORM P2 THRU P3 ADD 1
               TO D
       P2.
           NEXT SENTENCE MOVE 1 TO E. STOP RUN."""


def _lines(spark):
    rows = [(p, f, k, t) for p in ("A", "B", None) for f in ("x", None) for k, t in enumerate(CODE.split("\n"), 1)]
    return spark.createDataFrame(rows, "program string, file string, line_no int, text string")


def test_no_row_for_a_word(spark):
    plan = program.statements(_lines(spark))._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and plan.count("Exchange ") == 1


def test_files_across_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(key), {}
    try:
        for n in ("1", "2", "4", "10000"):
            spark.conf.set(key, n)
            got[n] = sorted(map(repr, program.statements(_lines(spark)).collect()))
    finally:
        spark.conf.set(key, before)
    assert got["1"] == got["2"] == got["4"] == got["10000"] and len(got["1"]) == 6 * 11
    own = program.statements(_lines(spark)).filter("program = 'A' and file = 'x'").orderBy("ord").collect()
    assert [(r.paragraph, r.kind, r.line_start, r.line_end, r.depth, r.targets) for r in own][4:8] == [("P1", "PHRASE", 4, 4, 2, []), ("P1", "GOTO", 4, 4, 2, ["P1", "P2"]), ("P1", "PERFORM_CALL", 6, 6, 0, []), ("P1", "OTHER", 6, 7, 0, [])]


def test_masks_are_told_in_one_pass(spark):
    plan = program.masked(_lines(spark))._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan and plan.count("Exchange ") == 1
