"""Layouts join nothing: lines before the procedure, without their text, meet the fields of their program in one move."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import program, tools

CODE = """\
       DATA DIVISION.
       01  A.
           05  B.
               10  C PIC 9(4).
           05  B2 REDEFINES B PIC X(4).
       77  D PIC X.
       01  E.
           05  B.
               10  C PIC S9(2).
       PROCEDURE DIVISION.
       P1.
           MOVE 1 TO D."""


def test_layout_moves_each_program_once(spark):
    rows = [(p, "f", k, t) for p in ("P", "Q") for k, t in enumerate(CODE.split("\n"), 1)]
    # dealt by program, as the queries' are
    lines = spark.createDataFrame(rows, "program string, file string, line_no int, text string").repartition(2, "program").withColumn("at", F.array("line_no"))
    fields = program.fields(lines)
    got = tools.layout(fields, lines)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 3  # the two deals, and the move
    own = got.filter("program = 'Q'").orderBy("ord").collect()
    assert [(r.name, r.file, r.pic, r.head, r.above) for r in own] == [("A", "f", None, 1, None), ("B", "f", None, 1, 1), ("C", "f", "9(4)", 1, 2), ("B2", "f", "X(4)", 1, 1), ("D", "f", "X", 5, None), ("E", "f", None, 6, None), ("B", "f", None, 6, 6), ("C", "f", "S9(2)", 6, 7)]
