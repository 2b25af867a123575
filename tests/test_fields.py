"""Fields: what is read of a program for them, and entries that are written oddly."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import program
from gneiss.sources import files

ODD = """\
000100 identification division.
      *PROCEDURE DIVISION.
       01  rec.

      /    05  LOST PIC X.
           05  A PIC 9(4)
               VALUE 7.
               88  A-ON   VALUES 1 2.
           05  B REDEFINES
               A PIC X. 05 NEVER PIC X.
           COPY ELSEWHERE.
       01.
       77  É-NO PIC X.
           10  DEEP ÉVALUE.
       77  LAST-ONE PIC X
       PROCEDURE DIVISION USING VALUE X.
       P1.
           05  AFTER PIC X.
       PROCEDURE DIVISION."""


def _lines(spark, programs):
    return files.program_lines(programs).withColumn("at", F.array("line_no"))


def test_entries_that_are_written_oddly(spark):
    programs = spark.createDataFrame([("P", "p", ODD), ("Q", "q", ODD.replace("\n", "\r\n")), ("R", "r", ""), ("S", "s", None)], "program string, file string, text string")
    want = [
        (1, 3, 1, "REC", None, "REC", [], None, False),
        (2, 6, 5, "A", "REC", "REC", ["REC"], None, True),
        (3, 8, 88, "A-ON", "A", "REC", ["A", "REC"], None, True),
        (4, 9, 5, "B", "REC", "REC", ["REC"], "A", False),
        (5, 14, 10, "DEEP", "B", "REC", ["B", "REC"], None, False),
        (6, 15, 77, "LAST-ONE", "DEEP", "REC", ["DEEP", "B", "REC"], None, True),
    ]
    for lines in (_lines(spark, programs), _lines(spark, program.declaring(programs))):
        got = program.fields(lines).orderBy("program", "ord").collect()
        assert [r.program for r in got] == ["P"] * 6 + ["Q"] * 6
        assert [tuple(r)[1:] for r in got] == want * 2


def test_a_program_is_cut_behind_its_procedure_division_only(spark):
    texts = {
        "cut": "       01  A.\n       PROCEDURE DIVISION.\n       P1.\n",
        "astral": "       01  \U0001f600\U0001f600.\n      \U0001f600procedure   division using x.\n       P1.\n       P2.\n",
        "comment": "      * PROCEDURE DIVISION.\n       01  A.\n",
        "longer": "       PROCEDURE DIVISIONS.\n       01  A.\n",
        "return": "       01  A.\r       PROCEDURE DIVISION.\n       01  B.\n",
        "last": "       01  A.\n       PROCEDURE DIVISION.",
    }
    got = program.declaring(spark.createDataFrame([(k, k, v) for k, v in texts.items()], "program string, file string, text string"))
    kept = {r.program: r.text for r in got.collect()}
    assert kept.pop("cut") == "       01  A.\n       PROCEDURE DIVISION.\n"
    # a cut may be late where characters take two units, never early
    assert kept.pop("astral").startswith("       01  \U0001f600\U0001f600.\n      \U0001f600procedure   division using x.\n")
    assert kept == {k: texts[k] for k in kept}


def test_many_programs_over_many_batches(spark):
    rows = [(f"P{i:05}", "f", "       01  R.\n" + "".join(f"           05  F{k} PIC 9.\n" for k in range(i % 40))) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = program.fields(_lines(spark, spark.createDataFrame(rows, "program string, file string, text string").repartition(3, "program")))
        told = {r.program: r for r in got.groupBy("program").agg(F.count("*").alias("n"), F.max("ord").alias("last"), F.count_if(F.col("parent") == "R").alias("held"), F.count_distinct("record").alias("records")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(told) == 3000
    assert all((r.n, r.last, r.held, r.records) == (int(p[1:]) % 40 + 1,) * 2 + (int(p[1:]) % 40, 1) for p, r in told.items())


def test_fields_group_nothing_and_sort_their_lines_once(spark):
    rows = spark.createDataFrame([("P", "p", ODD)], "program string, file string, text string")
    plan = program.fields(_lines(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 1
