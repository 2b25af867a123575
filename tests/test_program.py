from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gneiss.operators import graph, program
from gneiss.sources import files

MAIN = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. MAINP.
       DATA DIVISION.
       01  REC.
           05  A PIC 9.
               88  A-ON VALUE 1.
           05  B REDEFINES A PIC X.
       COPY BOOK REPLACING ==XX== BY ==YY==.
       COPY NOWHERE.
       PROCEDURE DIVISION.
           PERFORM P1 THRU P2.
           STOP RUN.
       P1.
           IF A NOT= 1
               MOVE A TO YY-C
           ELSE
               ADD A TO B
           END-IF.
      *    GO TO P3.
           CALL 'OTHER'.
       P2.
           COMPUTE B = A * 2 + TBL(YY-C).
           GO TO P3.
       DEADP.
           DISPLAY 'MOVE A'.
       P3.
           GOBACK.
"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("src")
    (at / "a.cbl").write_text(MAIN)
    (at / "b.cbl").write_text("       PROGRAM-ID. MAINP.\n")
    (at / "c.cbl").write_text("       PROGRAM-ID. OTHER.\n       PROCEDURE DIVISION.\n       O1.\n           GOBACK.\n")
    return files.program_lines(files.read_programs(spark, f"{at}/*.cbl")).cache()


@pytest.fixture(scope="module")
def books(spark):
    rows = [("BOOK", 0, 1, "       01  XX-REC."), ("BOOK", 0, 2, "           05  XX-C PIC 9."), ("BOOK", 0, 3, "       COPY DEEP."), ("book", 1, 1, "       01  LATE."), ("DEEP", 0, 1, "           05  D PIC 9 VALUE 3.")]
    return files.first_by_path(spark.createDataFrame(rows, "name string, search_ord int, line_no int, text string"))


def test_first_path_of_a_program_wins_and_lines_count_from_one(lines):
    assert {(r.program, r["count"]) for r in lines.groupBy("program").count().collect()} == {("MAINP", 27), ("OTHER", 4)}


def test_no_program_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        files.read_programs(spark, str(tmp_path / "*.cbl"))


def _source(spark, *bodies):
    return spark.createDataFrame([("P", "f", i, b) for i, b in enumerate(bodies, 1)], "program string, file string, line_no int, text string")


def test_masks_keep_the_line_count(spark):
    src = _source(spark, "           EXEC SQL", "             SELECT 1", "           END-EXEC.", "           EXEC CICS X END-EXEC", "       COPY A REPLACING ==B==", "           BY ==C==.", "           05 Z VALUE 'long", "      -    'er'.", "           IF A NOT= B", "      * EXEC SQL")
    got = program.masked(src).orderBy("line_no").collect()
    assert [r.masked for r in got] == [program.CONTINUE, "", program.CONTINUE + ".", program.CONTINUE, "", program.CONTINUE + ".", "           05 Z VALUE 'X'.", "", "           IF A NOT = B", "      * EXEC SQL"]
    assert [(r.span_kind, r.span_start, r.span_end) for r in got][:6] == [("exec_sql", 1, 3)] * 3 + [("exec_cics", 4, 4)] + [("copy_replacing", 5, 6)] * 2


def test_an_unterminated_block_is_an_error(spark):
    with pytest.raises(Exception, match="unterminated exec_sql"):
        program.masked(_source(spark, "           EXEC SQL", "             SELECT 1")).collect()


def test_expansion_and_its_line_map(lines, books):
    e = program.expanded(lines.filter("program = 'MAINP'"), books)
    got = [(r.line_no, r.text.strip()) for r in e.orderBy("at").collect()][6:12]
    assert got == [(7, "05  B REDEFINES A PIC X."), (1, "01  YY-REC."), (2, "05  YY-C PIC 9."), (1, "05  D PIC 9 VALUE 3."), (9, "COPY NOWHERE."), (10, "PROCEDURE DIVISION.")]
    assert [(r.expanded_start, r.expanded_end, r.first_line) for r in program.line_map(e).orderBy("expanded_start").collect()] == [(1, 7, 1), (8, 9, 1), (10, 10, 1), (11, 29, 9)]


def test_fields_nest(lines, books):
    f = {r.name: r for r in program.fields(program.expanded(lines, books)).collect()}
    assert f["A-ON"].ancestors == ["A", "REC"] and f["A-ON"].level == 88 and f["A-ON"].has_value
    assert (f["B"].parent, f["B"].record, f["B"].redefines) == ("REC", "REC", "A")
    assert (f["YY-C"].record, f["D"].parent) == ("YY-REC", "YY-REC")


def test_paragraphs(lines):
    got = program.paragraphs(lines.filter("program = 'MAINP'"), preamble=True).orderBy("ord").collect()
    assert [(r.name, r.line_start, r.line_end) for r in got] == [(program.PREAMBLE, 11, 12), ("P1", 13, 20), ("P2", 21, 23), ("DEADP", 24, 25), ("P3", 26, 27)]
    assert program.paragraphs(lines).filter("program = 'MAINP'").count() == 4


def test_statements_nest_and_name_their_targets(lines):
    s = program.statements(lines.filter("program = 'MAINP'")).orderBy("ord").collect()
    assert [(r.kind, r.depth) for r in s] == [("PERFORM_CALL", 0), ("OTHER", 0), ("IF", 0), ("MOVE", 1), ("ELSE", 0), ("OTHER", 1), ("CALL", 0), ("COMPUTE", 0), ("GOTO", 0), ("OTHER", 0), ("OTHER", 0)]
    assert (s[0].target, s[0].thru, s[6].target, s[6].dynamic, s[8].target) == ("P1", "P2", "OTHER", False, "P3")


def test_edges_and_dead_paragraphs(lines):
    spans = program.paragraphs(lines, preamble=True)
    e = program.edges(spans, program.statements(lines)).cache()
    got = {(r.src, r.dst, r.kind) for r in e.collect()}
    assert got == {("MAINP.<preamble>", "MAINP.P1", "perform"), ("MAINP.<preamble>", "MAINP.P2", "perform"), ("MAINP.P1", "OTHER.O1", "call"), ("MAINP.P2", "MAINP.P3", "goto"), ("MAINP.P1", "MAINP.P2", "fallthrough"), ("MAINP.DEADP", "MAINP.P3", "fallthrough")}
    nodes = spans.select("program", F.concat_ws(".", "program", "name").alias("node"), "ord")
    assert {r.node for r in graph.dead(nodes, e, graph.entry_points(nodes).select("node")).collect()} == {"MAINP.DEADP"}


def test_sites(lines):
    got = {(r.verb, r.role, r.name) for r in program.sites(program.statements(lines.filter("program = 'MAINP'"))).collect()}
    assert got == {("IF", "use", "A"), ("MOVE", "use", "A"), ("MOVE", "def", "YY-C"), ("ADD", "use", "A"), ("ADD", "use", "B"), ("ADD", "def", "B"), ("COMPUTE", "use", "A"), ("COMPUTE", "use", "TBL"), ("COMPUTE", "def", "B")}


def test_append_new_skips_held_keys_and_refuses_repeats(spark, tmp_path):
    at = str(tmp_path / "t")
    assert files.append_new(spark.createDataFrame([("a",), ("b",)], "k string"), at, "k") == 2
    assert files.append_new(spark.createDataFrame([("b",), ("c",)], "k string"), at, "k") == 1
    assert sorted(r.k for r in spark.read.parquet(at).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        files.append_new(spark.createDataFrame([("d",), ("d",)], "k string"), at, "k")


def test_jsonl_is_strict(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nno\n')
    assert files.read_jsonl(spark, str(tmp_path / "g.jsonl"), "a int").count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()
