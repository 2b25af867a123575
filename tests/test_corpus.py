"""Name resolution, traces, slices, ways of control, the tool API and mutations, on small programs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gneiss.operators import mutate, program, slices, tools
from gneiss.sources import executor, files

ACCT = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. ACCT.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  REC-A.
           05  AMT        PIC 9(4) VALUE 30.
           05  KIND       PIC X.
               88  IS-LATE    VALUE 'L' 'M'.
           05  FEE        PIC 9(4).
       01  REC-B.
           05  AMT        PIC 9(4).
           05  SHADOW REDEFINES AMT PIC X(4).
       01  LIMIT-V        PIC 9(4) VALUE 45.
       01  SPARE          PIC 9(5).
       PROCEDURE DIVISION.
       MAIN-PARA.
      * CHECK the customer record
           PERFORM CALC-PARA THRU LAST-PARA.
           PERFORM GONE-PARA.
           CALL 'OTHER'.
           CALL WS-NAME.
           GOBACK.
       CALC-PARA.
           IF AMT OF REC-A > LIMIT-V AND IS-LATE
               MOVE AMT OF REC-A TO FEE
           ELSE
               MOVE 0 TO FEE
           END-IF.
           EVALUATE KIND
               WHEN 'L'
                   ADD 1 TO FEE
           END-EVALUATE.
       LAST-PARA.
           EXEC CICS LINK PROGRAM('OTHER') END-EXEC.
           EXEC CICS XCTL PROGRAM(WS-NEXT) END-EXEC.
           GO TO NOWHERE.
       DEAD-PARA.
           DISPLAY FEE.
"""
OTHER = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. OTHER.
       PROCEDURE DIVISION.
       FIRST-PARA.
           DISPLAY 'HI'.
"""


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    for name, text in (("acct.cbl", ACCT), ("other.cbl", OTHER)):
        (at / "src").mkdir(exist_ok=True)
        (at / "src" / name).write_text(text)
    (at / "cpy").mkdir()
    (at / "cpy" / "book.cpy").write_text("".join(f"           05  B-{i}  PIC X.\n" for i in range(70)))
    return tools.Corpus.load(spark, str(at / "src"), [str(at / "cpy")])


def line(text: str) -> int:
    return next(i for i, x in enumerate(ACCT.split("\n"), 1) if text in x)


def test_ways_of_control(corpus):
    ways = program.transfers(corpus.spans, corpus.statements, program.blocks(corpus.masked)).collect()
    found = {(r.src, r.kind, r.dst_program, r.dst) for r in ways if r.reason is None}
    assert found == {("MAIN-PARA", "perform", "ACCT", "CALC-PARA"), ("MAIN-PARA", "perform", "ACCT", "LAST-PARA"), ("MAIN-PARA", "call", "OTHER", "FIRST-PARA"), ("LAST-PARA", "link", "OTHER", "FIRST-PARA")}
    assert {(r.src, r.kind, r.reason) for r in ways if r.reason} == {("MAIN-PARA", "perform", "unknown paragraph"), ("MAIN-PARA", "call", "dynamic"), ("LAST-PARA", "xctl", "dynamic"), ("LAST-PARA", "goto", "unknown paragraph")}


def test_a_link_without_a_program_is_an_error(spark, corpus):
    bad = spark.createDataFrame([("ACCT", "f", "exec_cics", line("LINK"), line("LINK"), "EXEC CICS LINK COMMAREA(X) END-EXEC")], "program string, file string, kind string, line_start int, line_end int, text string")
    with pytest.raises(Exception, match="no PROGRAM"):
        program.transfers(corpus.spans, corpus.statements, bad).collect()


def test_names_are_resolved(spark, corpus):
    asked = spark.createDataFrame([("ACCT", n) for n in ("amt", "AMT in REC-B", "IS-LATE OF REC-A", "NONE", "FEE")], "program string, name string")
    out = {}
    for r in slices.resolved(asked, corpus.fields).collect():
        out.setdefault(r.name, []).append((r.field_name, r.record, r.ambiguous))
    assert sorted(out["amt"]) == [("AMT", "REC-A", True), ("AMT", "REC-B", True)]
    assert out["AMT in REC-B"] == [("AMT", "REC-B", False)] and out["IS-LATE OF REC-A"] == [("KIND", "REC-A", False)] and out["FEE"] == [("FEE", "REC-A", False)]
    assert "NONE" not in out


def test_traces(corpus):
    sites = [(s.role, s.ref.line_start, s.verb) for s in corpus.trace_variable("amt of rec-b", "acct").sites]
    assert ("def", line("SHADOW"), "REDEFINES-alias") in sites and all(v != "VALUE-clause" for _, _, v in sites)
    both = {(s.role, s.ref.line_start, s.verb) for s in corpus.trace_variable("AMT").sites}
    assert ("def", line("VALUE 30"), "VALUE-clause?ambiguous") in both and ("use", line("MOVE AMT"), "MOVE?ambiguous") in both
    assert {s.verb for s in corpus.trace_variable("KIND").sites} == {"IF", "EVALUATE"}  # by its condition name, and as a subject


def test_slices(corpus):
    cut = corpus.slice_on("FEE", "ACCT")
    lines = {s.line_start for s in cut.statements}
    for text in ("IF AMT", "MOVE AMT", "MOVE 0", "EVALUATE", "WHEN 'L'", "ADD 1", "VALUE 30", "VALUE 45"):
        assert line(text) in lines, text
    assert line("DISPLAY FEE") not in lines and not cut.is_interprocedural
    assert [n.paragraph for n in cut.paragraphs] == ["CALC-PARA"]
    assert corpus.slice_on("NONE").statements == []


def test_slices_over_paragraphs_have_the_ways_between_them(spark):
    text = "\n".join(["       PROGRAM-ID. G.", "       DATA DIVISION.", "       01  A PIC 9.", "       01  B PIC 9.", "       PROCEDURE DIVISION.", "       P0.", "           PERFORM P1.", "           PERFORM P2.", "           GOBACK.", "       P1.", "           MOVE 1 TO A.", "       P2.", "           MOVE A TO B."])
    lines = files.program_lines(spark.createDataFrame([("G", "g", text)], "program string, file string, text string"))
    stmts = program.statements(lines)
    fields = program.fields(lines.withColumn("at", F.array("line_no")))
    asked = spark.createDataFrame([("G", "B")], "program string, variable string")
    out = {(r.line_start, r.why) for r in slices.slices(asked, stmts, program.sites(stmts), fields, program.paragraphs(lines)).collect()}
    assert out == {(11, "dependence"), (13, "dependence"), (7, "glue"), (8, "glue")}
    small = slices.slices(asked, stmts, program.sites(stmts), fields, most=1).collect()
    assert len(small) == 1 and "more than 1" in small[0].error
    assert slices.crosses(slices.slices(asked, stmts, program.sites(stmts), fields)).first().is_interprocedural


def test_reading(corpus):
    view = corpus.read_paragraph("acct", "calc-para")
    assert view.name == "CALC-PARA" and view.code.startswith("       CALC-PARA.") and not view.truncated
    assert view.callers == [tools.Node("ACCT", "MAIN-PARA")] and corpus.find_callees("ACCT", "MAIN-PARA")[-1] == tools.Node("OTHER", "FIRST-PARA")
    assert [p.paragraph for p in corpus.read_program("ACCT").paragraphs] == ["MAIN-PARA", "CALC-PARA", "LAST-PARA", "DEAD-PARA"]
    assert corpus.find_callers("ACCT", "NO-SUCH") == []
    book = corpus.resolve_copybook("book")
    assert book.truncated and len(book.text.split("\n")) == tools.CODE_LINES
    for wrong in (lambda: corpus.read_paragraph("ACCT", "X"), lambda: corpus.read_program("X"), lambda: corpus.find_callers("X", "Y"), lambda: corpus.slice_on("FEE", "X"), lambda: corpus.resolve_copybook("X"), lambda: corpus.get_data_layout("X")):
        with pytest.raises(tools.LookupFailed):
            wrong()


def test_layout_and_grep(corpus):
    a = corpus.get_data_layout("rec-a")
    assert [(c.name, c.pic, [k.name for k in c.children]) for c in a.root.children] == [("AMT", "9(4)", []), ("KIND", "X", ["IS-LATE"]), ("FEE", "9(4)", [])]
    assert (a.source.line_start, a.source.line_end) == (line("REC-A."), line("05  FEE"))
    assert corpus.get_data_layout("REC-B").root.children[1].redefines == "AMT"
    found = corpus.grep("fee")
    assert not found.truncated and {m["line"] for m in found.matches} == {i for i, x in enumerate(ACCT.split("\n"), 1) if "FEE" in x}
    assert len(corpus.grep("PIC|05|.").matches) == len(ACCT.splitlines()) + len(OTHER.splitlines()) + 70


def test_calls_never_raise(corpus):
    assert corpus.call("drop_tables")["error"].startswith("LookupFailed")
    assert corpus.call("read_program", program="X")["error"] and corpus.call("read_program", name=1)["error"].startswith("TypeError")
    seen = corpus.call("read_program", program="OTHER")
    assert seen["error"] is None and json.loads(seen["observation"])["program"] == "OTHER"
    assert corpus.call("run_program", snippet="DISPLAY 'A'")["observation"] and corpus.run_program("DISPLAY 'A'")["stdout"] == "A\n"
    assert not corpus.run_program("EXEC CICS RETURN END-EXEC")["compiled"]


# mutations ----------------------------------------------------------------------------------------------------------


def asks(spark, *rows):
    full = [(r.get("program", "ACCT"), r["op"], r.get("variables", []), r.get("value"), r.get("kind"), r.get("floor", False), r.get("priors", []), r.get("other")) for r in rows]
    return spark.createDataFrame(full, "program string, op string, variables array<string>, value double, kind string, floor boolean, priors array<double>, other string")


def edited(corpus, asked) -> dict:
    edits = mutate.plan(corpus.lines, asked)
    made = mutate.mutated(corpus.lines, edits).orderBy("op", "line_no").collect()
    out: dict = {}
    for r in made:
        out.setdefault(r.op, []).append(r.text)
    return out


def test_mutations(spark, corpus):
    out = edited(corpus, asks(spark, {"op": "MO-1", "variables": ["LIMIT-V"], "value": 45.0, "kind": "duration_days"}, {"op": "MO-2", "variables": ["AMT"]}, {"op": "MO-3", "variables": ["AMT"]}, {"op": "MO-4", "variables": ["IS-LATE"]}, {"op": "MO-5", "variables": ["AMT"]}))
    n = len(ACCT.splitlines())
    assert "VALUE 60." in out["MO-1"][line("VALUE 45") - 1] and len(out["MO-1"]) == n
    kept = out["MO-2"]
    assert len(kept) == n - 2 and kept[line("IF AMT") - 1].strip() == "IF AMT OF REC-A <= LIMIT-V AND IS-LATE" and kept[line("IF AMT")].strip() == "MOVE 0 TO FEE" and mutate.structural
    assert out["MO-3"][line("IF AMT") - 1].strip() == "IF AMT OF REC-A > LIMIT-V"
    assert out["MO-4"][line("88  IS-LATE") - 1].strip() == "88  IS-LATE    VALUE 'L'."
    assert ">= LIMIT-V" in out["MO-5"][line("IF AMT") - 1]
    other = edited(corpus, asks(spark, {"op": "MO-4", "variables": ["IS-LATE"], "other": "Z"}, {"op": "MO-1", "variables": ["X"], "value": 45.0, "kind": "count", "priors": [45.0, 20.0]}))
    assert "'L' 'Z'." in other["MO-4"][line("88  IS-LATE") - 1] and "VALUE 20." in other["MO-1"][line("VALUE 45") - 1]


def test_rejected_and_wrong_edits(spark, corpus):
    asked = asks(spark, {"op": "MO-1", "value": 999.0, "kind": "count"}, {"op": "MO-6", "variables": ["CALC-PARA"]}, {"op": "MO-6", "program": "OTHER", "variables": ["X"]}, {"op": "MO-6", "program": "ACCT", "variables": ["GONE-PARA"]})
    edits = mutate.plan(corpus.lines, asked)
    assert [tuple(r) for r in mutate.rejected(asked, edits).select("program", "op").orderBy("program").collect()] == [("ACCT", "MO-1"), ("OTHER", "MO-6")]
    wrong = spark.createDataFrame([("ACCT", "x", 1, 8, "NO SUCH", "Y")], "program string, op string, line_no int, start int, old string, new string")
    with pytest.raises(Exception, match="does not fit"):
        mutate.mutated(corpus.lines, wrong).collect()


def test_benign_changes(spark, corpus):
    inert = mutate.inert_sites(corpus.lines, corpus.fields, corpus.sites)
    assert {(r.line_no, r.token) for r in inert.collect()} >= {(line("SPARE"), "5")} and not any(r.line_no in (line("05  FEE"), line("LIMIT-V    ")) for r in inert.collect())
    asked, none = asks(spark, {"op": "MO-0"}), spark.createDataFrame([], "value double")
    first = mutate.benign(corpus.lines, asked, inert, none).first()
    assert (first.old, first.new) == (inert.orderBy("line_no").first().token, str(int(inert.orderBy("line_no").first().token) + 1))
    denied = spark.createDataFrame([(float(i),) for i in range(10)], "value double")
    note = mutate.benign(corpus.lines, asked, inert, denied).first()
    assert note.line_no == line("* CHECK") and note.new == note.old + "."
    made = mutate.diversified(corpus.lines, spark.createDataFrame([], "program string, line_no int"), 7).orderBy("program", "line_no").collect()
    assert len(made) == len(ACCT.splitlines()) + len(OTHER.splitlines()) and sum(r.text != t for r, t in zip(made, ACCT.splitlines() + OTHER.splitlines(), strict=True)) == 1
    swap = mutate.renamed(corpus.lines, spark.createDataFrame([("ACCT", "FEE", "CHARGE")], "program string, old string, new string"))
    assert not any("FEE" in r.text for r in swap.filter("program = 'ACCT'").collect())
    with pytest.raises(Exception, match="name taken"):
        mutate.renamed(corpus.lines, spark.createDataFrame([("ACCT", "FEE", "AMT")], "program string, old string, new string")).collect()


def test_loci(spark, corpus):
    edits = mutate.plan(corpus.lines, asks(spark, {"op": "MO-2", "variables": ["AMT"]}))
    assert [(r.paragraph, r.line_start, r.line_end) for r in mutate.loci(edits, corpus.spans).collect()] == [("CALC-PARA", line("IF AMT"), line("ELSE"))]


# executor -----------------------------------------------------------------------------------------------------------


def test_the_executor(spark):
    assert executor.safe_names(["a/b.txt", "c"]) == ["a/b.txt", "c"]
    for bad in (["/a"], ["../a"], ["a", "A"], ["nul"], ["C:\\x"], ["a", "a/b"], [" "]):
        with pytest.raises(ValueError):
            executor.safe_names(bad)
    assert executor.require_version("cobc (GnuCOBOL) 3.1.2.0") == (3, 1, 2)
    for bad in ("cobc 2.2.0", "cobc 4.0.0"):
        with pytest.raises(RuntimeError):
            executor.require_version(bad)
    assert executor.capped(b"x" * 10, 4) == "xxxx" + executor.CUT and executor.diagnostics("a.cbl:1: error: no\nok") == ["a.cbl:1: error: no"]
    assert executor.wrap("DISPLAY 'X'").count("\n") == 6 and executor.wrap(ACCT) == ACCT
    rows = spark.createDataFrame([("1", "DISPLAY 'X'", None)], "id string, text string, stdin string")
    assert not executor.executed(rows, None).first().available
    got = executor.executed(rows, lambda text, inputs: executor.displayed_result(text) | {"files": {}}).first()
    assert got.available and got.compiled and got.stdout == "X\n"


def test_catalogue(spark, corpus):
    asked = asks(spark, {"op": "MO-5", "variables": ["AMT"]}, {"op": "MO-5#2", "variables": ["AMT"]}, {"op": "MO-1", "variables": ["LIMIT-V"], "value": 45.0, "kind": "duration_days"}, {"op": "MO-2", "program": "OTHER"}, {"op": "MO-4", "variables": ["IS-LATE"]})
    targets = spark.createDataFrame([("D5_boundary_error", 5), ("D1_stale_threshold", 1), ("D4_stale_reference_data", 0)], "drift_type string, target int")
    made, out = mutate.catalogue(corpus.lines, asked, targets)
    rows = made.collect()
    assert sorted(r.drift_type for r in rows) == ["D1_stale_threshold", "D5_boundary_error", "D5_boundary_error"] or sorted(r.drift_type for r in rows) == ["D1_stale_threshold", "D5_boundary_error"]
    assert all(r.instance_id.startswith("drift_") for r in rows) and any(r.note == "MO-1; old='45'; new='60'" for r in rows)
    assert {(r.program, r.reason) for r in out.collect()} >= {("OTHER", "no edit"), ("ACCT", "over target")}


def test_copybook_edits_and_surface_changes(spark, corpus):
    edits = spark.createDataFrame([("BOOK", "MO-1x", 3, 1, "a", "b")], "program string, op string, line_no int, start int, old string, new string")
    copies = spark.createDataFrame([("P", "book"), ("Q", "BOOK"), ("R", "ELSE")], "program string, name string")
    assert {(r.program, r.is_interprocedural) for r in mutate.through_copybooks(edits, copies).collect()} == {("P", True), ("Q", True)}
    made = mutate.perturbed(corpus.lines, 3).filter("program = 'OTHER'").orderBy("line_no").collect()
    assert made[4].text == "           DISPLAY 'HI '." and len(made) == 5
    text = "\n".join(["       PROGRAM-ID. S.", "       PROCEDURE DIVISION.", "       P0.", "           PERFORM P1.", "           PERFORM P2.", "           GOBACK.", "       P1.", "           GO TO P0.", "       P2.", "           DISPLAY 'X'.", "           GOBACK."])
    lines = files.program_lines(spark.createDataFrame([("S", "s", text)], "program string, file string, text string"))
    spans, stmts = program.paragraphs(lines), program.statements(lines)
    seen = set()
    for seed in range(8):
        new = mutate.reordered(lines, spans, program.transfers(spans, stmts), program.fallthrough(spans, stmts), seed).orderBy("line_no").collect()
        assert [r.line_no for r in new] == list(range(1, 12))
        seen.add(new[6].text.strip())
    assert seen == {"P1.", "P2."}
