from __future__ import annotations

import random

import pytest

from gneiss.operators import parse, program, slices

HEAD = ["       PROGRAM-ID. P.", "       PROCEDURE DIVISION.", "       MAIN-P."]


def tree(spark, *bodies: str) -> list:
    """Statements of one paragraph; the first body is on line 4."""
    rows = [("P", "f", i, b) for i, b in enumerate([*HEAD, *("           " + b for b in bodies)], 1)]
    return program.statements(spark.createDataFrame(rows, "program string, file string, line_no int, text string")).orderBy("ord").collect()


def places(rows) -> list[tuple]:
    return [(r.verb, r.line_start, r.depth, r.parent, r.branch, list(r.guards)) for r in rows]


def test_a_full_stop_ends_a_statement_whatever_the_verb(spark):
    got = tree(spark, "MOVE D TO B SORT-IT.", "SORT WORK-FILE ON ASCENDING KEY E.", "RETURN WORK-FILE. RELEASE REC-T. CANCEL 'X'.", "MERGE A ON KEY B. NEXT SENTENCE.")
    assert [(r.verb, r.text, r.line_start, r.line_end) for r in got][:2] == [("MOVE", "MOVE D TO B SORT-IT", 4, 4), ("SORT", "SORT WORK-FILE ON ASCENDING KEY E", 5, 5)]
    assert [r.verb for r in got][2:] == ["RETURN", "RELEASE", "CANCEL", "MERGE", "NEXT"]


def test_phrases_hold_what_follows_them(spark):
    got = tree(spark, "READ F AT END", "MOVE 1 TO E MOVE 2 TO G", "NOT AT END READ H INVALID KEY MOVE 3 TO E END-READ", "MOVE 4 TO E.", "MOVE 5 TO E.")
    assert places(got) == [
        ("READ", 4, 0, None, None, []), ("AT END", 4, 1, 1, None, [4]), ("MOVE", 5, 1, 2, "AT END", [4, 4]), ("MOVE", 5, 1, 2, "AT END", [4, 4]),
        ("NOT AT END", 6, 1, 1, None, [4]), ("READ", 6, 1, 5, "NOT AT END", [4, 6]), ("INVALID KEY", 6, 2, 6, "NOT AT END", [4, 6, 6]), ("MOVE", 6, 2, 7, "INVALID KEY", [4, 6, 6, 6]),
        ("MOVE", 7, 1, 5, "NOT AT END", [4, 6]), ("MOVE", 8, 0, None, None, []),
    ]
    assert got[0].block_end == 7 and got[5].block_end == 6


def test_else_belongs_to_the_nearest_open_if(spark):
    got = tree(spark, "IF A = 1", "IF B = 1 MOVE 1 TO C ELSE MOVE 2 TO C END-IF", "ELSE IF D = 1", "MOVE 3 TO C ELSE MOVE 4 TO C.", "MOVE 5 TO C.")
    assert [(r.verb, r.depth, r.parent, r.branch) for r in got] == [
        ("IF", 0, None, None), ("IF", 1, 1, "THEN"), ("MOVE", 2, 2, "THEN"), ("ELSE", 1, 1, "THEN"), ("MOVE", 2, 4, "ELSE"),
        ("ELSE", 0, None, None), ("IF", 1, 6, "ELSE"), ("MOVE", 2, 7, "THEN"), ("ELSE", 1, 6, "ELSE"), ("MOVE", 2, 9, "ELSE"), ("MOVE", 0, None, None),
    ]
    assert [r.block_end for r in got[:2]] == [5, 5] and got[5].block_end == 7


def test_loops_cases_searches_and_jumps(spark):
    got = tree(spark, "PERFORM UNTIL A = 1", "EVALUATE TRUE WHEN A = 2", "WHEN OTHER EXIT PERFORM", "END-EVALUATE END-PERFORM", "SEARCH ALL T AT END CONTINUE WHEN K(I) = 1 MOVE 1 TO B.", "GO TO P1, P2 P3 DEPENDING ON X.", "PERFORM P1 THRU P2 UNTIL A = 1.")
    assert [(r.kind, r.verb, r.depth, r.branch) for r in got] == [
        ("PERFORM_LOOP", "PERFORM", 0, None), ("EVALUATE", "EVALUATE", 1, "LOOP"), ("WHEN", "WHEN", 2, "LOOP"), ("WHEN", "WHEN", 2, "LOOP"), ("OTHER", "EXIT", 2, "WHEN"),
        ("OTHER", "SEARCH", 0, None), ("PHRASE", "AT END", 1, None), ("OTHER", "CONTINUE", 1, "AT END"), ("WHEN", "WHEN", 1, None), ("MOVE", "MOVE", 1, "WHEN"), ("GOTO", "GO", 0, None), ("PERFORM_CALL", "PERFORM", 0, None),
    ]
    assert got[0].block_end == 7 and list(got[10].targets) == ["P1", "P2", "P3"] and got[10].target == "P1"


def test_words_that_only_look_like_verbs(spark):
    got = tree(spark, "READ F NEXT RECORD INTO X.", "SET P TO ENTRY 'E'. MOVE FREE TO COMMIT.", "STRING A DELIMITED BY SIZE INTO B. FREE P.", "DISPLAY 'MOVE A TO B. IF' X. XML GENERATE A FROM B.", "ELSE END-IF WHEN. ADD 1 TO A ON SIZE.")
    assert [r.verb for r in got] == ["READ", "SET", "MOVE", "STRING", "FREE", "DISPLAY", "XML", "ADD"]


def test_the_automaton_by_rebuilding_texts(spark):
    """Trees made at random, written down with all terminators and read again."""
    rnd = random.Random(5)
    want: list[tuple] = []

    def made(depth: int, parent, branch) -> list[str]:
        out = []
        for _ in range(rnd.randint(1, 3)):
            kind = rnd.choice(["MOVE", "IF", "READ", "EVALUATE", "PERFORM"] if depth < 4 else ["MOVE"])
            want.append((kind, depth, parent, branch))
            me = len(want)
            if kind == "MOVE":
                out.append("MOVE A TO B")
            elif kind == "IF":
                out += ["IF A = 1", *made(depth + 1, me, "THEN")]
                if rnd.random() < 0.5:
                    want.append(("ELSE", depth, parent, branch))
                    out += ["ELSE", *made(depth + 1, len(want), "ELSE")]
                out.append("END-IF")
            elif kind == "READ":
                out.append("READ F")
                for phrase in rnd.sample(["AT END", "NOT AT END"], rnd.randint(0, 2)):
                    want.append((phrase, depth + 1, me, branch))
                    out += [phrase, *made(depth + 1, len(want), phrase)]
                out.append("END-READ")
            elif kind == "EVALUATE":
                out.append("EVALUATE A")
                for _ in range(rnd.randint(1, 2)):
                    want.append(("WHEN", depth + 1, me, branch))
                    out += ["WHEN 1", *made(depth + 1, len(want), "WHEN")]
                out.append("END-EVALUATE")
            else:
                out += ["PERFORM UNTIL A = 1", *made(depth + 1, me, "LOOP"), "END-PERFORM"]
        return out

    bodies = made(0, None, None)
    while len(bodies) < 400:
        bodies[-1] += "."
        bodies += made(0, None, None)
    assert [(r.verb, r.depth, r.parent, r.branch) for r in tree(spark, *bodies)] == want


def test_long_sentences_take_steps_in_proportion():
    rows = [{"ord": k, "kind": "IF" if k % 2 else "MOVE", "verb": "IF" if k % 2 else "MOVE", "line_start": k, "line_end": k} for k in range(1, 401)]
    got = list(parse.nest(rows))
    assert got[-1][2] == 200 and got[0][5] == 400


@pytest.mark.parametrize("text", ["", "       PROCEDURE DIVISION."])
def test_programs_without_statements(spark, text):
    assert program.statements(spark.createDataFrame([("P", "f", 1, text), ("P", "f", 2, None)], "program string, file string, line_no int, text string")).count() == 0


def test_slices_know_what_phrases_decide(spark):
    rows = [*HEAD, "           READ F INTO A", "               AT END", "                   MOVE D TO E.", "           MOVE 1 TO D."]
    lines = spark.createDataFrame([("P", "f", i, b) for i, b in enumerate(rows, 1)], "program string, file string, line_no int, text string")
    fields = spark.createDataFrame([("P", k, k, 1, n, None, n, [], None, False) for k, n in enumerate("ADE", 1)], program.FIELDS)
    stmts = program.statements(lines)
    asked = spark.createDataFrame([("P", "E")], "program string, variable string")
    got = {r.line_start for r in slices.slices(asked, stmts, program.sites(stmts), fields).collect()}
    assert got == {4, 5, 6, 7}
