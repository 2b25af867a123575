"""Queries of the statement tree and what reads it, over programs with nested scopes, phrases and computed jumps.

Every order is written as a program T<orderkey> of n paragraphs, one a line of the order (by number, part, supplier, ...),
twenty lines each. The operators see text alone; the SQL beside each query knows the shape and the order, and never sees text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import program
from gneiss.plans.programs import _by_order, _kept
from gneiss.plans.registry import _ORDER, query

_HEAD = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. T{k}.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01  TOTALS.
           05  TOTAL PIC 9(9).
           05  FLAG PIC 9.
               88  FLAG-ON VALUE 1.
           05  NOTE-V PIC X(4) VALUE 'N'.
           05  NOTE-N REDEFINES NOTE-V PIC 9(4)."""

_BODY = """\
       P{i}.
           READ IN-F INTO F{i}
               AT END MOVE 1 TO TOTAL
                   IF F{i} = {p}
                       ADD 1 TO TOTAL
                   ELSE
                       SUBTRACT 1 FROM TOTAL
                           ON SIZE ERROR DISPLAY 'S'
                   END-IF
               NOT AT END MOVE NOTE-N TO F{i}
           END-READ
           EVALUATE F{i}
               WHEN {q}
                   IF FLAG-ON PERFORM P{next} ELSE GO P1 P{n} DEPENDING FLAG
               WHEN OTHER
                   CONTINUE
           END-EVALUATE.
           MOVE TOTAL TO F{i}.
           SORT WORK-F ON ASCENDING KEY F{i} USING IN-F GIVING OUT-F.
           {last}"""

_LAST = {
    "R": "IF TOTAL = 1 NEXT SENTENCE ELSE DISPLAY 'N' STOP RUN.",
    "A": "ADD 1 TO FLAG SIZE ERROR GOBACK NOT SIZE ERROR EXIT PERFORM.",
    "N": "WRITE REC-T INVALID KEY CALL 'SUB' ON EXCEPTION STOP RUN.",
}


def _filled(shape: str, **values):
    """A text with columns in its gaps."""
    out, rest = [], shape
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(before), values[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def _programs(spark: SparkSession, d: str) -> DataFrame:
    """(program, file, text) of every order."""
    own = _by_order(spark, d, "T").withColumnRenamed("l_orderkey", "k")
    n = F.size("ls")
    last = lambda x: F.when(x["flag"] == "R", _LAST["R"]).when(x["flag"] == "A", _LAST["A"]).otherwise(_LAST["N"])
    body = F.transform("ls", lambda x: _filled(_BODY, i=x["i"], p=x["p"], q=x["q"], next=x["i"] % n + 1, n=n, last=last(x)))
    fields = F.transform("ls", lambda x: _filled("           05  F{i} PIC 9(4) VALUE {q}.", i=x["i"], q=x["q"]))
    text = F.array_join(F.concat(F.array(_filled(_HEAD, k=F.col("k"))), fields, F.array(F.lit("       PROCEDURE DIVISION.")), body), "\n")
    return own.select("program", "file", F.concat(text, F.lit("\n")).alias("text"))


# what stands in a paragraph, by place (off: its line, p: the place of its parent, g: lines of its guards, e: its last line)
_SHAPE = """shape(j, flag, off, kind, verb, depth, p, branch, g, e) AS (VALUES
(1, '', 2, 'OTHER', 'READ', 0, NULL, NULL, []::INT[], 10), (2, '', 3, 'PHRASE', 'AT END', 1, 1, NULL, [2], 8), (3, '', 3, 'MOVE', 'MOVE', 1, 2, 'AT END', [2, 3], 3),
(4, '', 4, 'IF', 'IF', 1, 2, 'AT END', [2, 3], 5), (5, '', 5, 'OTHER', 'ADD', 2, 4, 'THEN', [2, 3, 4], 5), (6, '', 6, 'ELSE', 'ELSE', 1, 2, 'AT END', [2, 3, 4], 8),
(7, '', 7, 'OTHER', 'SUBTRACT', 2, 6, 'ELSE', [2, 3, 4], 8), (8, '', 8, 'PHRASE', 'ON SIZE ERROR', 3, 7, 'ELSE', [2, 3, 4, 7], 8), (9, '', 8, 'OTHER', 'DISPLAY', 3, 8, 'ON SIZE ERROR', [2, 3, 4, 7, 8], 8),
(10, '', 10, 'PHRASE', 'NOT AT END', 1, 1, NULL, [2], 10), (11, '', 10, 'MOVE', 'MOVE', 1, 10, 'NOT AT END', [2, 10], 10), (12, '', 12, 'EVALUATE', 'EVALUATE', 0, NULL, NULL, [], 17),
(13, '', 13, 'WHEN', 'WHEN', 1, 12, NULL, [12], 14), (14, '', 14, 'IF', 'IF', 1, 13, 'WHEN', [12, 13], 14), (15, '', 14, 'PERFORM_CALL', 'PERFORM', 2, 14, 'THEN', [12, 13, 14], 14),
(16, '', 14, 'ELSE', 'ELSE', 1, 13, 'WHEN', [12, 13, 14], 14), (17, '', 14, 'GOTO', 'GO', 2, 16, 'ELSE', [12, 13, 14], 14), (18, '', 15, 'WHEN', 'WHEN', 1, 12, NULL, [12], 17),
(19, '', 16, 'OTHER', 'CONTINUE', 1, 18, 'WHEN', [12, 15], 16), (20, '', 18, 'MOVE', 'MOVE', 0, NULL, NULL, [], 18), (21, '', 19, 'OTHER', 'SORT', 0, NULL, NULL, [], 19),
(22, 'R', 20, 'IF', 'IF', 0, NULL, NULL, [], 20), (23, 'R', 20, 'OTHER', 'NEXT', 1, 22, 'THEN', [20], 20), (24, 'R', 20, 'ELSE', 'ELSE', 0, NULL, NULL, [20], 20), (25, 'R', 20, 'OTHER', 'DISPLAY', 1, 24, 'ELSE', [20], 20), (26, 'R', 20, 'OTHER', 'STOP', 1, 24, 'ELSE', [20], 20),
(22, 'A', 20, 'OTHER', 'ADD', 0, NULL, NULL, [], 20), (23, 'A', 20, 'PHRASE', 'ON SIZE ERROR', 1, 22, NULL, [20], 20), (24, 'A', 20, 'OTHER', 'GOBACK', 1, 23, 'ON SIZE ERROR', [20, 20], 20), (25, 'A', 20, 'PHRASE', 'NOT ON SIZE ERROR', 1, 22, NULL, [20], 20), (26, 'A', 20, 'OTHER', 'EXIT', 1, 25, 'NOT ON SIZE ERROR', [20, 20], 20),
(22, 'N', 20, 'OTHER', 'WRITE', 0, NULL, NULL, [], 20), (23, 'N', 20, 'PHRASE', 'INVALID KEY', 1, 22, NULL, [20], 20), (24, 'N', 20, 'CALL', 'CALL', 1, 23, 'INVALID KEY', [20, 20], 20), (25, 'N', 20, 'PHRASE', 'ON EXCEPTION', 2, 24, 'INVALID KEY', [20, 20, 20], 20), (26, 'N', 20, 'OTHER', 'STOP', 2, 25, 'ON EXCEPTION', [20, 20, 20, 20], 20))"""

_L = f"""li AS (SELECT l_orderkey AS k, l_partkey AS part, CAST(l_quantity AS INTEGER) AS q, CASE WHEN l_returnflag IN ('R', 'A') THEN l_returnflag ELSE 'N' END AS own, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
l AS (SELECT *, 'T' || k AS program, CAST(11 + n + 20 * (i - 1) AS INTEGER) AS b FROM li),
{_SHAPE}, s AS (SELECT l.*, shape.* EXCLUDE (flag) FROM l JOIN shape ON flag = '' OR flag = own)"""


@query(f"""WITH {_L}, told AS (SELECT *, concat_ws(' ', 26 * (i - 1) + j, kind, verb, b + off, depth, coalesce(26 * (i - 1) + p, 0), coalesce(branch, '-'), '[' || array_to_string(list_transform(g, lambda x: b + x), ',') || ']', b + e) AS line FROM s)
SELECT program, 'P' || i AS paragraph, count(*) AS n_statements, CAST(max(depth) AS BIGINT) AS deepest, CAST(max(len(g)) AS INTEGER) AS most_guards, count(*) FILTER (p IS NOT NULL) AS inner_statements, md5(string_agg(line, chr(10) ORDER BY j)) AS tree FROM told GROUP BY program, i""")
def program_tree(spark, d):
    """Every paragraph's statements with kind, verb, line, depth, parent, branch, guards and last line: a line each, told by the md5 of all, in order."""
    return program.trees_of(_programs(spark, d)).select("program", "paragraph", "n_statements", "deepest", "most_guards", "inner_statements", "tree")


@query(f"""WITH {_L} SELECT program, 'P' || i AS src, b + 14 AS line, 'perform' AS kind, 'P' || (i % n + 1) AS dst FROM l UNION ALL SELECT program, 'P' || i, b + 14, 'goto', unnest(['P1', 'P' || n]) FROM l
UNION ALL SELECT program, 'P' || i, b + 20, 'call', '' FROM l WHERE own = 'N'""")
def program_computed_jumps(spark, d):
    """Each target of a GO TO ... DEPENDING ON is a way of its own."""
    flows = _kept(program.flows_of(_programs(spark, d), blocks=False), "flows")
    return program.arrived(flows).select("program", "src", "line", "kind", "dst")
