"""Queries of the program operators, over fixed-format programs rendered from the driver's orders.

The tables hold no programs, so each order is written as one: a field and a paragraph for each of its lines. The operators
see text alone; the SQL beside each query never does, but tells from the order what the text has to mean.

Program O<orderkey> of an order with n lines, i-th line (by number, part, supplier, ...) with part p, quantity q and flag:
    1-7     divisions, PROGRAM-ID, record TOTALS with TOTAL and LIMIT-V
    7+i     field F<i> with VALUE q
    8+n     PROCEDURE DIVISION
    then six lines a paragraph P<i>: header, IF ... ADD ... END-IF, a PERFORM of P<p mod (n+1) + 1> (unknown if n+1), and
    GO TO P<p mod n + 1> (R), CALL of the next order's program (A), or EXEC CICS XCTL to the one after that (N).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import materialize, program, slices
from gneiss.operators.store import stored
from gneiss.plans.registry import _ORDER, _t, query
from gneiss.sources import files

_HEAD = ["       IDENTIFICATION DIVISION.", None, "       DATA DIVISION.", "       WORKING-STORAGE SECTION.", "       01  TOTALS.", "           05  TOTAL PIC 9(9).", "           05  LIMIT-V PIC 9(4) VALUE 30."]


#: Rows of lineitem in a task: some 20 MB of program text, which is sorted there without spilling.
_DEALT = 25_000


def _by_order(spark: SparkSession, d: str, letter: str, key: str = "program") -> DataFrame:
    """(program, file, l_orderkey, ls): the lines of every order as i, p, q and flag, in order.

    Rows are dealt by program, or by file, once, into as many parts as the table asks for (a count that reads no rows). Spark knows the rows of a program to be together from
    then on, so no later window or group of a program's lines moves them again.
    """
    li = _t(spark, d, "lineitem")
    rows = li.count()
    n = max(-(-rows // _DEALT), min(spark.sparkContext.defaultParallelism, -(-rows // 1000)), 1)
    name = F.concat(F.lit(letter), F.col("l_orderkey").cast("string"))
    own = li.select(name.alias("program"), F.concat(name, F.lit(".cbl")).alias("file"), "l_orderkey", "l_returnflag", *_ORDER.split(", ")).repartition(n, key)
    each = F.array_sort(F.collect_list(F.struct(*_ORDER.split(", "), "l_returnflag")))
    line = lambda x, k: F.struct((k + 1).alias("i"), x["l_partkey"].alias("p"), x["l_quantity"].cast("int").alias("q"), x["l_returnflag"].alias("flag"))
    return own.groupBy("program", "file", "l_orderkey").agg(each.alias("rows")).select("program", "file", "l_orderkey", F.transform("rows", line).alias("ls"))


def _rendered(spark: SparkSession, d: str, key: str = "program") -> DataFrame:
    """(program, file, text) of every order."""
    own = _by_order(spark, d, "O", key).withColumn("n", F.size("ls"))
    s = lambda c: c.cast("string")
    field = lambda x: F.concat(F.lit("           05  F"), s(x["i"]), F.lit(" PIC 9(4) VALUE "), s(x["q"]), F.lit("."))
    last = lambda x: (
        F.when(x["flag"] == "R", F.concat(F.lit("           GO TO P"), s(x["p"] % F.col("n") + 1), F.lit(".")))
        .when(x["flag"] == "A", F.concat(F.lit("           CALL 'O"), s(F.col("l_orderkey") + 1), F.lit("'.")))
        .otherwise(F.concat(F.lit("           EXEC CICS XCTL PROGRAM('O"), s(F.col("l_orderkey") + 2), F.lit("') END-EXEC.")))
    )
    body = lambda x: F.array(
        F.concat(F.lit("       P"), s(x["i"]), F.lit(".")),
        F.concat(F.lit("           IF F"), s(x["i"]), F.lit(" > LIMIT-V")),
        F.concat(F.lit("               ADD F"), s(x["i"]), F.lit(" TO TOTAL")),
        F.lit("           END-IF."),
        F.concat(F.lit("           PERFORM P"), s(x["p"] % (F.col("n") + 1) + 1), F.lit(".")),
        last(x),
    )
    named = F.concat(F.lit("       PROGRAM-ID. O"), s(F.col("l_orderkey")), F.lit("."))
    head = F.array(*(F.lit(x) if x else named for x in _HEAD))
    lines = F.concat(head, F.transform("ls", field), F.array(F.lit("       PROCEDURE DIVISION.")), F.flatten(F.transform("ls", body)))
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    return own.select("program", "file", text.alias("text"))


def _lines(spark, d, key: str = "program") -> DataFrame:
    return files.program_lines(_rendered(spark, d, key))


def _masked(spark, d) -> tuple[DataFrame, DataFrame]:
    """The lines with their masks, and those that are left to parse."""
    left = program.masked(_lines(spark, d))
    return left, left.select("program", "file", "line_no", F.col("masked").alias("text"))


_L = f"""li AS (SELECT l_orderkey AS k, l_partkey AS p, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
l AS (SELECT *, 'O' || k AS program, CAST(8 + n + 6 * (i - 1) AS INTEGER) AS b FROM li)"""


@query(f"""WITH {_L}, o AS (SELECT DISTINCT program, k, n FROM l), x AS (
SELECT program, 1 AS line_no, '       IDENTIFICATION DIVISION.' AS text FROM o UNION ALL SELECT program, 2, '       PROGRAM-ID. ' || program || '.' FROM o UNION ALL SELECT program, 3, '       DATA DIVISION.' FROM o
UNION ALL SELECT program, 4, '       WORKING-STORAGE SECTION.' FROM o UNION ALL SELECT program, 5, '       01  TOTALS.' FROM o UNION ALL SELECT program, 6, '           05  TOTAL PIC 9(9).' FROM o UNION ALL SELECT program, 7, '           05  LIMIT-V PIC 9(4) VALUE 30.' FROM o
UNION ALL SELECT program, 7 + i, '           05  F' || i || ' PIC 9(4) VALUE ' || q || '.' FROM l UNION ALL SELECT program, 8 + n, '       PROCEDURE DIVISION.' FROM o
UNION ALL SELECT program, b + 1, '       P' || i || '.' FROM l UNION ALL SELECT program, b + 2, '           IF F' || i || ' > LIMIT-V' FROM l UNION ALL SELECT program, b + 3, '               ADD F' || i || ' TO TOTAL' FROM l
UNION ALL SELECT program, b + 4, '           END-IF.' FROM l UNION ALL SELECT program, b + 5, '           PERFORM P' || (p % (n + 1) + 1) || '.' FROM l
UNION ALL SELECT program, b + 6, CASE flag WHEN 'R' THEN '           GO TO P' || (p % n + 1) || '.' WHEN 'A' THEN '           CALL ''O' || (k + 1) || '''.' ELSE '           CONTINUE.' END FROM l)
SELECT program, CAST(line_no AS INTEGER) AS line_no, text, regexp_matches(text, 'CONTINUE') AS in_block FROM x""")
def program_masks(spark, d):
    left, _ = _masked(spark, d)
    return left.select("program", "line_no", F.col("masked").alias("text"), F.col("span_kind").isNotNull().alias("in_block"))


@query(f"WITH {_L} SELECT program, CAST(i AS INTEGER) AS ord, 'P' || i AS name, b + 1 AS line_start, b + 6 AS line_end FROM l")
def program_paragraphs(spark, d):
    return program.paragraphs(_masked(spark, d)[1]).select("program", "ord", "name", "line_start", "line_end")


@query(f"""WITH {_L} SELECT program, 'P' || i AS paragraph, kind, b + off AS line_start, CAST(depth AS BIGINT) AS depth, CASE kind WHEN 'PERFORM_CALL' THEN 'P' || (p % (n + 1) + 1) WHEN 'GOTO' THEN 'P' || (p % n + 1) WHEN 'CALL' THEN 'O' || (k + 1) END AS target
FROM (SELECT *, unnest([2, 3, 5, 6]) AS off, unnest(['IF', 'OTHER', 'PERFORM_CALL', CASE flag WHEN 'R' THEN 'GOTO' WHEN 'A' THEN 'CALL' ELSE 'OTHER' END]) AS kind, unnest([0, 1, 0, 0]) AS depth FROM l)""")
def program_statements(spark, d):
    return program.statements_of(_rendered(spark, d)).select("program", "paragraph", "kind", "line_start", "depth", "target")


_FLOWS = f"""{_L}, o AS (SELECT DISTINCT program FROM l), f AS (
SELECT program, 'P' || i AS src, b + 5 AS line, 'perform' AS kind, CASE WHEN p % (n + 1) < n THEN program END AS dst_program, CASE WHEN p % (n + 1) < n THEN 'P' || (p % (n + 1) + 1) END AS dst, CASE WHEN p % (n + 1) = n THEN 'unknown paragraph' END AS reason FROM l
UNION ALL SELECT program, 'P' || i, b + 6, 'goto', program, 'P' || (p % n + 1), NULL FROM l WHERE flag = 'R'
UNION ALL SELECT l.program, 'P' || i, b + 6, CASE flag WHEN 'A' THEN 'call' ELSE 'xctl' END, 'O' || (k + CASE flag WHEN 'A' THEN 1 ELSE 2 END), CASE WHEN o.program IS NULL THEN '' ELSE 'P1' END, NULL FROM l LEFT JOIN o ON o.program = 'O' || (k + CASE flag WHEN 'A' THEN 1 ELSE 2 END) WHERE flag <> 'R')"""


def _kept(df: DataFrame, name: str) -> DataFrame:
    """stored(), joined by sorting only: files of text that repeats itself are a small part of what they hold, so by their size Spark would send them whole through the driver."""
    return stored(df, name).hint("merge")


def _parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return program.outlined_parts(_kept(program.outline_of(_rendered(spark, d)), "outline"))


@query(f"WITH {_FLOWS} SELECT program, src, line, kind, dst_program, dst FROM f WHERE reason IS NULL")
def program_call_graph(spark, d):
    return program.arrived(_kept(program.flows_of(_rendered(spark, d)), "flows")).filter("reason is null").drop("reason")


@query(f"WITH {_FLOWS} SELECT program, src, line, kind, reason FROM f WHERE reason IS NOT NULL")
def program_unresolved(spark, d):
    # a way for which there is a reason leads nowhere, so that no other program is asked
    return program.flows_of(_rendered(spark, d)).filter("reason is not null").select("program", "src", "line", "kind", "reason")


@query(f"""WITH RECURSIVE {_FLOWS}, falls AS (SELECT program, 'P' || i AS src, 'P' || (i + 1) AS dst FROM l WHERE i < n AND flag <> 'R'),
e AS (SELECT program, src, dst FROM f WHERE kind IN ('perform', 'goto') AND dst IS NOT NULL UNION SELECT program, src, dst FROM falls),
r(program, name) AS (SELECT program, 'P1' FROM o UNION SELECT e.program, e.dst FROM r JOIN e ON r.program = e.program AND r.name = e.src)
SELECT l.program, 'P' || i AS name FROM l ANTI JOIN r ON r.program = l.program AND r.name = 'P' || l.i""")
def program_dead_paragraphs(spark, d):
    return program.reach_of(_rendered(spark, d)).filter("distance is null").select("program", "name")


def _fields(spark, d) -> DataFrame:
    lines = files.program_lines(program.declaring(_rendered(spark, d)))
    return program.fields(lines.withColumn("at", F.array("line_no")))


@query(f"""WITH {_L}, o AS (SELECT DISTINCT program FROM l) SELECT program, 1 AS level, 'TOTALS' AS name, CAST(NULL AS VARCHAR) AS parent, 5 AS line_no, FALSE AS has_value FROM o UNION ALL SELECT program, 5, 'TOTAL', 'TOTALS', 6, FALSE FROM o
UNION ALL SELECT program, 5, 'LIMIT-V', 'TOTALS', 7, TRUE FROM o UNION ALL SELECT program, 5, 'F' || i, 'TOTALS', CAST(7 + i AS INTEGER), TRUE FROM l""")
def program_fields(spark, d):
    return _fields(spark, d).select("program", "level", "name", "parent", "line_no", "has_value")


def _found(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statements, sites and fields, each made once."""
    stmts = _kept(program.statements_of(_rendered(spark, d)), "statements")
    return stmts, _kept(program.sites(stmts), "sites"), _kept(_fields(spark, d), "fields")


@query(f"""WITH {_L} SELECT program, line_start, verb, role, name FROM (SELECT program, b + 2 AS line_start, 'IF' AS verb, 'use' AS role, unnest(['F' || i, 'LIMIT-V']) AS name FROM l
UNION ALL SELECT program, b + 3, 'ADD', unnest(['use', 'use', 'def']), unnest(['F' || i, 'TOTAL', 'TOTAL']) FROM l)""")
def program_sites(spark, d):
    return program.sites(program.statements_of(_rendered(spark, d))).select("program", "line_start", "verb", "role", "name")


@query(f"""WITH {_L} SELECT program, 'def' AS role, 7 AS line_start, 'VALUE-clause' AS verb FROM (SELECT DISTINCT program FROM l) UNION ALL SELECT program, 'use', b + 2, 'IF' FROM l""")
def program_trace(spark, d):
    stmts, found, fields = _found(spark, d)
    asked = fields.select("program").distinct().withColumn("variable", F.lit("limit-v of totals"))
    return slices.traces(asked, found, fields).select("program", "role", "line_start", "verb")


@query(f"""WITH {_L}, s AS (SELECT program, 'P' || i AS paragraph, b + unnest([2, 3]) AS line_start, 'dependence' AS why FROM l
UNION ALL SELECT program, NULL, unnest([7, 7 + i]), 'value' FROM l) SELECT DISTINCT program, paragraph, CAST(line_start AS INTEGER) AS line_start, why FROM s""")
def program_slices(spark, d):
    stmts, found, fields = _found(spark, d)
    asked = fields.select("program").distinct().withColumn("variable", F.lit("TOTAL"))
    return slices.slices(asked, stmts, found, fields).select("program", "paragraph", "line_start", "why")


@query(f"""WITH {_FLOWS}, c AS (SELECT dst_program || '.' || dst AS node, list_sort(list_distinct(list(program || '.' || src))) AS callers FROM f WHERE dst IS NOT NULL AND dst <> '' AND kind <> 'xctl' GROUP BY 1)
SELECT program, 'P' || i AS paragraph, coalesce(array_to_string(callers, ','), '') AS callers FROM l LEFT JOIN c ON node = program || '.P' || i""")
def program_writers(spark, d):
    spans, ways, _ = _parts(spark, d)
    fields = _kept(_fields(spark, d), "fields")
    asked = fields.select("program").distinct().withColumn("variable", F.lit("TOTAL"))
    found = slices.writers_and_callers(_kept(program.sites(program.statements_of(_rendered(spark, d))), "sites"), fields, program.edges(spans, ways), asked)
    return found.select("program", "paragraph", F.array_join("callers", ",").alias("callers"))


# What each order's program is edited by, told from the number of its lines and its key: a limit's comparison on one line (undone
# again), a rule taken out of its three lines (recorded on one line, found by the last of them), a fragment that isn't there, one that
# stands twice in its line, and a note without its values.
_EDITED = f"""{_L}, o AS (SELECT program, k, max(n) AS n, k % 5 AS way FROM l GROUP BY program, k), x AS (
SELECT program, 1 AS line_no, '       IDENTIFICATION DIVISION.' AS text, 0 AS i FROM o UNION ALL SELECT program, 2, '       PROGRAM-ID. ' || program || '.', 0 FROM o UNION ALL SELECT program, 3, '       DATA DIVISION.', 0 FROM o
UNION ALL SELECT program, 4, '       WORKING-STORAGE SECTION.', 0 FROM o UNION ALL SELECT program, 5, '       01  TOTALS.', 0 FROM o UNION ALL SELECT program, 6, '           05  TOTAL PIC 9(9).', 0 FROM o UNION ALL SELECT program, 7, '           05  LIMIT-V PIC 9(4) VALUE 30.', 0 FROM o
UNION ALL SELECT program, 7 + i, '           05  F' || i || ' PIC 9(4) VALUE ' || q || '.', 0 FROM l UNION ALL SELECT program, 8 + n, '       PROCEDURE DIVISION.', 0 FROM o
UNION ALL SELECT program, b + 1, '       P' || i || '.', 0 FROM l UNION ALL SELECT program, b + 2, '           IF F' || i || ' > LIMIT-V', i FROM l UNION ALL SELECT program, b + 3, '               ADD F' || i || ' TO TOTAL', i FROM l
UNION ALL SELECT program, b + 4, '           END-IF.', i FROM l UNION ALL SELECT program, b + 5, '           PERFORM P' || (p % (n + 1) + 1) || '.', 0 FROM l
UNION ALL SELECT program, b + 6, CASE flag WHEN 'R' THEN '           GO TO P' || (p % n + 1) || '.' WHEN 'A' THEN '           CALL ''O' || (k + 1) || '''.' ELSE '           EXEC CICS XCTL PROGRAM(''O' || (k + 2) || ''') END-EXEC.' END, 0 FROM l)"""


def _instances(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instances, loci, lines): one edit of every program, in the middle paragraph."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").cast("int").alias("n"))
    i, n, way = F.floor((F.col("n") + 1) / 2).cast("int"), F.col("n"), F.col("k") % 5
    b = 8 + n + 6 * (i - 1)
    f, name = F.concat(F.lit("F"), i.cast("string")), F.concat(F.lit("O"), F.col("k").cast("string"))
    note = (
        F.when(way == 0, F.concat(F.lit("op; old='"), f, F.lit(" > LIMIT-V'; new='"), f, F.lit(" >= LIMIT-V'")))
        .when(way == 1, F.concat(F.lit("op; old='if "), f, F.lit(" > LIMIT-V ADD "), f, F.lit(" TO TOTAL END-IF.'; new='(deleted)'")))
        .when(way == 2, "op; old='NOWHERE'; new='THERE'").when(way == 3, "op; old='I'; new='J'").otherwise("op; old=LIMIT-V; new='X'")
    )
    line = F.when(way.isin(1), b + 4).otherwise(b + 2)
    each = li.select(name.alias("instance_id"), note.alias("note"), F.concat(name, F.lit(".cbl")).alias("file"), line.cast("int").alias("line_start"), line.cast("int").alias("line_end"))
    # the lines are rendered where they are read: dealt by file they meet edits without being moved, and kept in a table they would be many times the orders
    lines = _lines(spark, d, "file").select("file", "line_no", "text")
    return _kept(each.select("instance_id", "note"), "instances"), _kept(each.select("instance_id", "file", "line_start", "line_end"), "loci"), lines


@query(f"""WITH {_EDITED}, m AS (SELECT program, line_no, CASE WHEN way = 0 AND i = (n + 1) // 2 THEN replace(text, ' > ', ' >= ')
WHEN way = 1 AND i = (n + 1) // 2 THEN regexp_replace(text, '[A-Z0-9].*', '') || repeat(' ', length(text) - length(regexp_replace(text, '[A-Z0-9].*', ''))) ELSE text END AS text FROM x JOIN o USING (program) WHERE way < 2)
SELECT program AS instance_id, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS sha256, NULL AS error FROM m GROUP BY program
UNION ALL SELECT program, NULL, CASE way WHEN 2 THEN 'no match' WHEN 3 THEN 'ambiguous line' ELSE 'the note lacks old or new' END FROM o WHERE way > 1""")
def materialized_programs(spark, d):
    """Each edited program's digest, or why its edit can't be made."""
    texts, errors = materialize.materialized(*_instances(spark, d))
    return materialize.digests(texts).select("instance_id", "sha256").withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


@query(f"WITH {_EDITED} SELECT program AS instance_id, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS sha256 FROM x JOIN o USING (program) WHERE way = 0 GROUP BY program")
def undone_programs(spark, d):
    """Replacements made and put back: the digests of the programs as they were."""
    instances, loci, lines = _instances(spark, d)
    edited, _ = materialize.materialized(instances, loci, lines)
    back = stored(materialize.undone(instances).join(edited.select("instance_id").distinct(), "instance_id", "left_semi"), "back")
    made = stored(edited.join(back, "instance_id", "left_semi").select("file", "line_no", "text"), "edited")
    again, _ = materialize.materialized(back, loci.join(back, "instance_id", "left_semi"), made)
    return materialize.digests(again).select("instance_id", "sha256")


@query(f"""WITH {_FLOWS}, falls AS (SELECT program, 'P' || (i + 1) AS dst FROM l WHERE i < n AND flag <> 'R')
SELECT program, 'P' || i AS name FROM l WHERE i > 1 AND (program, 'P' || i) NOT IN (SELECT program, dst FROM f WHERE kind IN ('perform', 'goto') AND dst IS NOT NULL UNION ALL SELECT program, dst FROM falls)""")
def program_forest_roots(spark, d):
    """Paragraphs that nothing in their program leads to, besides its first; over every edge of every program."""
    return program.reach_of(_rendered(spark, d)).filter("ord > 1 and not led_to").select("program", "name")
