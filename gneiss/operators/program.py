"""Fixed-format program text as relations: lines, masks, copybooks, paragraphs, statements, edges, fields and sites.

Every operator is a plan over (program, file, line_no, text). Windows and groups are keyed by program, so one task holds
one program at most, and programs spread over the cluster. Null texts count as empty lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import graph, parse, texts

# The columns of a line and what masking leaves.
INDICATOR, BODY, BODY_LENGTH = 7, 8, 65
CONTINUE = " " * 11 + "CONTINUE"
EXEC = r"(?i)\bEXEC\s+(CICS|SQL|DLI)\b"
COPY_REPLACING = r"(?i)\bCOPY\b.*\bREPLACING\b"
HEADER = r"(?i)^([A-Z0-9][A-Z0-9-]*)\s*\.\s*$"
SECTION = r"(?i)^[A-Z0-9-]+\s+SECTION\s*\."
#: Kinds of statements that pass control on.
WAYS = ["PERFORM_CALL", "GOTO", "CALL"]
NO_LABELS = ["END", "EXIT", "GOBACK", "STOP", "CONTINUE"]
PREAMBLE = "<preamble>"
RESERVED = "ACCEPT ADD ALL ALPHABETIC ALSO AND ARE AT BY CALL COMPUTE CORRESPONDING DATE DAY DELIMITED DELIMITER DEPENDING DISPLAY DIVIDE DOWN ELSE END EQUAL ERROR EVALUATE FALSE FROM FUNCTION GIVING GREATER HIGH-VALUES IF IN INITIALIZE INTO INVALID IS KEY LESS LOW-VALUES MOVE MULTIPLY NEXT NO NOT NUMERIC OF ON OR OTHER PERFORM POINTER READ RECORD REMAINDER ROUNDED SENTENCE SET SIZE SPACE SPACES STRING SUBTRACT THAN THEN THROUGH THRU TIME TIMES TO TRUE UNSTRING UNTIL UP UPON USING VARYING WHEN WITH WRITE ZERO ZEROES ZEROS".split()

IN_FILE = ["program", "file"]


def columns(lines: DataFrame) -> DataFrame:
    """Add body, comment and continuation, by column."""
    text = F.coalesce("text", F.lit(""))
    mark = F.substring(text, INDICATOR, 1)
    return lines.withColumn("body", F.substring(text, BODY, BODY_LENGTH)).withColumn("comment", mark.isin("*", "/")).withColumn("continuation", mark == "-")


def _ends(c: Column) -> Column:
    return F.rtrim(c).endswith(".")


def masked(lines: DataFrame) -> DataFrame:
    """Add masked (the text that is left) and span_kind, span_start and span_end of the masked block that holds a line.

    Embedded EXEC blocks and COPY REPLACING become CONTINUE, a continued VALUE literal is closed on its first line,
    and NOT= is set apart; lines keep their numbers. An unterminated block is an error. An opener within a block is
    part of it; of blocks of the two kinds that overlap, the first to open hides those that open before it ends.
    """
    own = Window.partitionBy(*IN_FILE).orderBy("line_no")
    before, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    # what is asked of the lines from one on is told from the last line up: a frame that ends at the last line would be gone through anew for every line of a file
    up = Window.partitionBy(*IN_FILE).orderBy(F.desc("line_no"))
    onward = up.rowsBetween(Window.unboundedPreceding, 0)
    # what a window asks of a line is told line by line first, so that the one sort carries flags and no texts but the line's own; every window has its order
    body = F.substring(F.coalesce("text", F.lit("")), BODY, BODY_LENGTH)
    mark = F.substring(F.coalesce("text", F.lit("")), INDICATOR, 1)
    code = ~mark.isin("*", "/")
    c = lines.withColumns({"ends": _ends(body), "continuation": mark == "-", "closes": body.rlike("(?i)END-EXEC")})
    # most lines hold neither word, and a plain search is cheaper than the pattern
    opens_exec, opens_copy = code & body.rlike("(?i)EXEC") & body.rlike(EXEC), code & body.rlike("(?i)REPLACING") & body.rlike(COPY_REPLACING)
    c = c.withColumn("kind", F.when(opens_exec, F.concat(F.lit("exec_"), F.lower(F.regexp_extract(body, EXEC, 1)))).when(opens_copy, F.lit("copy_replacing")))
    opening = r"(?i)^(.*?\bVALUE\s+(?:IS\s+)?(['\"]))"
    opened = F.concat(F.substring("text", 1, INDICATOR), F.regexp_extract(body, opening, 1), F.lit("X"), F.regexp_extract(body, opening, 2))
    c = c.withColumn("head", F.when(code & (mark != "-") & body.rlike("['\"]") & body.rlike(opening), opened))
    exec_end, copy_end = F.min(F.when(F.col("closes"), F.col("line_no"))).over(onward), F.min(F.when(F.col("ends"), F.col("line_no"))).over(onward)
    c = c.withColumns({"exec_end": exec_end, "copy_end": copy_end, "goes_on": F.coalesce(F.lag("continuation").over(up), F.lit(False))})
    # how a run ends, told to its first line: the end of the first line from there on that none continues
    c = c.withColumn("run_ends", F.last(F.when(~F.col("goes_on"), F.col("ends")), True).over(onward))
    end = F.when(F.col("kind") == "copy_replacing", F.col("copy_end")).otherwise(F.col("exec_end"))
    c = c.withColumn("until", F.when(F.col("kind").isNotNull(), F.coalesce(end, F.lit(2**31 - 1))))
    real = F.col("kind").isNotNull() & (F.coalesce(F.max("until").over(before), F.lit(0)) < F.col("line_no"))
    c = c.withColumn("real", real)
    c = c.withColumn("span", F.last(F.when(F.col("real"), F.struct(F.col("kind"), F.col("line_no").alias("start"), F.col("until").alias("end"))), True).over(so_far))
    c = c.withColumn("span", F.when(F.col("span.end") >= F.col("line_no"), F.col("span")))
    broken = F.when(F.col("span.end") == 2**31 - 1, F.raise_error(F.concat(F.lit("unterminated "), F.col("span.kind"), F.lit(" at line "), F.col("span.start").cast("string"))))
    # a run is a line and the continuation lines after it: its first line is the last so far that continues none
    first_of = F.last(F.when(~F.col("continuation"), F.struct("head")), True).over(so_far)
    c = c.withColumn("first_of", first_of).withColumn("spliced", F.col("first_of.head").isNotNull() & (F.col("continuation") | F.col("goes_on")))
    dot = F.when(F.col("ends"), ".").otherwise("")
    is_exec, first, last = F.col("span.kind") != "copy_replacing", F.col("span.start") == F.col("line_no"), F.col("span.end") == F.col("line_no")
    in_exec = F.when(first & last, F.concat(F.lit(CONTINUE), dot)).when(first, F.lit(CONTINUE)).when(last & F.col("ends"), F.lit(CONTINUE + "."))
    in_copy = F.when(last, F.lit(CONTINUE + "."))
    apart = F.when(code & F.contains("text", F.lit("=")), F.regexp_replace("text", r"(?i)\bNOT=", "NOT =")).otherwise(F.col("text"))
    left = (
        F.when(F.col("span").isNotNull() & is_exec, F.coalesce(broken, in_exec, F.lit("")))
        .when(F.col("span").isNotNull(), F.coalesce(broken, in_copy, F.lit("")))
        .when(F.col("spliced") & F.col("continuation"), F.lit(""))
        .when(F.col("spliced"), F.concat("head", F.when(F.col("run_ends"), ".").otherwise("")))
        .otherwise(apart)
    )
    return c.select(*lines.columns, left.alias("masked"), F.col("span.kind").alias("span_kind"), F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"))


def expanded(lines: DataFrame, books: DataFrame, depth: int = 2) -> DataFrame:
    """Replace COPY statements by the lines of their copybooks, depth levels down; unresolved ones stay.

    books: name, line_no, text, one copybook a name. Returns program, file, line_no (within the file or copybook), text and
    at, the line's place in the expansion. REPLACING pairs are plain replacements, in order.
    """
    book = books.select(F.upper("name").alias("called"), F.col("name").alias("book"), F.col("line_no").alias("book_line"), F.col("text").alias("book_text"))
    now, kept = lines.select("program", "file", "line_no", "text").withColumn("above", F.expr("cast(array() as array<int>)")), []
    for _ in range(depth):
        unit = ["program", "above", "file"]
        after = Window.partitionBy(*unit).orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
        before = Window.partitionBy(*unit).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
        so_far = Window.partitionBy(*unit).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        c = columns(now).withColumn("ends", F.coalesce(F.min(F.when(_ends(F.col("body")), F.col("line_no"))).over(after), F.max("line_no").over(after)))
        c = c.withColumn("copy", ~F.col("comment") & F.col("body").rlike(r"(?i)^\s*COPY\s"))
        real = F.col("copy") & (F.coalesce(F.max(F.when(F.col("copy"), F.col("ends"))).over(before), F.lit(0)) < F.col("line_no"))
        c = c.withColumn("s", F.last(F.when(real, F.struct(F.col("line_no").alias("start"), F.col("ends").alias("end"))), True).over(so_far))
        c = c.withColumn("start", F.when(F.col("s.end") >= F.col("line_no"), F.col("s.start")))
        said = c.filter("start is not null").groupBy(*unit, "start").agg(F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("ls"))
        said = said.withColumn("said", F.array_join(F.transform("ls", lambda x: x["body"]), " "))
        name = F.regexp_extract("said", r"(?i)COPY\s+['\"]?([^\s'\"]+)", 1)
        replacing = F.regexp_extract("said", r"(?is)\bREPLACING\b(.*)$", 1)
        pair = r"(?is)(==.*?==|\S+)\s+BY\s+(==.*?==|\S+)"
        bare = lambda x: F.regexp_replace(x, r"(?s)^==(.*)==$", "$1")
        side = lambda i: F.transform(F.regexp_extract_all(replacing, F.lit(pair), F.lit(i)), bare)
        pairs = F.zip_with(side(1), side(2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        said = said.select(*unit, "start", F.upper(F.rtrim(name, F.lit("."))).alias("called"), pairs.alias("pairs"))
        resolved = said.join(book.select("called").distinct(), "called", "left_semi")
        stay = c.join(resolved.select(*unit, "start"), [*unit, "start"], "left_anti")
        kept.append(stay.select("program", "file", "line_no", "text", F.concat("above", F.array("line_no")).alias("at")))
        text = F.aggregate("pairs", F.col("book_text"), lambda t, p: F.replace(t, p["a"], p["b"]))
        now = resolved.join(book, "called").select("program", F.col("book").alias("file"), F.col("book_line").alias("line_no"), text.alias("text"), F.concat("above", F.array("start")).alias("above"))
    out = now.select("program", "file", "line_no", "text", F.concat("above", F.array("line_no")).alias("at"))
    for k in kept:
        out = out.unionByName(k)
    return out


def line_map(expansion: DataFrame) -> DataFrame:
    """Runs of an expansion that follow one another in one file: program, expanded_start, expanded_end, file, first_line."""
    n = expansion.withColumn("n", F.row_number().over(Window.partitionBy("program").orderBy("at")))
    order = Window.partitionBy("program").orderBy("n")
    new = F.coalesce((F.lag("file").over(order) != F.col("file")) | (F.lag("line_no").over(order) + 1 != F.col("line_no")), F.lit(True))
    n = n.withColumn("run", F.sum(new.cast("int")).over(order))
    return n.groupBy("program", "run").agg(F.min("n").alias("expanded_start"), F.max("n").alias("expanded_end"), F.first("file").alias("file"), F.min("line_no").alias("first_line")).drop("run")


def _procedure(lines: DataFrame, keep: Column | None = None, **more: Column) -> DataFrame:
    """The lines after PROCEDURE DIVISION, without comments; header is the name that a paragraph's first line gives. more: columns told over all lines but comments. keep: which other lines stay, all with inside."""
    c = columns(lines).filter(~F.col("comment")).drop("body")
    body = F.substring(F.coalesce("text", F.lit("")), BODY, BODY_LENGTH)
    inside = F.max(F.col("begins")).over(Window.partitionBy(*IN_FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("begins", body.rlike(r"(?i)^\s*PROCEDURE\s+DIVISION\b")).withColumns({"inside": F.coalesce(inside, F.lit(False))} | more)
    c = (c.filter("inside").drop("inside") if keep is None else c.filter(F.col("inside") | keep)).drop("begins").withColumn("body", body)
    name = F.upper(F.regexp_extract(F.rtrim("body"), HEADER, 1))
    return c.withColumn("header", F.when((name != "") & ~name.isin(NO_LABELS) & ~name.startswith("END-"), name))


def paragraphs(lines: DataFrame, preamble: bool = False) -> DataFrame:
    """(program, file, ord, name, line_start, line_end) of every paragraph; with preamble, the code before the first one too."""
    said = F.when(F.trim("text") != "", F.col("line_no"))
    whole = Window.partitionBy(*IN_FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # told along with the lines and in their order, so that the lines are neither read nor sorted again
    p = _procedure(lines, last=F.max(said).over(whole))
    starts = p.filter("header is not null").select(*IN_FILE, F.col("header").alias("name"), F.col("line_no").alias("line_start"), "last")
    if preamble:
        first = p.filter(F.trim("body") != "").groupBy(*IN_FILE).agg(F.min_by(F.struct("line_no", "header", "last"), "line_no").alias("f"))
        starts = starts.unionByName(first.filter("f.header is null").select(*IN_FILE, F.lit(PREAMBLE).alias("name"), F.col("f.line_no").alias("line_start"), F.col("f.last").alias("last")))
    order = Window.partitionBy(*IN_FILE).orderBy("line_start")
    return starts.withColumn("ord", F.row_number().over(order)).withColumn("next", F.lead("line_start").over(order)).select(*IN_FILE, "ord", "name", "line_start", F.coalesce(F.col("next") - 1, "last").alias("line_end"))


def statements(lines: DataFrame) -> DataFrame:
    """Every statement in order: program, file, ord, paragraph, kind, verb, text, line_start, line_end, depth, target, targets, thru, dynamic, parent, branch, guards, block_end.

    The tree is that of gneiss.operators.parse: depth counts the open statements around one, parent is the ord of the row around
    it, branch what it is in (THEN, ELSE, WHEN, LOOP or a phrase such as AT END), guards the first lines of all that decides
    on it, and block_end the last line of all that it holds. A phrase is a row of kind PHRASE. A GO TO with DEPENDING ON has all
    its targets in targets, and the first in target.
    """
    so_far = Window.partitionBy(*IN_FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    p = _procedure(lines).withColumn("paragraph", F.coalesce(F.last("header", True).over(so_far), F.lit(PREAMBLE))).filter("header is null")
    return _told(parse.placed(p.filter(~F.col("body").rlike(SECTION)), IN_FILE))


def statements_of(programs: DataFrame) -> DataFrame:
    """statements() of masked programs (program, file, text), one row a file: in one walk of each text, without rows for lines."""
    return _told(texts.placed(programs, IN_FILE, PREAMBLE))


def _told(placed: DataFrame) -> DataFrame:
    return _aimed(placed).select(*IN_FILE, "ord", "paragraph", "kind", "verb", "text", "line_start", "line_end", "depth", "target", "targets", "thru", "dynamic", "parent", "branch", "guards", "block_end")


def _aimed(s: DataFrame) -> DataFrame:
    """Statements with target, targets, thru and dynamic, told from their texts."""
    word = lambda i: F.upper(F.coalesce(F.get(F.split("text", r"\s+"), F.lit(i)), F.lit("")))
    labels = F.filter(F.split(F.upper(F.regexp_extract("text", r"(?i)^GO\s+(?:TO\s+)?(.*?)(?:\s+DEPENDING\b.*)?$", 1)), r"[\s,]+"), lambda x: x != "")
    s = s.withColumn("targets", F.when(F.col("kind") == "GOTO", labels).otherwise(F.expr("cast(array() as array<string>)")))
    target = F.when(F.col("kind") == "PERFORM_CALL", word(1)).when(F.col("kind") == "GOTO", F.get("targets", F.lit(0))).when(F.col("kind") == "CALL", F.regexp_extract("text", r"(?i)^CALL\s+['\"]([^'\"]+)", 1))
    thru = F.when(F.col("kind") == "PERFORM_CALL", F.upper(F.regexp_extract("text", r"(?i)\bTHR(?:U|OUGH)\s+(\S+)", 1)))
    some = lambda c: F.nullif(c, F.lit(""))
    return s.withColumn("target", some(target)).withColumn("thru", some(thru)).withColumn("dynamic", (F.col("kind") == "CALL") & F.col("target").isNull())


def outline(left: DataFrame) -> DataFrame:
    """All that transfers() and fallthrough() ask of programs, in one pass over their lines and without a row for any other statement: parse.outlined(), with targets.

    left: lines, or what masked() gives. outlined_parts() tells the rows apart, best once they are kept.
    """
    masks = "masked" in left.columns
    none = lambda t: F.lit(None).cast(t)
    held = {"block": F.col("span_kind"), "block_start": F.col("span_start"), "block_end": F.col("span_end")} if masks else {"block": none("string"), "block_start": none("int"), "block_end": none("int")}
    raw = F.when(F.col("span_kind").isNotNull(), F.col("text")) if masks else none("string")
    lines = left.select(*IN_FILE, "line_no", *(c.alias(n) for n, c in held.items()), raw.alias("raw"), F.col("masked" if masks else "text").alias("text"))
    p = _procedure(lines, keep=F.col("block").isNotNull())
    code = F.col("inside") & F.col("header").isNull() & ~F.col("body").rlike(SECTION)
    p = p.withColumns({"said": F.coalesce(F.col("inside") & (F.trim("text") != ""), F.lit(False)), "body": F.when(code, F.col("body")), "header": F.when(F.col("inside"), F.col("header"))})
    return _aimed(parse.outlined(p, IN_FILE, WAYS, PREAMBLE))


def outline_of(programs: DataFrame) -> DataFrame:
    """outline() of masked programs (program, file, text), one row a file: in one walk of each text, without rows for lines."""
    return _aimed(texts.outlined(programs, IN_FILE, WAYS, PREAMBLE))


def outlined_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, statements, blocks) of an outline(): paragraphs() and blocks(), and of statements() the rows and columns that transfers() and fallthrough() read."""
    spans = rows.filter(F.col("kind") == parse.PARAGRAPH).select(*IN_FILE, "ord", F.col("text").alias("name"), "line_start", "line_end")
    stmts = rows.filter(~F.col("kind").isin(parse.PARAGRAPH, parse.BLOCK)).select(*IN_FILE, "ord", "paragraph", "kind", "verb", "text", "line_start", "line_end", "depth", "target", "targets", "thru", "dynamic")
    return spans, stmts, rows.filter(F.col("kind") == parse.BLOCK).select(*IN_FILE, F.col("verb").alias("kind"), "line_start", "line_end", "text")


def edges(spans: DataFrame, stmts: DataFrame) -> DataFrame:
    """Distinct (src, dst, kind), nodes written program.paragraph: perform (a THRU range reaches all in it), goto, call, fallthrough.

    Targets that are no paragraph, backward ranges and dynamic calls give no edge; a call leads to its program's first paragraph.
    """
    node = lambda n: F.concat_ws(".", "program", n)
    nodes = spans.select("program", "ord", F.col("name").alias("label"), node("name").alias("node"))
    at = nodes.groupBy("program", "label").agg(F.min("ord").alias("k"))
    calls = stmts.filter("kind = 'PERFORM_CALL'").select("program", node("paragraph").alias("src"), F.col("target").alias("label"), F.coalesce("thru", "target").alias("to"))
    calls = calls.join(at.withColumnRenamed("k", "low"), ["program", "label"]).join(at.select("program", F.col("label").alias("to"), F.col("k").alias("high")), ["program", "to"])
    reached = graph.thru(nodes, calls.select("program", "low", "high").distinct())
    perform = calls.join(reached, ["program", "low", "high"]).select("src", F.col("node").alias("dst"), F.lit("perform").alias("kind"))
    goto = stmts.filter("kind = 'GOTO'").select("program", node("paragraph").alias("src"), F.explode("targets").alias("label")).join(at, ["program", "label"]).select("src", node("label").alias("dst"), F.lit("goto").alias("kind"))
    first = graph.entry_points(nodes).select(F.col("program").alias("callee"), F.col("node").alias("dst"))
    call = stmts.filter("kind = 'CALL' and not dynamic").select(node("paragraph").alias("src"), F.upper("target").alias("callee")).join(first, "callee").select("src", "dst", F.lit("call").alias("kind"))
    falls = fallthrough(spans, stmts).select(node("src").alias("src"), node("dst").alias("dst"))
    return perform.unionByName(goto).unionByName(call).unionByName(falls.select("src", "dst", F.lit("fallthrough").alias("kind"))).distinct()


def fallthrough(spans: DataFrame, stmts: DataFrame) -> DataFrame:
    """(program, src, dst): each paragraph and the one after it, unless the last statement outside all others passes control on for good."""
    last = stmts.groupBy("program", F.col("paragraph").alias("label")).agg(F.max_by(F.struct("verb", "depth", "text"), "ord").alias("l"))
    away = (F.col("l.depth") == 0) & (F.col("l.verb").isin("GO", "GOBACK") | F.col("l.text").rlike(r"(?i)^(STOP\s+RUN|EXIT\s+PROGRAM)"))
    nodes = spans.select("program", "ord", F.col("name").alias("node")).join(last.withColumnRenamed("label", "node"), ["program", "node"], "left")
    return graph.fallthrough(nodes.select("program", "ord", "node", F.coalesce(away, F.lit(False)).alias("transfers")))


LINK = r"(?i)\b(LINK|XCTL)\b"
PROGRAM_LITERAL = r"(?i)\bPROGRAM\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
PROGRAM_ANY = r"(?i)\bPROGRAM\s*\("


def blocks(left: DataFrame) -> DataFrame:
    """(program, file, kind, line_start, line_end, text) of every masked block; left is what masked() gives."""
    held = left.filter("span_kind is not null").groupBy(*IN_FILE, "span_kind", "span_start", "span_end").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    return held.select(*IN_FILE, F.col("span_kind").alias("kind"), F.col("span_start").alias("line_start"), F.col("span_end").alias("line_end"), F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))


def transfers(spans: DataFrame, stmts: DataFrame, masked_blocks: DataFrame | None = None) -> DataFrame:
    """Every way that control is passed on: program, src, line, kind, dst_program, dst, reason.

    kind is perform (a THRU range gives a row for each paragraph in it), goto, call, link or xctl. A call, link or xctl leads to the
    first paragraph of its program, or to '' if that program isn't there. What can't be resolved has no dst but a reason. A link or
    xctl that names no program at all is an error.
    """
    columns = ["program", "src", "line", "kind", "dst_program", "dst", "reason"]
    none = F.lit(None).cast("string")
    # a program's paragraphs are one row, so that all its ways meet them in one join, whatever they ask
    rows = F.array_sort(F.collect_list(F.struct("ord", "name", "line_start", "line_end")))
    every = spans.groupBy("program").agg(rows.alias("ps")).withColumns({"names": F.col("ps.name"), "ords": F.col("ps.ord")})
    first = spans.groupBy(F.col("program").alias("callee")).agg(F.min_by("name", "ord").alias("first"))
    labels = F.when(F.col("kind") == "GOTO", F.col("targets")).otherwise(F.array("target"))
    asked = stmts.filter(F.col("kind").isin("PERFORM_CALL", "GOTO")).select("program", F.col("paragraph").alias("src"), F.col("line_start").alias("line"), "kind", F.explode_outer(labels).alias("label"), F.col("thru").alias("last"))
    place = lambda label: F.get("ords", F.array_position("names", label).cast("int") - 1)  # noqa: E731  # the first of its name, by ord
    ends = asked.join(every, "program", "left").withColumn("low", place(F.col("label"))).withColumn("high", F.when(F.col("last").isNull(), F.col("low")).otherwise(place(F.col("last"))))
    unknown = F.when(F.col("last").isNull(), "unknown paragraph").otherwise("unknown endpoint")
    why = F.when(F.col("label").isNull(), "no target").when(F.col("low").isNull() | F.col("high").isNull(), unknown).when(F.col("low") > F.col("high"), "backwards")
    is_goto = F.col("kind") == "GOTO"
    ends = ends.withColumn("reason", F.when(is_goto, F.when(F.col("low").isNull(), "unknown paragraph")).otherwise(why))
    inside = F.transform(F.filter("ps", lambda p: p["ord"].between(F.col("low"), F.col("high"))), lambda p: p["name"])
    dsts = F.when(F.col("reason").isNotNull(), F.array(none)).when(is_goto, F.array("label")).otherwise(inside)
    near = ends.select("program", "src", "line", F.when(is_goto, "goto").otherwise("perform").alias("kind"), F.when(F.col("reason").isNull(), F.col("program")).alias("dst_program"), F.explode(dsts).alias("dst"), "reason")
    out = stmts.filter("kind = 'CALL'").select("program", F.col("paragraph").alias("src"), F.col("line_start").alias("line"), F.lit("call").alias("kind"), F.upper("target").alias("callee"), F.when(F.col("dynamic"), F.lit("dynamic")).alias("reason"))
    if masked_blocks is not None:
        asks = masked_blocks.filter(F.col("text").rlike(LINK)).select("program", F.col("line_start").alias("line"), "text")
        around = F.transform(F.filter("ps", lambda p: F.col("line").between(p["line_start"], p["line_end"])), lambda p: p["name"])
        asks = asks.join(every, "program", "left").select("program", F.explode_outer(around).alias("src"), "line", "text")
        literal = F.nullif(F.upper(F.regexp_extract("text", PROGRAM_LITERAL, 1)), F.lit(""))
        kind = F.lower(F.regexp_extract("text", LINK, 1))
        shapeless = F.raise_error(F.concat(F.lit("no PROGRAM(...) at line "), F.col("line").cast("string"), F.lit(" of "), F.col("program"))).cast("string")
        reason = F.when(F.col("src").isNull(), "outside any paragraph").when(literal.isNull(), F.when(F.col("text").rlike(PROGRAM_ANY), "dynamic").otherwise(shapeless))
        out = out.unionByName(asks.select("program", "src", "line", kind.alias("kind"), literal.alias("callee"), reason.alias("reason")))
    there = F.when(F.col("reason").isNull(), F.col("callee"))
    out = out.join(first, "callee", "left").select("program", "src", "line", "kind", there.alias("dst_program"), F.when(F.col("reason").isNull(), F.coalesce("first", F.lit(""))).alias("dst"), "reason")
    return near.select(columns).unionByName(out.select(columns))


def flows_of(programs: DataFrame, blocks: bool = True) -> DataFrame:
    """The ways of control of programs (program, file, text), one text each, as one walk tells them: transfers() but for the paragraphs of other programs, which arrived() finds. blocks: with links and xctls."""
    return texts.transfers(programs, WAYS, PREAMBLE, blocks)


def arrived(flows: DataFrame) -> DataFrame:
    """transfers() of a flows_of(), best once that is kept: only the ways to other programs are moved, to meet their first paragraphs."""
    columns = ["program", "src", "line", "kind", "dst_program", "dst", "reason"]
    first = flows.filter(F.col("kind") == texts.FIRST).select(F.col("program").alias("dst_program"), F.col("src").alias("first"))
    far = flows.filter("far").join(first, "dst_program", "left").withColumn("dst", F.coalesce("first", F.lit("")))
    return flows.filter(~F.col("far") & (F.col("kind") != texts.FIRST)).select(columns).unionByName(far.select(columns))


def reach_of(programs: DataFrame) -> DataFrame:
    """(program, ord, name, distance, led_to) of every paragraph of programs (program, file, text), one text each: slices.reach() by transfers() and fallthrough(), told in the walk."""
    return texts.reach(programs, WAYS, PREAMBLE)


def trees_of(programs: DataFrame) -> DataFrame:
    """What the statements_of() programs are like, a row a paragraph with a digest of all of them, told in the walk."""
    return texts.trees(programs, IN_FILE, PREAMBLE)


FIELDS = "program string, ord int, line_no int, level int, name string, parent string, record string, ancestors array<string>, redefines string, has_value boolean"


#: A line of PROCEDURE DIVISION that its first 72 columns hold whole. (?d): as for program_lines(), only a line feed ends a line.
PROCEDURE = r"(?imd)^.{6}[^*/\n] {0,20}PROCEDURE {1,20}DIVISION\b"


def declaring(programs: DataFrame) -> DataFrame:
    """programs (program, file, text) without the lines behind their PROCEDURE DIVISION, which declare nothing: fields() passes over them, so they need not become rows.

    One that is written otherwise than PROCEDURE says leaves its program whole.
    """
    # places are told in UTF-16 units and taken as characters, so a cut is never too early
    end = F.position(F.lit("\n"), F.col("text"), F.regexp_instr("text", F.lit(PROCEDURE)))
    return programs.withColumn("text", F.when(end > 0, F.left("text", end)).otherwise(F.col("text")))


# beside other than ASCII letters \b is as Spark's patterns have it
_FORM = re.compile(r"\s*(\d{1,2})\s+([A-Z0-9][A-Z0-9-]*)", re.I | re.A)
_REDEFINES = re.compile(r"(?u:\b)REDEFINES\s+([A-Z0-9-]+)", re.I | re.A)
_VALUE = re.compile(r"(?u:\b)VALUES?(?u:\b)", re.I | re.A)


def _declared(said: str) -> tuple[int, str, str | None, bool] | None:
    """level, name, redefines and has_value of an entry; None if it declares no field."""
    form = _FORM.match(said)
    if not form:
        return None
    other = _REDEFINES.search(said)
    return int(form[1]), form[2].upper(), other and other[1].upper(), bool(_VALUE.search(said))


def fields(expansion: DataFrame) -> DataFrame:
    """Declared fields with their ancestors, innermost first; 88 levels belong to the field around them and hold none.

    expansion as expanded() gives it. A program's lines go in order to one walk with a stack of open levels, in batches that hold whole
    programs: there is no group for an entry or a program, so nothing is sorted but the lines, once.
    """
    c = columns(expansion).filter(~F.col("comment") & (F.trim("body") != ""))
    before = Window.partitionBy("program").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    c = c.select("program", "at", "line_no", "body", F.col("body").rlike(r"(?i)^\s*PROCEDURE\s+DIVISION\b").alias("begins"))
    c = c.withColumn("past", F.coalesce(F.max("begins").over(before), F.lit(False))).filter(~F.col("past"))
    rows = c.select("program", "at", "line_no", "body").sortWithinPartitions("program", "at").select("program", "line_no", "body")

    def nest(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for table, cuts in parse.tables(batches, ["program"]):
            body = table.column("body")
            ends = pc.ends_with(pc.utf8_rtrim(body, " "), ".").to_numpy(zero_copy_only=False)
            # an entry begins with a program and behind a line that ends with a full stop
            new = np.concatenate([[True], ends[:-1]])
            new[cuts[:-1]] = True
            starts = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(new)), pa.int32()), body)
            said = pc.binary_join(lists, " ").dictionary_encode()
            told = [_declared(x) for x in said.dictionary.to_pylist()]
            codes = said.indices.to_numpy()
            is_field = np.array([x is not None for x in told], bool)[codes]
            starts, codes = starts[is_field], codes[is_field]
            unit = np.searchsorted(cuts, starts, "right")
            first = np.diff(unit, prepend=0) != 0
            begins = np.flatnonzero(first)
            ords = np.arange(len(unit)) - np.repeat(begins, np.diff(np.append(begins, len(unit)))) + 1
            parents, records, ancestors = [], [], []
            open_: list = []  # level, and the names from it outwards
            own = [told[k] for k in codes.tolist()]
            for (level, name, _, _), fresh in zip(own, first.tolist(), strict=True):
                if fresh:
                    open_ = []
                if level != 88:
                    while open_ and open_[-1][0] >= level:
                        open_.pop()
                up = open_[-1][1] if open_ else []
                parents.append(up[0] if up else None)
                records.append(up[-1] if up else name)
                ancestors.append(up)
                if level != 88:
                    open_.append((level, [name, *up]))
            at = pa.array(starts)
            text, ints = pa.string(), pa.int32()
            made = [table.column("program").take(at), pa.array(ords, ints), table.column("line_no").take(at), pa.array([x[0] for x in own], ints), pa.array([x[1] for x in own], text), pa.array(parents, text), pa.array(records, text), pa.array(ancestors, pa.list_(text)), pa.array([x[2] for x in own], text), pa.array([x[3] for x in own], pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in FIELDS.split(", ")])

    return rows.mapInArrow(nest, FIELDS)


def _names(text: Column) -> Column:
    """The names in a text, each with its qualifiers."""
    word = r"[A-Z0-9-]*[A-Z][A-Z0-9-]*"
    found = F.regexp_extract_all(text, F.lit(rf"(?<![A-Z0-9-])({word}(?:\s+(?:OF|IN)\s+{word})*)"), F.lit(1))
    return F.filter(found, lambda x: ~F.substring_index(F.regexp_replace(x, r"\s+", " "), " ", 1).isin(RESERVED))


def sites(stmts: DataFrame) -> DataFrame:
    """Distinct (program, file, paragraph, ord, line_start, line_end, verb, role, name): what a statement uses and defines.

    Literals and subscripts don't count. Arithmetic without GIVING both uses and defines its target.
    """
    t = F.regexp_replace(F.regexp_replace(F.upper("text"), r"'[^']*'|\"[^\"]*\"", " "), r"(?<=[A-Z0-9])\s*\([^()]*\)", " ")
    part = lambda words: _names(F.regexp_extract(t, rf"\b(?:{words})\b(.*?)(?=\b(?:TO|FROM|BY|INTO|GIVING|REMAINDER|ON|AT|WITH|DELIMITED|TALLYING|POINTER|UNTIL)\b|$)", 1))
    verb, giving, none = F.col("verb"), t.rlike(r"\bGIVING\b"), F.expr("cast(array() as array<string>)")
    right = _names(F.regexp_extract(t, r"=(.*)$", 1))
    out = part("GIVING"), part("REMAINDER")
    uses = (
        F.when(verb == "MOVE", part("MOVE")).when(verb == "COMPUTE", right)
        .when(verb.isin("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"), F.concat(part("ADD|SUBTRACT|MULTIPLY|DIVIDE"), part("TO|FROM|BY|INTO")))
        .when(verb == "SET", F.concat(part("TO|BY"), F.when(t.rlike(r"\b(UP|DOWN)\b"), _names(F.regexp_extract(t, r"^SET\b(.*?)\b(?:UP|DOWN)\b", 1))).otherwise(none)))
        .when(verb == "WRITE", part("FROM")).when(verb.isin("DISPLAY", "IF", "EVALUATE", "WHEN"), _names(t))
        .when(verb == "PERFORM", _names(F.regexp_extract(t, r"\bUNTIL\b(.*)$", 1))).otherwise(none)
    )
    defs = (
        F.when(verb == "MOVE", part("TO")).when(verb == "COMPUTE", _names(F.regexp_extract(t, r"^COMPUTE\b(.*?)=", 1)))
        .when(verb.isin("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"), F.when(giving, F.concat(*out)).otherwise(F.concat(F.when(verb == "ADD", part("TO")).when(verb == "SUBTRACT", part("FROM")).when(verb == "MULTIPLY", part("BY")).otherwise(part("INTO")), out[1])))
        .when(verb == "INITIALIZE", part("INITIALIZE")).when(verb == "ACCEPT", part("ACCEPT"))
        .when(verb == "SET", _names(F.regexp_extract(t, r"^SET\b(.*?)\b(?:TO|UP|DOWN)\b", 1)))
        .when(verb.isin("READ", "STRING", "UNSTRING"), part("INTO")).otherwise(none)
    )
    both = F.concat(F.transform(uses, lambda n: F.struct(F.lit("use").alias("role"), n.alias("name"))), F.transform(defs, lambda n: F.struct(F.lit("def").alias("role"), n.alias("name"))))
    return stmts.select(*IN_FILE, "paragraph", "ord", "line_start", "line_end", "verb", F.explode(F.array_distinct(both)).alias("s")).select("*", "s.role", "s.name").drop("s")


def traced(found: DataFrame, name: str) -> DataFrame:
    """The sites of one name, without case, in order of program, place and role."""
    return found.filter(F.col("name") == name.upper()).orderBy("program", "line_start", "line_end", "role", "verb")
