"""The query API over a corpus of programs: eleven lookups, each a small plan over the corpus' relations.

    corpus = Corpus.load(spark, "/programs", ["/copybooks"])
    corpus.read_paragraph("ACCT", "2000-PROCESS")

Relations (lines, masks, paragraphs, statements, fields, sites, ways) are made once, as tables in the shared folder, when
first asked for. A lookup filters them and collects what a caller can read: rows of one program, or capped ones. Unknown
programs, paragraphs, copybooks, records and scopes raise LookupFailed; call() turns any failure into an error observation.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions.source import clean_pic
from gneiss.operators import program, slices
from gneiss.operators.store import stored
from gneiss.sources import files

#: Lines of code shown, matches listed, characters of an observation.
CODE_LINES, MATCHES, OBSERVED = 60, 200, 4000
#: Runs in the line map of one copybook, beyond which asking is an error.
MAP_RUNS = 10_000
TOOLS = ("read_paragraph", "read_program", "find_callers", "find_callees", "trace_variable", "slice_on", "resolve_copybook", "get_data_layout", "grep", "run_program", "search_rules")


class LookupFailed(KeyError):
    """What was asked for isn't in the corpus."""


@dataclass(frozen=True)
class Node:
    program: str
    paragraph: str


@dataclass(frozen=True)
class Span:
    program: str
    line_start: int
    line_end: int
    paragraph: str | None = None


@dataclass(frozen=True)
class ParagraphView:
    ref: Span
    name: str
    code: str
    truncated: bool
    callers: list[Node]
    callees: list[Node]


@dataclass(frozen=True)
class ProgramView:
    program: str
    path: str
    paragraphs: list[Span]


@dataclass(frozen=True)
class Site:
    role: str
    ref: Span
    verb: str


@dataclass(frozen=True)
class Trace:
    variable: str
    scope: str | None
    sites: list[Site]


@dataclass(frozen=True)
class Slice:
    variable: str
    scope: str | None
    statements: list[Span]
    texts: list[str]
    paragraphs: list[Node]
    is_interprocedural: bool


@dataclass(frozen=True)
class Expansion:
    name: str
    text: str
    truncated: bool
    line_map: list[dict]


@dataclass(frozen=True)
class Layout:
    name: str
    level: int
    pic: str | None
    redefines: str | None
    children: list[Layout] = field(default_factory=list)


@dataclass(frozen=True)
class RecordLayout:
    record: str
    root: Layout
    source: Span


@dataclass(frozen=True)
class Found:
    pattern: str
    matches: list[dict]
    truncated: bool


@dataclass
class Corpus:
    """lines: program, file, line_no, text. books: name, file, search_ord, line_no, text. runner: (text, inputs) -> dict. searcher: query -> list."""

    lines: DataFrame
    books: DataFrame
    runner: Callable[[str, dict | None], dict] | None = None
    searcher: Callable[[str], list] | None = None

    @staticmethod
    def load(spark: SparkSession, root: str, copybooks: list[str] = (), **more) -> Corpus:
        lines = files.program_lines(files.read_programs(spark, root))
        return Corpus(stored(lines, "lines"), stored(files.read_copybooks(spark, list(copybooks)), "books"), **more)

    # relations ----------------------------------------------------------------------------------------------------------

    @functools.cached_property
    def programs(self) -> dict[str, str]:
        """Names and files; a corpus has as many programs as one can look through."""
        return {r["program"]: r["file"] for r in self.lines.groupBy("program").agg(F.min("file").alias("file")).orderBy("program").collect()}

    @functools.cached_property
    def masked(self) -> DataFrame:
        return stored(program.masked(self.lines), "masked")

    @functools.cached_property
    def code(self) -> DataFrame:
        return self.masked.select("program", "file", "line_no", F.col("masked").alias("text"))

    @functools.cached_property
    def spans(self) -> DataFrame:
        return stored(program.paragraphs(self.code, preamble=True), "spans")

    @functools.cached_property
    def statements(self) -> DataFrame:
        return stored(program.statements(self.code), "statements")

    @functools.cached_property
    def sites(self) -> DataFrame:
        return stored(program.sites(self.statements), "sites")

    @functools.cached_property
    def expansion(self) -> DataFrame:
        first = files.first_by_path(self.books).select("name", "line_no", "text")
        return stored(program.expanded(self.lines, first), "expansion")

    @functools.cached_property
    def fields(self) -> DataFrame:
        return stored(program.fields(self.expansion), "fields")

    @functools.cached_property
    def ways(self) -> DataFrame:
        return stored(program.transfers(self.spans, self.statements, program.blocks(self.masked)).filter("reason is null"), "ways")

    # lookups ------------------------------------------------------------------------------------------------------------

    def _program(self, name: str) -> str:
        if name.upper() not in self.programs:
            raise LookupFailed(f"unknown program {name!r}")
        return name.upper()

    def _ends(self, ways: DataFrame, p: str, n: str) -> list[Node]:
        return [Node(r["p"], r["n"]) for r in ways.select(F.col(p).alias("p"), F.col(n).alias("n")).distinct().orderBy("p", "n").collect()]

    def _node(self, name: str) -> str:
        if name.upper() not in self.programs and self.ways.filter(F.col("dst_program") == name.upper()).isEmpty():
            raise LookupFailed(f"unknown program {name!r}, and nothing leads there")
        return name.upper()

    def find_callers(self, program: str, para: str) -> list[Node]:
        """Who leads to a paragraph other than by falling through; none for one that isn't there."""
        return self._ends(self.ways.filter((F.col("dst_program") == self._node(program)) & (F.col("dst") == para)), "program", "src")

    def find_callees(self, program: str, para: str) -> list[Node]:
        return self._ends(self.ways.filter((F.col("program") == self._node(program)) & (F.col("src") == para)), "dst_program", "dst")

    def read_paragraph(self, program: str, name: str) -> ParagraphView:
        own = self._program(program)
        span = self.spans.filter((F.col("program") == own) & (F.upper("name") == name.upper())).orderBy("ord").first()
        if span is None:
            raise LookupFailed(f"unknown paragraph {name!r} in {program!r}")
        rows = self.lines.filter((F.col("program") == own) & F.col("line_no").between(span["line_start"], span["line_end"])).orderBy("line_no").limit(CODE_LINES).collect()
        code = "\n".join((r["text"] or "").rstrip() for r in rows)
        return ParagraphView(Span(own, span["line_start"], span["line_end"], span["name"]), span["name"], code, span["line_end"] - span["line_start"] >= CODE_LINES, self.find_callers(own, span["name"]), self.find_callees(own, span["name"]))

    def read_program(self, program: str) -> ProgramView:
        own = self._program(program)
        rows = self.spans.filter(F.col("program") == own).orderBy("ord").collect()
        return ProgramView(own, self.programs[own], [Span(own, r["line_start"], r["line_end"], r["name"]) for r in rows])

    def _asked(self, variable: str, scope: str | None) -> DataFrame:
        own = None if scope is None else self._program(scope)
        named = self.fields.select("program").distinct()
        return (named if own is None else named.filter(F.col("program") == own)).withColumn("variable", F.lit(variable))

    def trace_variable(self, variable: str, program: str | None = None) -> Trace:
        rows = slices.traces(self._asked(variable, program), self.sites, self.fields).orderBy("program", "line_start", "line_end", "role", "verb").collect()
        return Trace(variable, program and program.upper(), [Site(r["role"], Span(r["program"], r["line_start"], r["line_end"]), r["verb"]) for r in rows])

    def slice_on(self, variable: str, program: str | None = None) -> Slice:
        """Raises ValueError where a program's slice is too large to be a rule."""
        found = slices.slices(self._asked(variable, program), self.statements, self.sites, self.fields, self.spans)
        rows = found.groupBy("program", "line_start", "line_end").agg(F.min("paragraph").alias("paragraph"), F.max("error").alias("error")).orderBy("program", "line_start", "line_end").collect()
        if any(r["error"] for r in rows):
            raise ValueError(next(r["error"] for r in rows if r["error"]))
        own = self.lines.join(F.broadcast(self.lines.sparkSession.createDataFrame([(r["program"], r["line_start"], r["line_end"]) for r in rows], "p string, a int, b int")), (F.col("program") == F.col("p")) & F.col("line_no").between(F.col("a"), F.col("b")))  # a slice has MOST_STATEMENTS rows a program
        said = {(r["program"], r["a"], r["b"]): r["t"] for r in own.groupBy("program", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: F.rtrim(x["text"])), "\n").alias("t")).collect()}
        spans = [Span(r["program"], r["line_start"], r["line_end"], r["paragraph"]) for r in rows]
        nodes = list(dict.fromkeys(Node(s.program, s.paragraph) for s in spans if s.paragraph))
        return Slice(variable, program and program.upper(), spans, [said.get((s.program, s.line_start, s.line_end), "").strip() for s in spans], nodes, len(nodes) > 1)

    def resolve_copybook(self, name: str) -> Expansion:
        own = files.first_by_path(self.books.filter(F.upper("name") == name.upper()))
        if own.isEmpty():
            raise LookupFailed(f"unknown copybook {name!r}")
        whole = own.select(F.upper("name").alias("program"), "file", "line_no", "text")
        made = program.expanded(whole, files.first_by_path(self.books).select("name", "line_no", "text"))
        rows = made.orderBy("at").limit(CODE_LINES + 1).collect()
        runs = program.line_map(made).orderBy("expanded_start").limit(MAP_RUNS + 1).collect()
        if len(runs) > MAP_RUNS:
            raise LookupFailed(f"copybook {name!r} has more than {MAP_RUNS} runs of lines; program.line_map() has them all")
        return Expansion(name.upper(), "\n".join((r["text"] or "").rstrip() for r in rows[:CODE_LINES]), len(rows) > CODE_LINES, [{k: r[k] for k in ("expanded_start", "expanded_end", "file", "first_line")} for r in runs])

    def get_data_layout(self, record: str) -> RecordLayout:
        """The record of the first program, by name, that declares it, to the next of its level, a 77 or another file."""
        heads = self.fields.filter(F.col("name") == record.upper()).orderBy("program", "ord").first()
        if heads is None:
            raise LookupFailed(f"unknown record {record!r}")
        rows = layout(self.fields, self.expansion).filter((F.col("program") == heads["program"]) & (F.col("head") == heads["ord"])).orderBy("ord").collect()
        kids: dict[int, list] = {}
        for r in reversed(rows):
            made = Layout(r["name"], r["level"], r["pic"], r["redefines"], kids.pop(r["ord"], [])[::-1])
            kids.setdefault(r["above"], []).append(made)
            if r["ord"] == heads["ord"]:
                return RecordLayout(heads["name"], made, Span(rows[0]["file"], rows[0]["line_no"], max(x["line_no"] for x in rows)))
        raise LookupFailed(f"unknown record {record!r}")

    def grep(self, pattern: str) -> Found:
        """Matches in programs by name, then copybooks by path, at most MATCHES; truncated if there is another."""
        a = self.lines.select(F.lit(0).alias("o"), "program", F.lit("").alias("path"), "line_no", "text")
        b = self.books.select(F.col("search_ord") + 1, F.upper("name"), "file", "line_no", "text")
        rows = a.union(b.toDF(*a.columns)).filter(F.col("text").rlike(f"(?i){pattern}")).orderBy("o", "path", "program", "line_no").limit(MATCHES + 1).collect()
        return Found(pattern, [{"program": r["program"], "line": r["line_no"], "text": r["text"].rstrip()} for r in rows[:MATCHES]], len(rows) > MATCHES)

    def run_program(self, snippet: str, inputs: dict | None = None) -> dict:
        """What the runner says; without one, a program that only displays literals is read instead of run."""
        from gneiss.sources.executor import displayed_result, wrap

        return self.runner(wrap(snippet), inputs) if self.runner else displayed_result(snippet)

    def search_rules(self, query: str) -> list:
        if self.searcher is None:
            raise LookupFailed("no rules to search")
        return self.searcher(query)

    def call(self, tool: str, **arguments) -> dict:
        """An observation: tool, arguments, and either observation and truncated, or error. Nothing is raised."""
        out = {"tool": tool, "arguments": arguments, "error": None, "observation": None, "truncated": False}
        try:
            if tool not in TOOLS:
                raise LookupFailed(f"no tool {tool!r}")
            value = getattr(self, tool)(**arguments)
            plain = [asdict(v) if is_dataclass(v) else v for v in value] if isinstance(value, list) else asdict(value) if is_dataclass(value) else value
            said = json.dumps(plain, ensure_ascii=False, sort_keys=True)
            cut = len(said) > OBSERVED
            return out | {"observation": said[: OBSERVED - 1] + "…" if cut else said, "truncated": cut or bool(getattr(value, "truncated", False))}
        except Exception as e:  # an observation, whatever it was
            return out | {"error": f"{type(e).__name__}: {e}"}


def layout(fields: DataFrame, expansion: DataFrame) -> DataFrame:
    """fields with head (the ord of the record that holds them; its own for a head), above (of the item that holds them), file and pic.

    A record ends at its level or a lower one, at a 77, and where another file begins.
    """
    # no field is declared behind PROCEDURE DIVISION, and of lines with one number the first counts: what is behind it is never asked for
    before = Window.partitionBy("program").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.substring(F.coalesce("text", F.lit("")), program.BODY, program.BODY_LENGTH).rlike(r"(?i)^\s*PROCEDURE\s+DIVISION\b") & ~F.substring("text", program.INDICATOR, 1).isin("*", "/"), F.lit(False))
    head = expansion.withColumn("begins", begins).withColumn("past", F.coalesce(F.max("begins").over(before), F.lit(False))).filter(~F.col("past"))
    pic = clean_pic(F.nullif(F.regexp_extract("text", r"(?i)\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+?)\.?(?:\s|$)", 1), F.lit("")))
    said = head.select("program", "line_no", "at", F.struct("file", pic.alias("pic")).alias("x")).groupBy("program", "line_no").agg(F.min_by("x", "at").alias("x"))
    # lines, without their text, and fields are moved by program together, once: everything from here on stays within a program
    own = fields.withColumn("x", F.lit(None).cast(said.schema["x"].dataType)).withColumn("is_field", F.lit(True)).unionByName(said.withColumn("is_field", F.lit(False)), allowMissingColumns=True).repartition("program")
    f = own.withColumn("x", F.first("x", True).over(Window.partitionBy("program", "line_no"))).filter("is_field").select(*fields.columns, "x.file", "x.pic")
    order = Window.partitionBy("program").orderBy("ord")
    new = F.col("level").isin(1, 77) | (F.lag("file").over(order) != F.col("file")) | F.lag("file").over(order).isNull()
    f = f.withColumn("head", F.last(F.when(new, F.col("ord")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a row for the name and one for the parent's; the parent is the last field so named before this one
    each = f.withColumn("k", F.explode(F.array(F.struct(F.lit(False).alias("named"), F.col("parent").alias("key")), F.struct(F.lit(True).alias("named"), F.col("name").alias("key")))))
    so_far = Window.partitionBy("program", "head", "k.key").orderBy("ord", "k.named").rowsBetween(Window.unboundedPreceding, 0)
    up = each.withColumn("above", F.when(F.col("k.key").isNotNull(), F.last(F.when(F.col("k.named"), F.col("ord")), True).over(so_far)))
    return up.filter("not k.named").select(*f.columns, "above")
