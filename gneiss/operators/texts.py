"""Programs as whole texts: masks, paragraphs, ways and statements in one walk of each text, without a row for a line.

masked(), outline() and statements() of gneiss.operators.program take rows of lines, which have to be sorted by file and passed through windows; where a file's text is
one row, all that the windows ask of a line is told while its lines go by. What is told is the same. Lines are as program_lines() cuts them, a text of null has none. A task
holds one text at a time, and what one line says is remembered, since a program's lines are much alike.

programs: (program, file, text), one row a file, as read_programs() gives them.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame

from gneiss.operators import parse

# Fixed values, as gneiss.operators.program has them for Spark's patterns, in which a dot stands for no line break of any kind and \b asks for letters of all scripts.
_DOT = r"[^\n\r\x85\u2028\u2029]"
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_FLAGS = re.I | re.A
EXEC = re.compile(r"(?u:\b)EXEC\s+(CICS|SQL|DLI)(?u:\b)", _FLAGS)
COPY_REPLACING = re.compile(rf"(?u:\b)COPY(?u:\b){_DOT}*(?u:\b)REPLACING(?u:\b)", _FLAGS)
CLOSES = re.compile("END-EXEC", _FLAGS)
OPENING = re.compile(rf"({_DOT}*?(?u:\b)VALUE\s+(?:IS\s+)?(['\"]))", _FLAGS)
APART = re.compile(r"(?u:\b)NOT=", _FLAGS)
BEGINS = re.compile(r"\s*PROCEDURE\s+DIVISION(?u:\b)", _FLAGS)
HEADER = re.compile(rf"([A-Z0-9][A-Z0-9-]*)\s*\.\s*{_END}", _FLAGS)
SECTION = re.compile(r"[A-Z0-9-]+\s+SECTION\s*\.", _FLAGS)
INDICATOR, BODY_END = 6, 72
CONTINUE = " " * 11 + "CONTINUE"
NO_LABELS = frozenset(["END", "EXIT", "GOBACK", "STOP", "CONTINUE"])


@lru_cache(parse._LINES)
def _opens(line: str) -> tuple[str | None, bool]:
    """The kind of masked block that a line opens, if any, and whether it continues the line before."""
    mark, body = line[INDICATOR : INDICATOR + 1], line[INDICATOR + 1 : BODY_END]
    if mark in ("*", "/"):
        return None, False
    form = EXEC.search(body)
    if form:
        return "exec_" + form[1].lower(), mark == "-"
    return "copy_replacing" if COPY_REPLACING.search(body) else None, mark == "-"


def _apart(line: str) -> str:
    return APART.sub("NOT =", line) if "=" in line and line[INDICATOR : INDICATOR + 1] not in ("*", "/") else line


def masks(lines: list[str]) -> tuple[list[str], list[tuple]]:
    """What masked() leaves of the lines of one file, and its blocks: kind, first and last line (from 1). An unterminated block is an error."""
    told = [_opens(x) for x in lines]
    if not any(kind or goes_on for kind, goes_on in told):
        return [_apart(x) for x in lines], []
    ends = [x[INDICATOR + 1 : BODY_END].rstrip(" ").endswith(".") for x in lines]
    exec_end = copy_end = None
    untils: dict[int, int | None] = {}
    for k in range(len(lines) - 1, -1, -1):
        if CLOSES.search(lines[k][INDICATOR + 1 : BODY_END]):
            exec_end = k
        if ends[k]:
            copy_end = k
        if told[k][0]:
            untils[k] = copy_end if told[k][0] == "copy_replacing" else exec_end
    blocks, of, most = [], {}, -1
    for k in sorted(untils):
        until = untils[k]
        if most < k:
            if until is None:
                raise ValueError(f"unterminated {told[k][0]} at line {k + 1}")
            blocks.append((told[k][0], k + 1, until + 1))
            of.update((x, blocks[-1]) for x in range(k, until + 1))
        most = max(most, len(lines) if until is None else until)
    out = []
    head, last_dot, n = None, {}, len(lines)
    # how a run of continued lines ends, told to all of its lines
    for k in range(n - 1, -1, -1):
        last_dot[k] = last_dot[k + 1] if k + 1 < n and told[k + 1][1] else ends[k]
    for k, line in enumerate(lines):
        goes_on, continues = k + 1 < n and told[k + 1][1], told[k][1]
        if not continues:
            form = OPENING.match(line[INDICATOR + 1 : BODY_END]) if goes_on and line[INDICATOR : INDICATOR + 1] not in ("*", "/") else None
            head = form and line[: INDICATOR + 1] + form[1] + "X" + form[2]
        if k in of:
            kind, start, end = of[k]
            first, last = start == k + 1, end == k + 1
            if kind == "copy_replacing":
                out.append(CONTINUE + "." if last else "")
            else:
                out.append(CONTINUE + ("." if last and ends[k] else "") if first else CONTINUE + "." if last and ends[k] else "")
        elif head is not None and continues:
            out.append("")
        elif head is not None and goes_on:
            out.append(head + ("." if last_dot[k] else ""))
        else:
            out.append(_apart(line))
    return out, blocks


@lru_cache(parse._LINES)
def _says(line: str) -> tuple[bool, str | None, str | None, bool]:
    """Of a masked line that is no comment: whether PROCEDURE DIVISION begins in it, its header, its code (null if it has none) and whether it isn't blank; of a comment nothing."""
    if line[INDICATOR : INDICATOR + 1] in ("*", "/"):
        return False, None, None, False
    body = line[INDICATOR + 1 : BODY_END]
    form = HEADER.match(body.rstrip(" "))
    name = form and form[1].upper()
    if name and (name in NO_LABELS or name.startswith("END-")):
        name = None
    return bool(BEGINS.match(body)), name, None if name or SECTION.match(body) else body, line.strip(" ") != ""


def cut(text: str) -> list[str]:
    """The lines of a text, as program_lines() cuts it."""
    if text.endswith("\n"):
        text = text[:-2] if text.endswith("\r\n") else text[:-1]
    return (text.replace("\r\n", "\n") if "\r" in text else text).split("\n")


def procedure(lines: list[str]) -> tuple[list[str], list[int], list[tuple[int, str]], int | None]:
    """Of the masked lines of one file behind its PROCEDURE DIVISION: the code, the numbers of its lines, line and name of each header, and the last line that isn't blank."""
    bodies, nos, heads, last, inside = [], [], [], None, False
    for no, line in enumerate(lines, 1):
        begins, header, body, said = _says(line)
        if not inside:
            inside = begins
            continue
        if said:
            last = no
        if header is not None:
            heads.append((no, header))
        elif body is not None:
            bodies.append(body)
            nos.append(no)
    return bodies, nos, heads, last


def _walked(programs: DataFrame, unit: list[str], types, rows) -> DataFrame:
    """unit and what rows() gives of each text."""
    kinds = {"string": "string", "int": "int32", "bigint": "int64", "boolean": "bool_"}
    schema = ", ".join([*(f"{c} string" for c in unit), *(f"{n} {t}" for n, t in types)])

    def run(batches):
        import pyarrow as pa

        arrow = [(n, pa.list_(getattr(pa, kinds[t[6:-1]])()) if t.startswith("array") else getattr(pa, kinds[t])()) for n, t in types]
        for batch in batches:
            at, out = [], []
            named = batch.column("program").to_pylist()
            for k, text in enumerate(batch.column("text").to_pylist()):
                if text is None:
                    continue
                made = rows(cut(text), named[k])
                at += [k] * len(made)
                out += made
                if len(out) >= parse._BATCH:
                    yield parse._handed(batch, unit, at, out, arrow)
                    at, out = [], []
            yield parse._handed(batch, unit, at, out, arrow)

    return programs.select(*dict.fromkeys([*unit, "program", "text"])).mapInArrow(run, schema)


def outlined(programs: DataFrame, unit: list[str], kinds: list[str], preamble: str) -> DataFrame:
    """parse.outlined() of whole texts and their masks."""

    def rows(lines: list[str], program: str | None) -> list[tuple]:
        return _outline(lines, kinds, preamble)

    types = [("ord", "int"), ("paragraph", "string"), ("kind", "string"), ("verb", "string"), ("text", "string"), ("line_start", "int"), ("line_end", "int"), ("depth", "bigint")]
    return _walked(programs, unit, types, rows)


def placed(programs: DataFrame, unit: list[str], preamble: str) -> DataFrame:
    """parse.placed() of whole texts and their masks."""

    def rows(lines: list[str], program: str | None) -> list[tuple]:
        bodies, nos, heads, _ = procedure(masks(lines)[0])
        names = parse.named(nos, heads, preamble)
        return [(names[k], *row) for k, row in parse.statements(bodies, nos, names)]

    ints = [("line_start", "int"), ("line_end", "int"), ("parent", "int")]
    types = [("paragraph", "string"), ("ord", "int"), ("kind", "string"), ("verb", "string"), ("text", "string"), *ints, ("depth", "bigint"), ("branch", "string"), ("guards", "array<int>"), ("block_end", "int")]
    return _walked(programs, unit, types, rows)


_GO = re.compile(rf"GO\s+(?:TO\s+)?({_DOT}*?)(?:\s+DEPENDING(?u:\b){_DOT}*)?{_END}", _FLAGS)
_CALL = re.compile(r"CALL\s+['\"]([^'\"]+)", _FLAGS)
_THRU = re.compile(r"(?u:\b)THR(?:U|OUGH)\s+(\S+)", _FLAGS)
_AWAY = re.compile(r"STOP\s+RUN|EXIT\s+PROGRAM", _FLAGS)
_LINK = re.compile(r"(?u:\b)(LINK|XCTL)(?u:\b)", _FLAGS)
_PROGRAM = re.compile(r"(?u:\b)PROGRAM\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", _FLAGS)
_ANY_PROGRAM = re.compile(r"(?u:\b)PROGRAM\s*\(", _FLAGS)


@lru_cache(parse._LINES)
def _aims(kind: str, text: str) -> tuple[list[str | None], str | None]:
    """Where a statement passes control to, and the end of a range."""
    if kind == "CALL":
        form = _CALL.match(text)
        return [form[1].upper() if form else None], None
    if kind == "GOTO":
        form = _GO.match(text)
        return [x for x in re.split(r"[\s,]+", form[1].upper(), flags=re.A) if x] if form else [], None
    said, form = parse.SPACE.split(text, 2), _THRU.search(text)
    return [said[1].upper() or None if len(said) > 1 else None], form[1].upper() if form else None


def _ways(program: str | None, outline: list[tuple]) -> tuple[list[str], list[tuple], list[tuple]]:
    """Of the parse.outline() of one program: its paragraphs in order, its ways (src, line, kind, dst_program, dst, reason, whether dst is still to be found) and (src, dst) of what falls through."""
    spans = [r for r in outline if r[2] == parse.PARAGRAPH]
    names = [r[1] for r in spans]
    place: dict[str, int] = {}
    if program is not None:  # no name, no paragraphs to meet
        for k, name in enumerate(names):
            place.setdefault(name, k)
    ways: list[tuple] = []
    last: dict[str, tuple] = {}
    for ord_, src, kind, verb, text, line, end, depth in outline:
        if kind == parse.PARAGRAPH:
            continue
        if kind == parse.BLOCK:
            link = _LINK.search(text)
            if link:
                around = [r[1] for r in spans if r[5] <= line <= r[6]] if program is not None else []
                form = _PROGRAM.search(text)
                if around and not form and not _ANY_PROGRAM.search(text):
                    raise ValueError(f"no PROGRAM(...) at line {line} of {program}")
                for src in around or [None]:
                    reason = "outside any paragraph" if src is None else None if form else "dynamic"
                    ways.append((src, line, link[1].lower(), None if reason else form[1].upper(), None, reason, not reason))
            continue
        if src not in last or last[src][0] < ord_:
            last[src] = (ord_, verb, depth, text)
        if kind == "CALL":
            callee = _aims(kind, text)[0][0]
            ways.append((src, line, "call", callee, None, None if callee else "dynamic", callee is not None))
        elif kind == "GOTO":
            for label in _aims(kind, text)[0] or [None]:
                known = label in place
                ways.append((src, line, "goto", program if known else None, label if known else None, None if known else "unknown paragraph", False))
        elif kind == "PERFORM_CALL":
            (label,), thru = _aims(kind, text)
            low = place.get(label)
            high = low if thru is None else place.get(thru)
            if label is None or low is None or high is None or low > high:
                reason = "no target" if label is None else ("unknown paragraph" if thru is None else "unknown endpoint") if low is None or high is None else "backwards"
                ways.append((src, line, "perform", None, None, reason, False))
            else:
                ways += [(src, line, "perform", program, names[k], None, False) for k in range(low, high + 1)]
    falls = []
    for a, b in zip(names, names[1:], strict=False):
        if a in last:
            _, verb, depth, text = last[a]
            if depth == 0 and (verb in ("GO", "GOBACK") or _AWAY.match(text)):
                continue
        falls.append((a, b))
    return names, ways, falls


def _outline(lines: list[str], kinds: list[str], preamble: str) -> list[tuple]:
    left, blocks = masks(lines)
    bodies, nos, heads, last = procedure(left)
    return parse.outline(bodies, nos, heads, last, [(*b, lines[b[1] - 1 : b[2]]) for b in blocks], kinds, preamble)


#: Kind of the row of transfers() that tells a program's first paragraph.
FIRST = "FIRST"


def transfers(programs: DataFrame, kinds: list[str], preamble: str, blocks: bool) -> DataFrame:
    """program, src, line, kind, dst_program, dst, reason and far, of every way of control; where far, dst is the first paragraph of dst_program, which its own row of kind FIRST tells.

    One text a program: all that leads to a paragraph of the same program is told by the walk.
    """

    def rows(lines: list[str], program: str | None) -> list[tuple]:
        outline = _outline(lines, kinds, preamble)
        names, ways, _ = _ways(program, outline if blocks else [r for r in outline if r[2] != parse.BLOCK])
        return [*ways, (names[0], None, FIRST, None, None, None, False)] if names else ways

    types = [("src", "string"), ("line", "int"), ("kind", "string"), ("dst_program", "string"), ("dst", "string"), ("reason", "string"), ("far", "boolean")]
    return _walked(programs, ["program"], types, rows)


def reach(programs: DataFrame, kinds: list[str], preamble: str) -> DataFrame:
    """program, ord, name, distance and led_to of every paragraph: by PERFORM, GO TO and falling through, from its program's first one, and whether any of these leads to it. One text a program."""

    def rows(lines: list[str], program: str | None) -> list[tuple]:
        names, ways, falls = _ways(program, [r for r in _outline(lines, kinds, preamble) if r[2] != parse.BLOCK])
        next_: dict[str, list[str]] = {}
        for src, dst in [*((w[0], w[4]) for w in ways if w[4] is not None), *falls]:
            next_.setdefault(src, []).append(dst)
        led = {x for xs in next_.values() for x in xs}
        far = {names[0]: 0} if names else {}
        queue = deque(far)
        while queue:
            at = queue.popleft()
            for n in next_.get(at, ()):
                if n not in far:
                    far[n] = far[at] + 1
                    queue.append(n)
        return [(k + 1, n, far.get(n), n in led) for k, n in enumerate(names)]

    return _walked(programs, ["program"], [("ord", "int"), ("name", "string"), ("distance", "int"), ("led_to", "boolean")], rows)


def trees(programs: DataFrame, unit: list[str], preamble: str) -> DataFrame:
    """unit, paragraph, n_statements, deepest, most_guards, inner_statements and tree of every paragraph with a statement, as its rows of placed() give them, of which there need not be any.

    tree is the md5 of a line a statement, in order: ord, kind, verb, line, depth, parent (0: none), branch (-: none), guards and last line.
    """

    def rows(lines: list[str], program: str | None) -> list[tuple]:
        bodies, nos, heads, _ = procedure(masks(lines)[0])
        names = parse.named(nos, heads, preamble)
        held: dict[str, list] = {}
        for own, _, placed, before in parse.runs(bodies, names):
            at = [nos[k] for k in own]
            for o, kind, verb, _, _, start, _, parent, depth, branch, guards, end in placed:
                said = f"{before + o} {kind} {verb} {at[start]} {depth} {parent + before if parent else 0} {branch or '-'} [{','.join([str(at[g]) for g in guards])}] {at[end]}"
                held.setdefault(names[own[start]], []).append((before + o, said, depth, len(guards), parent is not None))
        out = []
        for name, own in held.items():
            own.sort()
            _, said, depths, guards, inner = zip(*own, strict=True)
            out.append((name, len(own), max(depths), max(guards), sum(inner), hashlib.md5("\n".join(said).encode()).hexdigest()))
        return out

    return _walked(programs, unit, [("paragraph", "string"), ("n_statements", "bigint"), ("deepest", "bigint"), ("most_guards", "int"), ("inner_statements", "bigint"), ("tree", "string")], rows)
