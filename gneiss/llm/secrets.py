"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The base patterns find assignments, access keys and long hexadecimal runs. Besides, every whole run of LEAST or more key-like
characters near or around a sensitive word is a candidate, and near one every run with the signs that passwords have. A compressor is primed with a dictionary of the pieces that
words and identifiers are made of (those of a public tokenizer's vocabulary, whose rank file is a parameter, and WORDS in the forms that code has them); it packs the text before the candidate, and the words that the text
has elsewhere and the candidate too, with and without the candidate, in lower case. A candidate that costs nearly as many bytes as random characters of its alphabet would can be a secret: words and
identifiers cost about two thirds of that, however they are joined. A run that holds the sensitive word itself, as in `auth=KEY` or
`secret_access_key/KEY`, is scored without the name.

Words that no dictionary has cost much as well, so a candidate is reported as `novel` only if two exact checks don't tell it to be a name: it hasn't the shape of one
(parts of letters in one case or camel case, dates, numbers: see shaped), and its letters don't follow each other as those of the vocabulary's pieces do (see surprise).

Not candidates, so not found unless by a base pattern: runs of fewer than LEAST characters, digits alone, words joined by
separators (pass phrases), and runs with signs at a distance from any sensitive word. Random strings are missed where they happen to look like names.

Each text is scanned by itself and whole, in steps that grow with its length alone: runs, words and base spans are walked once, in order. Nothing is shuffled and no key can be hot; memory is that of one batch and of the
dictionary, of some 0.2 MB with a vocabulary of 50,000.

Nulls, empty and repeated rows: a null text has no spans; rows are independent, so repeated rows and ties between rows
have no effect; spans with an equal start are ordered assign, access, hex, novel; a novel span that overlaps a base one
isn't reported; an empty table gives an empty table; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import values

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"passw|secret|token|api.?key|auth|bearer|credential|private|signature|access.?key|jwt|client.?id|conn.?str|pwd", re.ASCII | re.IGNORECASE)
LEAST = 12
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}", re.ASCII)
#: A run that passwords may be, and its signs; a plain run lies within one.
SIGNS = "!@#$%^&*"
SIGNED = re.compile(rf"(?<![A-Za-z0-9+/_=!@#$%^&*-])[A-Za-z0-9+/_=!@#$%^&*-]{{{LEAST},}}", re.ASCII)
#: The rest of a name behind its sensitive word, and a further part of it, each with its separator; pieces of
#: identifiers, and the characters that they have on average; what may stand before the word.
REST = re.compile(r"[A-Za-z0-9]*(([+/_=-])\2*)", re.ASCII)
PART = re.compile(r"([A-Z]?[a-z]{1,15}|[A-Z]{1,15}|[vV]?[0-9]{1,3})(([+/_=-])\3*)", re.ASCII)
PIECE, LONGEST = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), 4
HEAD = re.compile(r"[+/_=-]*(?:(?:[A-Za-z]+|[vV]?[0-9]{1,4})[+/_=-]+)*[A-Za-z]*", re.ASCII)
#: What a name is made of: parts between separators, of pieces of letters; digits end a part.
SEPARATORS = re.compile(r"[^A-Za-z0-9]+", re.ASCII)
NAMED_PART = re.compile(r"(?:[vV][0-9]{1,2}(?=[A-Z]|$)|[A-Z]?[a-z]++|[A-Z]+(?=[A-Z][a-z]|[0-9]|$))++[0-9]{0,4}|[0-9]{1,4}|[A-Za-z0-9]{1,3}", re.ASCII)
TIME = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt_-]?[0-9-]*[Zz]?", re.ASCII)
#: Characters before a candidate in which a sensitive word counts, and that it is compressed against.
NEAR, CONTEXT = 48, 256
#: Least share of the bytes that as many random characters of the candidate's alphabet would take. Set between made-up
#: identifiers and random keys of 16 to 64 characters; tests/llm holds it to other such ones, and to longer ones.
NOVEL = 0.74
#: Least mean bits of a candidate's letters, as _letters() has them, where it has other characters and where it has none; letters of a name's piece on average.
STRANGE, SHORT = (5.0, 5.8), 2.5
#: A word of the text itself.
OWN = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}", re.ASCII)
#: Code that is packed before every context, since the compressor leaves a block alone that has too little to gain.
PAD = b"config value = get_value(self.value); password = os.environ[name] if name else none; return self.config.value\n" * 2
#: Letters that a piece of the vocabulary has at least to be in the dictionary; the compressor's level.
LETTERS, LEVEL = 4, 12

_DIGITS, _HEX, _LETTERS, _BASE36 = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnopqrstuvwxyz"

#: What identifiers and code around secrets are made of.
WORDS = (
    "access account action address agent algorithm api app application array async auth authorization aws azure backend base64 basic bearer begin bool boolean bucket buffer build bytes cache "
    "callback certificate channel char class client cloud code column command commit config configuration connection const container content context cookie count create credential crypto "
    "database date debug decode default define delete deploy description digest docker document domain double driver email enable encode encrypt endpoint engine env environment error event "
    "example exception export external false fetch field file filter final float format from function gateway generate github global google group handler hash header headers hello host http "
    "https id identifier image import index init input insert instance int integer interface internal item java javascript json jwt key kubernetes label language length level library license "
    "line list listener load local localhost log logger login long manager map master memory message metadata method mode model module monitor name namespace network node null number oauth "
    "object openssl option options order output package page parameter parent parse passwd password path payload permission placeholder platform plugin pointer policy port postgres prefix "
    "private process production profile project property protocol provider proxy public python query queue random read redis refresh region register release remote replace repository request "
    "resource response result return role root route row rsa salt sample schema scope secret secure security select send serial server service session setting settings shared sign signature "
    "size socket source sql ssh ssl staging start state static status storage stream string struct subject submit success switch system table tag target task template temp test text thread "
    "timeout timestamp tls token total trace transaction true type undefined unique update upload url user username util uuid validate value variable vector verify version view void webhook "
    "window worker write yaml your zone"
).split()


def pieces(ranks_path: str) -> list[bytes]:
    """The pieces of letters in a vocabulary, in lower case, in the order of rank, which is that of frequency."""
    with open(ranks_path, "rb") as f:
        words = (base64.b64decode(line.split()[0]).strip().lower() for line in f)
        return list(dict.fromkeys(w for w in words if len(w) >= LETTERS and w.isalpha() and w.isascii()))


@functools.cache
def _packer(ranks_path: str):
    import zstandard

    primed = b" ".join(reversed(pieces(ranks_path)))  # the nearest are the cheapest
    primed += "\n".join(["", *(f"{w} {w}_id = get_{w}(self.{w});" for w in WORDS), "abcdefghijklmnopqrstuvwxyz 0123456789 0123456789abcdef"]).encode()
    primed += b"\n".join([b"", b"a" * 24, b"x" * 24, b"0" * 24, b"-" * 24, b"_" * 16, b"=" * 16])
    held = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


@functools.cache
def _random(length: int, digits: str) -> list[bytes]:
    rnd = random.Random(length)
    return ["".join(rnd.choices(digits, k=length)).encode() for _ in range(3)]


def novelty(text: str, start: int, end: int, known: set[str], ranks_path: str) -> float:
    """The marginal compressed bytes of text[start:end] after its context, as a share of what random characters take there, on average of three draws.

    The context is the text before it and those of the text's own words (known) that are in it, which only a compressor with so wide a window would find.
    """
    own = text[start:end].lower()
    again = {own[i : i + n] for i in range(len(own)) for n in range(4, 16)} & known if known else ()
    before = PAD + " ".join(sorted(again)).encode() + text[max(0, start - CONTEXT) : start].lower().encode()
    pack = _packer(ranks_path).compress
    digits = next((d for d in (_DIGITS, _HEX, _LETTERS) if set(own) <= set(d)), _BASE36)
    size = len(own) if len(own) < 512 else len(own) // 64 * 64  # few values to keep
    least = len(pack(before))
    like = sum(len(pack(before + r)) - least for r in _random(size, digits)) / (3 * size)
    return (len(pack(before + own.encode())) - least) / (len(own) * like)


def starts(text: str, start: int, end: int, word: tuple[int, int] | None, near: bool) -> list[int]:
    """Where in the run text[start:end] a secret may begin, best first; word is the first sensitive word that ends in the run."""
    out = [start] if near else []
    if word and (m := REST.match(text, word[1], end)):
        first = name = m.end()
        by = m[2]
        while (m := PART.match(text, name, end)) and (SENSITIVE.match(m[1]) or by != "=" and (m[3] in (by, "=") or m[1].lower() in WORDS)):
            name, by = m.end(), m[3]
        named = HEAD.fullmatch(text, start, max(start, word[0]))
        out = [name, first, *out] if named else [*out, name, first]
    elif word and not near and LONGEST * len(PIECE.findall(text, start, end)) > end - start:
        out = [start]  # no separator: long pieces are those of an identifier
    value = start + len(text[start:end].rstrip("="))
    last = [text.rfind(c, start, value) + 1 for c in "=/+_-"]
    return list(dict.fromkeys([*out, *(x for x in (last[0], max(last)) if x)]))


def shaped(own: str) -> bool:
    """Whether own has the shape of a name, path, date or number: parts of letters in one case or camel case, each with digits at its end at most."""
    parts = [p for p in SEPARATORS.split(own) if p]
    if TIME.fullmatch(own) or not any(c.isalpha() for c in own):
        return True  # a number of 16 digits or more is a base span
    if not all(NAMED_PART.fullmatch(p) for p in parts):
        return False
    pieces = [x for p in parts for x in PIECE.findall(p) if x[0].isalpha()]
    return len(parts) + len(pieces) > 2 and sum(map(len, pieces)) >= SHORT * len(pieces)


@functools.cache
def _letters(ranks_path: str):
    """Bits that a letter takes after the two before it, among the vocabulary's pieces; 0 stands for what is no letter."""
    import numpy as np

    counts = np.full((27, 27, 27), 0.02)
    for piece in pieces(ranks_path):
        codes = [0, 0, *(c - 96 for c in piece)]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[a, b, c] += 1
    two = counts.sum(axis=0) + 0.5  # the letter before alone, where both together are rare
    prior = two / two.sum(axis=1, keepdims=True)
    share = (counts + 3 * prior) / (counts.sum(axis=2, keepdims=True) + 3)
    return (-np.log2(share)).tolist()


def surprise(own: str, ranks_path: str) -> float:
    """Mean bits of a letter of own, in lower case; what random letters have is well above that of words in any tongue written in them."""
    bits, a, b, total, n = _letters(ranks_path), 0, 0, 0.0, 0
    for c in own.lower().encode():
        c = c - 96 if 97 <= c <= 122 else 0
        if c:
            total, n = total + bits[a][b][c], n + 1
        a, b = b, c
        if not c:
            a = b = 0
    return total / n if n else math.inf


def _own_words(text: str, but: list[tuple[int, int]]) -> set[str]:
    """Pieces of 4 to 15 letters in the text, in lower case, outside the spans."""
    out, at = set(), 0
    for a, b in [*but, (len(text), len(text))]:
        if at < a:
            out.update(w.lower() for w in OWN.findall(text, at, a))
        at = max(at, b)
    return {w for w in out if len(w) <= 15}


def spans(text: str | None, ranks_path: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) in code points, ordered."""
    if not text:
        return []
    low = text.lower()
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base = sorted(found)
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return base
    return sorted(base + _novel(text, base, words, ranks_path))


def _novel(text: str, base: list[tuple[int, int, int]], words: list[tuple[int, int]], ranks_path: str) -> list[tuple[int, int, int]]:
    """The spans that the method adds: one walk over the runs, with each run's candidates in order."""
    begins, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    ends = [b for _, b in words]

    def taken(at: int, end: int) -> bool:
        before = bisect_left(begins, end)
        return before > 0 and reach[before - 1] > at

    asked: list[list[tuple[int, int]]] = []
    for c in SIGNED.finditer(text):
        candidates = []
        run = text[c.start() : c.end()]
        core = run.strip(SIGNS)
        core = run if len(core) < LEAST else core
        at = c.start() + run.index(core)
        if any(x in SIGNS for x in core) and not any(x in "=/" for x in core):
            i = bisect_right(ends, at)
            if i and at <= ends[i - 1] + NEAR:
                candidates.append((at, at + len(core)))
        for m in RUN.finditer(text, c.start(), c.end()):
            start, end = m.span()
            i = bisect_right(ends, start)
            near = i > 0 and start <= ends[i - 1] + NEAR
            word = words[i] if i < len(words) and words[i][1] <= end else None
            if near or word:
                candidates += [(x, end) for x in starts(text, start, end, word, near)]
        candidates = [(a, b) for a, b in candidates if b - a >= LEAST and not taken(a, b) and not shaped(text[a:b])]
        if candidates:
            asked.append(candidates)
    if not asked:
        return []
    known = _own_words(text, [(min(a for a, _ in x), max(b for _, b in x)) for x in asked])
    out: list[tuple[int, int, int]] = []
    for candidates in asked:
        for a, b in candidates:
            if (not out or out[-1][2] <= a) and is_novel(text, a, b, known, ranks_path):
                out.append((a, 3, b))
    return out


def is_novel(text: str, a: int, b: int, known: set[str], ranks_path: str) -> bool:
    own = text[a:b]
    least = 0.0 if set(own.lower()) <= set(_HEX + "-") else STRANGE[own.isalpha()]
    return novelty(text, a, b, known, ranks_path) >= NOVEL and surprise(own, ranks_path) >= least


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans of every whole text."""

    def run(batches):
        for batch in batches:
            each = [spans(t, ranks_path) for t in values(batch.column(1))]
            count = lambda kind: pa.array([sum(k == kind for _, k, _ in s) for s in each], pa.int64())
            digest = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(count(k) for k in range(4)), pa.array(digest, pa.string()), pa.array([joined(s) for s in each], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
