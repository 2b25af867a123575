"""Periodic runs: stretches of words that say the same few words over and over, found exactly and collapsed to one round.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, TIMES * q) words long, that no
neighbouring word extends keeping period q. Words are interned as numbers; then Main and Lorentz's divide and conquer finds
the runs: at each midpoint, Z-functions of the two halves and of their mirror images tell, for every period at once, how far
a repetition across the midpoint reaches to each side. Each is extended over its whole text (one that a neighbour extends is
found whole at a midpoint further up, and dropped here), equal intervals are told once, and the smallest period stays.

Only stretches that can hold a run are divided: a run's every three words in a row stand in it three times at least, so a
text is first cut, again and again, at places whose three words are rarer than that in their stretch. This drops no run, and
leaves little of plain prose.

A document is one row and one task's work at a time: n words take O(n log n) steps at most and some 200 bytes a word, however
long the text. Nothing is shuffled. Nulls and blank texts have no words, so no run; repeated rows are judged alike; an empty table stays
empty; a null id passes; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import values

#: Words in a run at least, and its length in periods at least. TIMES has to be 4 at least and LEAST 6, for the cuts to be safe.
LEAST, TIMES = 6, 4

#: Three numbers below this fit in one of 64 bits.
PACKED = 1 << 21


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() parts at just these characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def interned(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal where words are: the place where it is first seen."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))


def z_function(s: list[int], most: int | None = None) -> list[int]:
    """By place, up to most or to the end, how many items from there on equal those from the start on."""
    n = len(s)
    upto = n if most is None else min(n, most + 1)
    z = [0] * upto
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of x, as start and end, that hold every run."""
    todo = [(0, len(x))]
    while todo:
        start, end = todo.pop()
        if end - start < LEAST:
            continue
        part = x[start:end]
        if len(x) < PACKED:
            two = part[:-1] * PACKED + part[1:]
        else:
            _, two = np.unique(part[:-1] * len(x) + part[1:], return_inverse=True)
        _, three, often = np.unique(two[:-1] * max(len(x), PACKED) + part[2:], return_inverse=True, return_counts=True)
        kept = np.concatenate(([False], often[three] >= 3, [False]))
        edges = np.flatnonzero(kept[1:] != kept[:-1])
        cut = [(start + int(a), start + int(b) + 2) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        if cut == [(start, end)]:
            yield start, end
        else:
            todo += cut


def _crossing(s: list[int], mid: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions in s[low:high] across mid that are long enough, extended within it."""
    right, back = s[mid:high], s[low:mid]
    back.reverse()
    most = (high - low) // TIMES
    ahead, behind = z_function(right, most), z_function(back, most)
    # how far the right half goes on as the text that starts q words before mid; and the left half, read backwards, as what ends q words behind it
    on = z_function([*right[:most], -1, *reversed(back[:most])])[::-1]
    to = z_function([*back[:most], -1, *reversed(right[:most])])[::-1]
    for q in range(1, min(most, mid - low) + 1):
        k = on[q - 1]
        if k == q and q < len(right):
            k += ahead[q]
        start, end = mid - q - (behind[q] if q < len(back) else 0), mid + k
        if end - start >= LEAST and end - start >= TIMES * q:
            yield start, end, q
    for q in range(1, min(most, high - mid) + 1):
        k = to[q - 1]
        if k == q and q < len(back):
            k += behind[q]
        start, end = mid - k, mid + q + (ahead[q] if q < len(right) else 0)
        if end - start >= LEAST and end - start >= TIMES * q:
            yield start, end, q


def repetitions(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    for first, last in _stretches(x):
        s = x[first:last].tolist()
        todo = [(0, len(s))]
        while todo:
            low, high = todo.pop()
            if high - low < LEAST:
                continue
            mid = (low + high) // 2
            todo += [(low, mid), (mid, high)]
            for a, b, q in _crossing(s, mid, low, high):
                # the stretch's neighbours can't extend a run: it would reach into what was cut
                if (a and s[a - 1] == s[a - 1 + q]) or (b < len(s) and s[b] == s[b - q]):
                    continue
                at = (a + first, b + first)
                found[at] = min(q, found.get(at, q))
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run has after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def looped(words: list[bytes], doc_id: str | None) -> list[bytes]:
    """The words with a loop planted from some place on, in each document whose id's crc32 10 divides."""
    h = None if doc_id is None else zlib.crc32(doc_id.encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapse_runs(docs: DataFrame, text: str = "text", out: str = "collapsed", spans: str = "runs") -> DataFrame:
    """docs with the text's words joined by one space, each run cut to its first period, and the runs as an array of (start, length, period).

    A column with an output's name is replaced. A null text stays null and has no run.
    """
    kept = [c for c in docs.columns if c.lower() not in (out.lower(), spans.lower())]
    made = f"{out} string, {spans} array<struct<start: long, length: long, period: long>>"
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema
    for f in docs.sparkSession.createDataFrame([], made).schema:
        schema = schema.add(f)
    source = "__runs_text"

    def run(batches):
        for batch in batches:
            texts, found = [], []
            for t in values(batch.column(source)):
                words = words_of(t)
                runs = repetitions(interned(words))
                texts.append(None if t is None else b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass"))
                found.append([{"start": a, "length": n, "period": q} for a, n, q in runs])
            span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(found, span)], names=[*kept, out, spans])

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, schema)


_DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame) -> DataFrame:
    """Every row of docs with loops planted (see looped): its runs' count and digest, the longest run, and the digest of the collapsed text."""

    def row(doc_id: str | None, text: str | None) -> tuple:
        words = looped(words_of(text), doc_id)
        runs = repetitions(interned(words))
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        told = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        exponent = None if period is None else 1000 * length // period
        return len(runs), start, length, period, exponent, told, hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    def run(batches):
        for batch in batches:
            each = [row(i, t) for i, t in zip(values(batch.column(1)), values(batch.column(2)), strict=True)]
            columns = list(zip(*each, strict=True)) or [()] * 7
            arrays = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[c.split()[0] for c in _DIGESTS.split(", ")])

    own = F.col("doc_id")
    return docs.select(own.cast("long").alias("doc_id"), own.cast("string").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _DIGESTS)
