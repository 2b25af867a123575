"""Quality rules: a learned decision list over text statistics.

Sequential covering learns which texts are poor from labelled statistics: a rule is a conjunction of thresholds that is
grown greedily by information gain on two thirds of the rows, then pruned on the other third, and kept if it is precise
enough there; the rows it covers are set aside and the next rule is learned. The list becomes one ordered conditional
expression in Spark, after the fixed base rules.

Statistics cover every whole text. Rules are fitted on at most about FIT_ROWS labelled rows, drawn by a hash of the id
(a documented bound); only their statistics, a few numbers a row, reach the driver.

Nulls, empty and repeated rows: a null text has no words and fails the base rules; labels without an id or a quality
are ignored, and a document labelled twice counts as poor if any label says so; rows are independent, so repeated rows
and ties have no effect; without labels the list is empty and the base rules alone decide; an empty table gives an
empty table; only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import scratch, small, values

#: Labelled rows that are learned from, in expectation.
FIT_ROWS = 20_000
#: Thresholds tried for a feature at a time; conditions in a rule; rules.
CUTS, LONGEST, RULES = 48, 4, 12
#: A rule's least precision and cover on the rows that it is pruned on.
PRECISE, COVER = 0.9, 4

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_digits", "n_distinct", "n_lines")
FEATURES = ("words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "distinct_rate")

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """How many words stand in a 3-word window that occurs twice or more, and how many words are distinct."""
    number: defaultdict = defaultdict(itertools.count().__next__)
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    n = len(number)
    if len(codes) < 4:
        return 0, n
    if n < 1 << 21:  # three codes in 63 bits
        window = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    else:
        pair = np.unique(codes[:-1] * n + codes[1:], return_inverse=True)[1]
        window = pair[:-1] * n + codes[2:]
    order = np.argsort(window, kind="stable")
    ranked = window[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return 0, n
    covered = np.zeros(len(codes), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum()), n


def statistics(text: bytes | None) -> tuple[int, ...]:
    """BASE and MORE of a whole text in UTF-8; words stand between ASCII white space."""
    text = text or b""
    words = text.split()
    packed = text.translate(None, _SPACE)
    word_chars = len(packed) - int((np.frombuffer(packed, np.uint8) & 0xC0 == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeat, distinct = repeated_words(words)
    out = lambda drop: len(text) - len(text.translate(None, drop))
    return len(words), word_chars, out(SYMBOLS), len(lines) - len(set(lines)), repeat, out(_UPPER), out(_DIGIT), distinct, len(lines)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    names = (*BASE, *MORE)

    def run(batches):
        for batch in batches:
            rows = [statistics(t) for t in values(batch.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def features() -> dict[str, Column]:
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"),
        "digit_rate": rate("n_digits", "word_chars"),
        "distinct_rate": rate("n_distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """All (feature, sign, threshold) hold: sign 1 is >=, -1 is <=."""

    conditions: tuple[tuple[str, int, float], ...]
    covered: int
    precision: float

    def column(self, of: dict[str, Column]) -> Column:
        return reduce(Column.__and__, (of[f] >= t if s > 0 else of[f] <= t for f, s, t in self.conditions))

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if s > 0 else '<='} {t:g}" for f, s, t in self.conditions)


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    return reduce(np.logical_and, ((x[:, i] >= t if s > 0 else x[:, i] <= t) for i, s, t in conditions), np.ones(len(x), bool))


def _grow(x: np.ndarray, poor: np.ndarray) -> list[tuple[int, int, float]]:
    rule: list[tuple[int, int, float]] = []
    inside = np.ones(len(x), bool)
    while len(rule) < LONGEST and poor[inside].any() and not poor[inside].all():
        p, n = poor[inside].sum(), (~poor[inside]).sum()
        best = (1e-9, None)
        for i in range(x.shape[1]):
            values = x[inside, i]
            for t in np.unique(np.quantile(values, np.linspace(0, 1, CUTS), method="nearest")):
                for s in (1, -1):
                    hit = values >= t if s > 0 else values <= t
                    a, b = (hit & poor[inside]).sum(), (hit & ~poor[inside]).sum()
                    if a and (gain := a * (np.log2(a / (a + b)) - np.log2(p / (p + n)))) > best[0] + 1e-12:
                        best = (gain, (i, s, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _holds(x, rule)
    return rule


def learn(x: np.ndarray, poor: np.ndarray) -> list[Rule]:
    """An ordered list of rules for rows that are poor. Every third row prunes."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    prune = np.arange(len(x)) % 3 == 2
    while len(rules) < RULES and (poor & left & ~prune).sum() >= COVER:
        rule = _grow(x[left & ~prune], poor[left & ~prune])
        if not rule:
            break
        held, truth = x[left & prune], poor[left & prune]

        def worth(conditions, held=held, truth=truth):
            hit = _holds(held, conditions)
            return (truth[hit].sum() + 1) / (hit.sum() + 2) if conditions else 0.0

        kept = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = _holds(held, kept)
        precision = truth[hit].mean() if hit.any() else 0.0
        if hit.sum() < COVER or precision < PRECISE:
            break
        rules.append(Rule(tuple((FEATURES[i], s, t) for i, s, t in kept), int(hit.sum()), float(precision)))
        left &= ~_holds(x, kept)
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from the statistics of labelled documents that pass the base rules."""
    asked = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    n = labels.filter("doc_id is not null and quality is not null").count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = scratch(asked.filter(draw < min(1.0, rows / n)), "drawn")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(drawn.select("doc_id")), "doc_id")
    # rows of one id count once, with the least statistics, so that repeats can't break the bound
    once = with_statistics(chosen).groupBy("doc_id").agg(F.min(F.struct(*BASE, *MORE)).alias("s")).select("doc_id", "s.*")
    made = once.filter(~base_failed()).join(drawn, "doc_id").select("doc_id", "quality", *(c.alias(n) for n, c in features().items()))
    found = sorted(made.collect(), key=lambda r: (hash(r["doc_id"] * 0x9E3779B1 % (1 << 32)), tuple(r)))
    if not found:
        return []
    return learn(np.array([[r[f] for f in FEATURES] for r in found]), np.array([r["quality"] == 0 for r in found]))


def verdict(rules: list[Rule]) -> Column:
    """kept, as one ordered conditional expression: the base rules, then each learned rule."""
    of = features()
    return reduce(lambda e, r: e.when(r.column(of), F.lit(False)), rules, F.when(base_failed(), F.lit(False))).otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every whole text."""
    return with_statistics(docs).select("doc_id", *BASE, base_failed().alias("base_failed"), verdict(fit(docs, labels)).alias("kept"))
