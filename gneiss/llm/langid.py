"""Language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent 1- to 3-grams, in order of frequency. A text is compared with
every profile by out-of-place distance: the sum, over the text's own most frequent n-grams, of how far apart the two
ranks are, with the profile's length as the penalty for an n-gram that the profile lacks. The nearest profile wins.

Profiles are fitted on the different texts among at most about FIT_ROWS labelled rows a language, drawn by a hash of id and text (a documented
bound); counts are summed in Spark and only PROFILE ranked n-grams a language reach the driver. Every language with a labelled row
is learned, as a table of (n-gram, language, rank) of 16 bytes a row; beyond MOST_LANGS, which would take
half a GB, an error is raised, and nothing is left out in silence. Prediction covers every whole text, without a shuffle, so no key can be hot.

Nulls, empty and repeated rows: a null text, or one without a letter, is `und` with score 0; a null language is never
learned from; a null id hashes as the empty string; rows are independent, so repeats and ties between rows have no
effect; ties between n-grams go to the smaller code, ties between languages to the smaller name; an empty table, or
one without a labelled row, predicts `und` for all; other columns pass through and a clashing one is replaced.
"""

from __future__ import annotations

import functools
import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import scratch, values

#: n-grams in a profile.
PROFILE = 400
#: Labelled rows that are learned from, a language, in expectation.
FIT_ROWS = 2_000
#: Languages beyond which learning is refused.
MOST_LANGS = 100_000
#: Characters that are counted at a time.
BLOCK = 1 << 20

UNDETERMINED = "und"
_BREAK = re.compile(r"[\W\d_]")


@functools.cache
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _count(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    letter = _letters()[raw]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # one space before each word
    keep[np.flatnonzero(letter)[-1] + 1] = True  # and one after the last
    a = np.where(letter, raw, 32)[keep].astype(np.uint64)
    b, s = np.uint64(21), np.uint64(32)
    two = (a[:-1] << b) | a[1:]
    three = (two[:-1] << b) | a[2:]
    return np.unique(np.concatenate([a[a != s], two, three[a[1:-1] != s]]), return_counts=True)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and counts of the 1- to 3-grams of the words of a whole text; a code holds 21 bits a character."""
    if len(text) <= BLOCK:
        return _count(text)
    parts, start = [], 0
    while start < len(text):  # blocks end between words
        gap = _BREAK.search(text, min(start + BLOCK, len(text)))
        end = gap.end() if gap else len(text)
        parts.append(_count(text[start:end]))
        start = end
    return summed(parts)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes in order of frequency; ties go to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Model:
    """langs, the sorted codes of all profiles, and from first[i] to first[i + 1] the languages that have code i, with its rank there."""

    langs: tuple[str, ...]
    codes: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    rank: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text or "")
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        own = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        there = np.flatnonzero(self.codes[at] == own)
        begin, n = self.first[at[there]], self.first[at[there] + 1] - self.first[at[there]]
        # the places of all (language, rank) of the n-grams that any profile has, and the n-gram of each
        gram = np.repeat(there, n)
        place = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
        nearer = self.size - np.abs(self.rank[place] - gram)
        far = self.size * len(own) - np.bincount(self.lang[place], nearer, len(self.langs))
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def model_of(profiles: dict[str, list[int]], size: int = PROFILE) -> Model:
    langs = tuple(sorted(profiles))
    code = np.array([c for x in langs for c in profiles[x]], np.uint64)
    lang = np.array([i for i, x in enumerate(langs) for _ in profiles[x]], np.int32)
    rank = np.array([i for x in langs for i in range(len(profiles[x]))], np.int32)
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    return Model(langs, codes, np.append(first, len(code)), lang[order], rank[order], size)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, rows: int = FIT_ROWS, size: int = PROFILE) -> Model:
    """Learn profiles from text and lang of the rows of docs that aren't held out."""
    labelled = docs.filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = scratch(labelled.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    n = counts.count()
    if n > MOST_LANGS:
        raise ValueError(f"{n} languages; lang has to be a language's name")
    if not n:
        return model_of({}, size)
    draw = F.pmod(F.xxhash64(F.lit("profile"), F.col("doc_id").cast("string"), F.xxhash64("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.select("lang", "text", draw.alias("draw")).join(F.broadcast(counts), "lang").filter(F.col("draw") * F.col("rows") < rows)
    drawn = drawn.groupBy("lang", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text")).select("lang", "text")

    def count(batches):
        total: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(values(batch.column(0)), values(batch.column(1)), strict=True):
                own = total.setdefault(lang, [])
                own.append(ngrams(text))
                if len(own) == 256:
                    total[lang] = [summed(own)]
        for lang, own in total.items():
            codes, counts = summed(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], names=["lang", "code", "n"])

    counts = drawn.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return model_of(profiles, size)


def annotate(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the two columns pred and score; only the text is looked at."""
    names = [f.name for f in docs.schema.fields if f.name.lower() not in (pred.lower(), score.lower())]
    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        for batch in batches:
            out = [model.predict(t) for t in values(batch.column("text"))]
            columns = [*(batch.column(n) for n in names), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text."""
    return annotate(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
