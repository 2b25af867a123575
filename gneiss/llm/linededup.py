"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text (split at \\n) form a window, identified by 128 bits of hash. A window that is
not blank and occurs more than once anywhere keeps its first occurrence, by document id and then by line; the lines
that any later occurrence covers are removed, overlapping occurrences merging into one stretch.

A window's occurrences are counted and their first found by partial aggregation, so a window in a third of all
documents is reduced where it is read; the join back has one row for each window on its other side, and the planner
splits its large partitions. Only windows, never texts, move in those steps; a document meets its own removed lines
only, whose number its own length bounds. The documents with removed lines grow with the corpus, so they are never
broadcast: texts move once, by document, at every size alike.

Nulls, empty and repeated rows: null texts, and texts of fewer than three lines, are unchanged; rows with a null id
have no order and are unchanged, and their windows don't count; rows with the same id and text are one document, and
rows with the same id and different texts are told apart by a hash of the text; of equal windows in one document the
first is kept; an empty table gives an empty table; other columns pass through, and the operator's own names are
prefixed so that they don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import scratch

LINES = 3


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _hash_of(text: str = "text") -> Column:
    return F.xxhash64(F.lit("row"), F.col(text))


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row_hash, at (from 0), high and low (the hash) of every window that isn't blank."""
    lines = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", _hash_of(text).alias("row_hash"), _lines(text).alias("lines")).filter(F.size("lines") >= LINES)
    one = lambda i: F.slice("lines", i + 1, LINES)
    made = F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), lambda i: F.struct(F.xxhash64(one(i)).alias("high"), F.xxhash64(F.lit("second"), one(i)).alias("low"), F.exists(one(i), lambda x: F.trim(x) != "").alias("said")))
    return lines.select("doc_id", "row_hash", F.posexplode_outer(made).alias("at", "w")).filter("w.said").select("doc_id", "row_hash", "at", "w.high", "w.low")


def later_occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row_hash and at of every window that occurs earlier, too."""
    found = windows(docs, text)
    repeated = found.groupBy("high", "low").agg(F.min(F.struct("doc_id", "row_hash", "at")).alias("first"), F.max(F.struct("doc_id", "row_hash", "at")).alias("last")).filter("first <> last").select("high", "low", "first")
    return found.join(repeated, ["high", "low"]).filter(F.struct("doc_id", "row_hash", "at") != F.col("first")).select("doc_id", "row_hash", "at").distinct()


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with text left without the repeated lines, and two more columns: __lines and __removed."""
    covered = scratch(later_occurrences(docs, text).groupBy("doc_id", "row_hash").agg(F.collect_list("at").alias("__at")), "covered")
    # the text moves as its lines, so that each line can be looked up by its number
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    split = docs.select(*others, F.col("doc_id").alias("__id"), _hash_of(text).alias("__hash"), _lines(text).alias("__text"))
    joined = split.join(covered.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), "__at").hint("merge"), ["__id", "__hash"], "left")
    out = F.array_distinct(F.flatten(F.transform("__at", lambda i: F.sequence(i, i + LINES - 1))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__text") - 1), out), lambda i: F.get("__text", i))
    n = F.when(F.col("__text").isNull(), 0).otherwise(F.size("__text"))
    new = F.array_join(F.when(F.col("__at").isNull(), F.col("__text")).otherwise(kept), "\n")
    columns = [F.col(f"`{c}`") if c != text else new.alias(text) for c in docs.columns]
    return joined.select(*columns, n.cast("long").alias("__lines"), F.when(F.col("__at").isNull(), 0).otherwise(F.size(out)).cast("long").alias("__removed"))
