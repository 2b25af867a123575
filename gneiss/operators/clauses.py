"""Regulations as segments: headings with inherited context, pages, and clauses matched to segments.

lines: doc, start, end (offsets), page, text. Context is carried by windows over one document, with resets: a chapter ends its section,
a clause its numbered group. Null texts are no headings; a document without headings is one segment; an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.source import clause_id

# What headings look like, and a line of a table of contents.
CHAPTER = r"(?i)^(Chapter\s+[IVXLC]+)\s+[–-]\s+(.+)$"
LETTER = r"^([A-Z])\.\s+(.+)$"
TOP = r"^(\d+)\.\s+(.*)"
SUB = r"^\(([A-Za-z]+|\d+)\)\s+(.*)"
CONTENTS = r"\.{4,}\s*\d+\s*$"

#: Words that carry nothing when clauses are compared, what is said for others, and suffixes.
EMPTY = "a an and are as at be by for from in is it of or shall the to with must may can should maximum minimum amendment lowered regulated registry rbi they have without within receiving carried".split()
ALIASES = {
    "begins": "start", "capitalisation": "capitalize", "capitalise": "capitalize", "capitalised": "capitalize", "capitalized": "capitalize", "ckycr": "central", "dispatching": "send", "emailing": "send",
    "entities": "bank", "entity": "bank", "firms": "firm", "getting": "get", "lodging": "lodge", "received": "receive", "receives": "receive", "redressal": "redress", "satisfactory": "satisfied",
    "sending": "send", "sent": "send", "starts": "start", "updation": "update", "updated": "update", "updating": "update",
}
ENDINGS = (("ization", "ize"), ("isation", "ize"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))
#: A clause is a segment's if so much of its words is in it.
LIKE = 0.8


def segments(lines: DataFrame) -> DataFrame:
    """doc, ord, kind (front or clause), clause_id, path, title, start, end, page_start, page_end."""
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("doc").orderBy("start")
    upto, prior = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    end = lines.groupBy("doc").agg(F.max("end").alias("doc_end"))
    c = lines.withColumn("text", text).filter(~F.col("text").rlike(CONTENTS))
    part = lambda p, i: F.regexp_extract("text", p, i)
    is_chapter = F.col("text").rlike(CHAPTER)
    c = c.withColumn("top", F.when(~is_chapter & F.col("text").rlike(TOP), clause_id(part(TOP, 1)))).withColumn("top_title", F.when(F.col("top").isNotNull(), F.coalesce(F.nullif(F.regexp_replace(F.trim(part(TOP, 2)), r":+$", ""), F.lit("")), F.lit("Clause"))))
    c = c.withColumn("chapter", F.when(is_chapter, F.concat(part(CHAPTER, 1), F.lit(" – "), F.trim(part(CHAPTER, 2)))))
    c = c.withColumn("above", F.last("top", True).over(upto)).withColumn("above_title", F.last("top_title", True).over(upto))
    letter = ~is_chapter & F.col("text").rlike(LETTER) & F.last("top", True).over(prior).isNotNull()
    c = c.withColumn("letter", F.when(letter, F.concat(part(LETTER, 1), F.lit(". "), F.trim(part(LETTER, 2)))))
    sub = ~is_chapter & F.col("text").rlike(SUB) & F.col("above").isNotNull() & ~F.lower(part(SUB, 2)).startswith("of ")
    c = c.withColumn("sub", F.when(sub, F.lower(part(SUB, 1))))
    c = c.withColumn("chapters", F.count("chapter").over(upto)).withColumn("tops", F.count("top").over(upto))
    in_chapter = Window.partitionBy("doc", "chapters").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    in_top = Window.partitionBy("doc", "tops").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("in_chapter", F.last("chapter", True).over(upto)).withColumn("section", F.last("letter", True).over(in_chapter))
    c = c.withColumn("numbered", F.last(F.when(F.col("sub").rlike(r"^\d+$"), F.col("sub")), True).over(in_top))
    digits = F.col("sub").rlike(r"^\d+$")
    deep = F.when(F.col("sub").isNotNull(), F.when(digits | F.col("numbered").isNull(), F.array(F.concat(F.lit("("), "sub", F.lit(")")))).otherwise(F.array(F.concat(F.lit("("), "numbered", F.lit(")")), F.concat(F.lit("("), "sub", F.lit(")")))))
    c = c.withColumn("deep", deep).withColumn("clause_id", F.when(F.col("top").isNotNull(), F.col("top")).when(F.col("sub").isNotNull(), F.concat("above", F.array_join("deep", ""))))
    heading = F.when(F.col("clause_id").isNotNull(), F.concat("above", F.lit(". "), F.coalesce("above_title", F.lit(""))))
    path = F.when(F.col("chapter").isNotNull(), F.array("chapter")).otherwise(F.concat(F.filter(F.array("in_chapter", "section", heading), lambda x: x.isNotNull()), F.coalesce("deep", F.expr("cast(array() as array<string>)"))))
    c = c.withColumn("path", path).withColumn("starts", F.col("chapter").isNotNull() | F.col("letter").isNotNull() | F.col("clause_id").isNotNull()).withColumn("k", F.row_number().over(order))
    any_ = c.groupBy("doc").agg(F.max("starts").alias("any"))
    c = c.join(any_, "doc").filter("starts or k = 1")
    c = c.withColumn("path", F.when(F.col("starts"), F.col("path")).otherwise(F.array(F.when(F.col("any"), "Front matter").otherwise("Document"))))
    c = c.join(end, "doc").withColumn("stop", F.coalesce(F.lead("start").over(order), "doc_end")).filter("stop > start")
    ends = page_of(c.select("doc", F.col("stop").alias("offset")).distinct(), lines)
    out = c.join(ends, (c["doc"] == ends["doc"]) & (F.col("stop") == F.col("offset"))).select(c["doc"], F.when(F.col("clause_id").isNotNull(), "clause").otherwise("front").alias("kind"), "clause_id", "path", F.element_at("path", -1).alias("title"), "start", F.col("stop").alias("end"), c["page"].alias("page_start"), ends["page"].alias("page_end"))
    return out.withColumn("ord", F.row_number().over(order))


def page_of(offsets: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, offset, page): the page of the last line that begins before an offset, else of the first line."""
    both = lines.select("doc", F.col("start").alias("at"), F.lit(1).alias("line"), "page").unionByName(offsets.select("doc", F.col("offset").alias("at"), F.lit(0).alias("line"), F.lit(None).cast(lines.schema["page"].dataType).alias("page")))
    w = Window.partitionBy("doc").orderBy("at", "line")  # an offset comes before a line that begins there
    whole = Window.partitionBy("doc").orderBy("at", "line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.coalesce(F.last("page", True).over(w), F.first("page", True).over(whole))
    return both.withColumn("page", last).filter("line = 0").select("doc", F.col("at").alias("offset"), "page")


def content_words(text: Column) -> Column:
    """The distinct words of a text that say something, in one form each."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(EMPTY) & ~w.rlike(r"^20\d{2}$"))
    said = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))

    def plain(w: Column) -> Column:
        cut = reduce(lambda e, s: F.when(w.endswith(s[0]) & (F.length(w) > len(s[0]) + 3), F.concat(F.substring(w, F.lit(1), F.length(w) - len(s[0])), F.lit(s[1]))).otherwise(e), reversed(ENDINGS), w)
        return F.coalesce(F.element_at(said, w), cut)

    return F.array_distinct(F.transform(words, plain))


def overlap(needle: Column, hay: Column) -> Column:
    """The share of needle's content words that hay has; 1 for none."""
    a, b = content_words(needle), content_words(hay)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def reconciled(chunks: DataFrame, clauses: DataFrame) -> DataFrame:
    """chunks (doc, chunk_id, clause_id, text, start) with the clause ids that the vocabulary (ord, doc, clause_id, text) has and they lack.

    In the vocabulary's order, a clause that no segment of its document is named for takes the one that holds most of its words, LIKE of them
    at least, ties to the shortest and then the first; a segment that was taken has that name from then on. Candidates come from
    a join by document and word; taking turns is one document's work.
    """
    new = clauses.join(chunks.filter("clause_id is not null").select("doc", "clause_id").distinct(), ["doc", "clause_id"], "left_anti")
    words = lambda df, *keep: df.select("doc", *keep, F.explode(content_words(F.col("text"))).alias("w"))
    need = words(new, F.col("ord"), F.col("clause_id").alias("wanted"))
    m = need.groupBy("doc", "ord", "wanted").agg(F.count("*").alias("m"))
    shared = need.join(words(chunks, F.col("chunk_id")), ["doc", "w"]).groupBy("doc", "ord", "wanted", "chunk_id").agg(F.count("*").alias("c"))
    close = shared.join(m, ["doc", "ord", "wanted"]).withColumn("like", F.col("c") / F.col("m")).filter(F.col("like") >= LIKE)
    close = close.join(chunks.select("doc", "chunk_id", F.length("text").alias("size"), "start"), ["doc", "chunk_id"])

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        out, known = {}, set()
        for (_, wanted), own in rows.groupby(["ord", "wanted"], sort=True):
            if wanted in known:
                continue
            best = own.assign(far=-own["like"]).sort_values(["far", "size", "start"]).iloc[0]
            known.add(wanted)
            out[best["chunk_id"]] = (best["doc"], best["chunk_id"], wanted)
        return pd.DataFrame(list(out.values()), columns=["doc", "chunk_id", "taken"])

    taken = close.groupBy("doc").applyInPandas(take, "doc string, chunk_id string, taken string")
    return chunks.join(taken, ["doc", "chunk_id"], "left").withColumn("clause_id", F.coalesce("taken", "clause_id")).drop("taken")
