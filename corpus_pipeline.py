"""A corpus pipeline of five stages, each one operator over all that the stage before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() applies them in
order, each stage's result written to the shared folder and read again, so a lost executor never repeats a stage.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bpe, decontaminate, langid, linededup, neardup
from gneiss.llm.common import scratch, small, table
from gneiss.llm.queries import tokenizer

#: A text less like its nearest language's profile than this is no text in a learned language.
LEAST_LIKE = 0.25


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter, and those unlike every learned language.

    A null or empty text has no letter; repeated rows share a fate; no column of docs is changed or read but doc_id, text and
    lang; an empty table stays empty, and one without any labelled row loses all, since it has no language to be like.
    """
    judged = langid.annotate(docs, langid.fit(docs), "__lang_pred", "__score")
    return judged.filter((F.col("__lang_pred") != langid.UNDETERMINED) & (F.col("__score") >= LEAST_LIKE)).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated three-line windows; a document of which no word is left goes.

    Null texts, and rows with a null id, stay as they are; repeated rows are one document and stay alike; n_chars is counted
    again where lines went, if docs has it; other columns pass.
    """
    out = linededup.dedup_lines(docs)
    whole = F.col("__removed") == 0
    n = F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.filter(whole | F.col("text").rlike(r"\S")).select(*(n if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: that with the smallest id, once if its row is repeated.

    Null, blank and id-less documents are in no group and stay; texts under one id are told apart; other columns pass.
    """
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents that hold a benchmark item, as it is or with other numbers, names and units.

    Null and empty texts hold none; a document with a null id can't be named and stays; all rows of an id go if one of them
    holds an item; an empty benchmark removes nothing; other columns pass.
    """
    gone = scratch(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id")), "gone")
    return docs.join(small(gone), F.col("doc_id") == F.col("__id"), "left_anti").select(*_columns(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, *tokenizer())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express language profiles or byte-pair merges; tests/llm hold run() on a small table against a plain restatement of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return docs
