"""Row numbers at any size: within each key, or over all rows, without gathering a key's rows anywhere.

The rows are dealt out by ranges of (key, order) and sorted where they are, so a key that holds most rows is spread over many
tasks; a row's number is its place in its range plus the counts of the ranges before. Only those counts, one row for each
range and key, meet by key. The last sorting column tells rows apart that are equal in all others (see `tied`), since no
range can be cut within equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import scratch

#: The counts are broadcast only if they were measured to be within this many bytes.
BROADCAST_BYTES = 32 << 20

TIE = "__tie"


def tied(df: DataFrame) -> DataFrame:
    """df with a column that tells equal rows apart; to be stored before numbered() reads it."""
    return df.withColumn(TIE, F.monotonically_increasing_id())


def bounded(df: DataFrame, *keys: str) -> DataFrame:
    """Hint a broadcast of df, a stored table, if its rows and the bytes of its string keys are counted and within the bound."""
    rows, size = df.agg(F.count("*"), F.sum(sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0)))).first()
    return F.broadcast(df) if 64 * rows + (size or 0) <= BROADCAST_BYTES else df


def numbered(df: DataFrame, key: str, order: list[str], paths: list[str]) -> DataFrame:
    """df, a stored table made by tied(), with __at (from 0 within its key, by order, nulls first) and __of (rows of the key).

    Null keys are one key. Rows that are equal in key and order are numbered in any order. An empty table stays empty.
    """
    by = [key, *order, TIE]
    dealt = scratch(df.repartitionByRange(*by).sortWithinPartitions(*by).drop(TIE).withColumn("__id", F.monotonically_increasing_id()), "dealt", paths)
    dealt = dealt.withColumn("__part", F.shiftright("__id", 33))
    counts = dealt.groupBy("__part", F.col(key).alias("__key")).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy("__key")
    before = F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")
    starts = scratch(counts.select("__part", "__key", (before - F.col("__first")).alias("__add"), F.sum("__n").over(whole).alias("__of")), "starts", paths)
    starts = bounded(starts, "__key").withColumnRenamed("__part", "__in")
    both = dealt.join(starts, (F.col("__part") == F.col("__in")) & F.col(key).eqNullSafe(F.col("__key")))
    return both.withColumn("__at", F.col("__id") + F.col("__add")).drop("__part", "__in", "__key", "__add", "__id")
