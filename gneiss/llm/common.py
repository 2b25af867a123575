"""What the training-data operators share: tables, scratch tables and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has no more rows of plain numbers than this.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where that is unset and Spark is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if at is None:
        at = sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="gneiss-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def scratch(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; its path is added to paths.

    This cuts the lineage: a lost executor costs a reread of finished files, never a second run of what made them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gneiss-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def values(column: pa.Array) -> Iterator:
    """The values of an Arrow column one at a time. Spark bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch); this keeps its texts from being held twice."""
    return (x.as_py() for x in column)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df, a scratch table of a few numbers a row, is counted and within the bound; otherwise leave the join to the planner's shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
