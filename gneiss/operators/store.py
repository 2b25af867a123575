"""Tables in the folder that the cluster shares, which cut lineage: a lost executor costs a reread of finished files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and Spark is local, as in tests."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="gneiss-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/gneiss-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
