"""Keeping an intermediate result that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """Folder for intermediate tables: the one the session names, or a temporary one when Spark runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    return tempfile.mkdtemp(prefix="isobar-") if spark.sparkContext.master.startswith("local") else None


def materialized(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Later steps read only the columns they need, and nothing is computed again when an executor is
    lost. Without a shared folder the rows stay in executors, with the lineage to compute them again.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df.persist()
    path = f"{folder.rstrip('/')}/isobar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
