"""Helpers shared by the training-data operators: registers, words, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def query(sql: str | None = None):
    """Register a function under its name, with the equivalent SQL if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column, separators: str = SPACES) -> Column:
    """Array of words between separators; empty for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), separators), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def written(df: DataFrame) -> DataFrame:
    """Write rows as Parquet in the shared folder that the session names, and go on from there.

    Only a local session without that setting gets a temporary folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def given_back(batches):
    """The batches; what Arrow holds beyond them goes back to the system after each, so that a reused worker stays small."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema with more columns at the end."""
    return T.StructType(schema.fields + T.StructType.fromDDL(ddl).fields)
