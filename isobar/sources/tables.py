"""Readers and writers of landed tables. Schemas are given, never inferred; NaN becomes null on read."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.functions.physics import missing_as_null
from isobar.operators.align import recent, time_range

LOCATIONS = "location_id string, lat double, lon double"
REANALYSIS_GRID = (
    "valid_time timestamp_ntz, latitude double, longitude double, t2m double, d2m double, sp double, tcc double, "
    "u10 double, v10 double, rh double"
)
PRECIP_GRID = "ts timestamp_ntz, lat double, lon double, precipitationCal double"
STATIONS = (
    "station_id string, name string, country string, region string, latitude double, longitude double, elevation double"
)
STATION_OBS = (
    "station_id string, ts timestamp_ntz, temp double, dwpt double, rhum double, prcp double, snow double, wdir double, "
    "wspd double, wpgt double, pres double, tsun double, coco int"
)
PAYLOAD = (
    "current struct<temp:double,humidity:double,clouds:double,rain:map<string,double>>, "
    "hourly array<struct<dt:bigint,pop:double,rain:map<string,double>>>"
)
PROVIDER_HOURS = 24


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return missing_as_null(spark.read.schema(schema).parquet(path))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return missing_as_null(spark.read.schema(schema).option("header", True).csv(path))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, LOCATIONS)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, STATIONS)


def read_station_obs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = {"parquet": read_parquet, "csv": read_csv}[fmt]
    return reader(spark, path, STATION_OBS)


def read_reanalysis_grid(spark: SparkSession, path: str, schema: str = REANALYSIS_GRID) -> DataFrame:
    return read_parquet(spark, path, schema)


def read_precip_grid(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, PRECIP_GRID)


def read_postal_csv(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 file with a header; every column stays text so that leading zeros survive.

    ``row_seq`` follows the order of files by path, and of rows in a file, however Spark packs and cuts the files: a row's
    file and block come from the scan, and inside a block ids ascend.
    """
    df = spark.read.option("encoding", "ISO-8859-1").option("header", True).csv(path)
    return df.withColumn("row_seq", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def parse_payloads(df: DataFrame, text: str = "payload") -> DataFrame:
    """Provider JSON text to the ``current`` struct and the first 24 ``hourly`` elements."""
    parsed = F.from_json(F.col(text), PAYLOAD)
    return (
        df.withColumn("_p", parsed)
        .withColumns({"current": F.col("_p.current"), "hourly": F.slice("_p.hourly", 1, PROVIDER_HOURS)})
        .drop("_p", text)
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, with the location it belongs to."""
    df = spark.read.schema(f"location_id string, {PAYLOAD}").json(path)
    return df.withColumn("hourly", F.slice("hourly", 1, PROVIDER_HOURS))


def read_range(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    return time_range(df, start, end, ts)


def read_last(df: DataFrame, reference: Column, hours: float = 24, days: float = 0, ts: str = "ts") -> DataFrame:
    """Rows of the last hours (and days) up to a reference time."""
    return recent(df, reference, hours + 24 * days, ts=ts)


def write_series(df: DataFrame, path: str, source: str, start: str, buckets: int = 64) -> None:
    """Keep a collected series of many locations; a later write replaces the locations it holds.

    Each write is a save of its own: rows by month and by hash of the location, so the number of files follows months and
    buckets, not locations, and adaptive execution splits a crowded bucket. The save's list of locations is written after
    its rows, and its ``_SUCCESS`` file commits the save: what a lost writer leaves behind is never read.
    """
    save = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows, places = (f"{path}/{part}/{_saves(source, start)}/save={save}" for part in ("rows", "places"))
    out = df.withColumns({"month": F.date_format("ts", "yyyy-MM"), "bucket": _bucket(F.col("location_id"), buckets)})
    out.hint("rebalance", F.col("month"), F.col("bucket")).write.partitionBy("month", "bucket").parquet(rows)
    held = df.sparkSession.read.schema("location_id string").parquet(rows).distinct()
    held.withColumn("buckets", F.lit(buckets)).write.parquet(places)


def read_series(spark: SparkSession, path: str, schema: str, source: str, start: str,
                locations: Sequence[str] | None = None, months: tuple[str, str] | None = None) -> DataFrame:
    """Kept series of a source, each location from the newest save that holds it; no rows when nothing was kept.

    ``locations`` and the first and last of ``months`` (as ``2024-01``) leave out whole buckets and months before any file is read.
    """
    fields = T.StructType.fromDDL(schema).fields
    shown = [f.name for f in fields] + ["source", "start", "location_id"]
    keyed = T.StructType([*fields, *T.StructType.fromDDL("location_id string, month string, bucket int, save string").fields])
    under = _saves(source, start)
    saves = _committed(spark, f"{path}/places/{under}")
    if not saves:
        return _labelled(spark.createDataFrame([], keyed), source, start).select(*shown)

    def part(name: str, schema_: T.StructType | str) -> DataFrame:
        found = [f"{path}/{name}/{under}/{save}" for save in saves]
        return spark.read.schema(schema_).option("basePath", f"{path}/{name}/{under}").parquet(*found)

    kept, places = part("rows", keyed), part("places", "location_id string, buckets int, save string")
    if locations is not None:
        sizes = [r.buckets for r in places.select("buckets").distinct().collect()]
        wanted = [_bucket(F.lit(x), n) for x in locations for n in sizes]
        kept = kept.filter(F.col("bucket").isin(wanted) & F.col("location_id").isin(list(locations)))
    if months is not None:
        kept = kept.filter(F.col("month").between(*months))
    if len(saves) > 1:
        kept = kept.join(places.groupBy("location_id").agg(F.max("save").alias("save")), ["location_id", "save"], "left_semi")
    return _labelled(kept, source, start).select(*shown)


def _saves(source: str, start: str) -> str:
    return f"source={quote(source, safe='')}/start={quote(start, safe='')}"


def _bucket(location: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(location), F.lit(buckets)).cast("int")


def _labelled(df: DataFrame, source: str, start: str) -> DataFrame:
    return df.withColumns({"source": F.lit(source), "start": F.lit(start)})


def _committed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the saves whose list of locations is complete, oldest first."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/save=*/_SUCCESS")
    found = marker.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marker)
    return sorted(f.getPath().getParent().getName() for f in found or [])


def write_locations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_dataset_info(spark: SparkSession, path: str, features: Sequence[str], targets: Sequence[str],
                       input_steps: int, output_steps: int, stats: DataFrame) -> None:
    """Keep what a later forecast needs: column lists, window lengths and scaler statistics."""
    columns = [("feature", i, c) for i, c in enumerate(features)] + [("target", i, c) for i, c in enumerate(targets)]
    steps = [("input_steps", input_steps, ""), ("output_steps", output_steps, "")]
    spark.createDataFrame(columns + steps, "kind string, position int, name string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/columns")
    stats.write.mode("overwrite").parquet(f"{path}/scaler")


def read_dataset_info(spark: SparkSession, path: str) -> dict:
    """What ``write_dataset_info`` kept; the lists are as long as the number of columns."""
    rows = spark.read.parquet(f"{path}/columns").orderBy("kind", "position").collect()
    return {
        "features": [r.name for r in rows if r.kind == "feature"],
        "targets": [r.name for r in rows if r.kind == "target"],
        "input_steps": next(r.position for r in rows if r.kind == "input_steps"),
        "output_steps": next(r.position for r in rows if r.kind == "output_steps"),
        "stats": spark.read.parquet(f"{path}/scaler"),
    }


def write_feature_list(spark: SparkSession, path: str, names: Sequence[str]) -> None:
    """One name per line, in order."""
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode("overwrite").text(path)
