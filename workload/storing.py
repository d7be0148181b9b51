"""Readers and sinks: derived tables are written to the shared folder, read back, and compared with SQL over their origin."""

from __future__ import annotations

import uuid

from isobar.operators import locations, scaling, series
from isobar.plans.stage import shared_folder
from isobar.sources import tables
from pyspark.sql import functions as F
from workload.alignment import GAPPY, gappy
from workload.base import digits, merged_cells, query, single, sql_digits, sql_merged, sql_place, sql_single, table
from workload.collecting import FIELD, GRID, SATELLITE, field
from workload.datasets import sql_stats
from workload.places import OBS, SQL_CLEAN, places, raw_codes


def new_folder(spark) -> str:
    """A folder of this run's own, where every executor can write."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return f"{folder.rstrip('/')}/isobar-{uuid.uuid4().hex}"


# Code table: rows in order of key over files of very different sizes, so that Spark packs the files in another order.
CITY = "concat('Juárez ', c_name)"


def landed_codes(spark, sf) -> str:
    path = new_folder(spark)
    codes = raw_codes(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("row_seq"), F.expr(CITY).alias("ciudad")), "row_seq")
    part = F.expr("cast(sqrt(row_seq) / 4 as int)")
    placed = codes.withColumn("_part", part).repartitionByRange(16, "_part").sortWithinPartitions("row_seq")
    placed.drop("_part", "row_seq").write.option("encoding", "ISO-8859-1").option("header", True).csv(path)
    return path


@query(f"""SELECT {CITY} AS ciudad, CAST(c_custkey % 700 * 97 AS VARCHAR) AS d_cp, row_number() OVER (ORDER BY c_custkey) AS place FROM customer""")
def postal_csv_rows(spark, sf):
    """Text columns of many Latin-1 files, numbered by ``row_seq`` through counts per file and block."""
    raw = tables.read_postal_csv(spark, landed_codes(spark, sf)).withColumn("_all", F.lit(1))
    bucket = F.struct("row_seq.file", "row_seq.block")
    numbered = series.row_positions(raw, ["_all"], [F.col("row_seq")], bucket, "place")
    return numbered.select("ciudad", "d_cp", (F.col("place") + 1).alias("place"))


@query(f"WITH {SQL_CLEAN} SELECT location_id, lat, lon FROM clean")
def postal_csv_clean(spark, sf):
    """Of several entries of a code the last one counts, over all files."""
    return locations.clean_locations(tables.read_postal_csv(spark, landed_codes(spark, sf))).select("location_id", "lat", "lon")


def with_nan(df, column, when):
    """Landed files hold NaN where a value is missing."""
    return df.withColumn(column, F.when(F.expr(when), F.lit(float("nan"))).otherwise(F.col(column)))


SQL_FIELD = f"""{sql_merged(60, 'user_id')}, fields AS (
  SELECT latitude, longitude, ts, {', '.join(f'{e} AS {n}' for n, e in {**GRID, **SATELLITE}.items())} FROM (
  SELECT {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in FIELD.items())}, ts, max(v) AS v, max(k) AS k
  FROM (SELECT *, CAST(location_id AS BIGINT) AS u FROM merged) GROUP BY 1, 2, 3))"""
DRY, CLEAR = "precipitationCal < 0", "tcc < 0.2"


@query(f"""WITH {SQL_FIELD} SELECT ts AS valid_time, latitude, longitude, CASE WHEN NOT {CLEAR} THEN {sql_single('tcc')} END AS tcc, CAST(NULL AS DOUBLE) AS rh,
{', '.join(f'{sql_single(n)} AS {n}' for n in GRID if n != 'tcc')} FROM fields""")
def stored_reanalysis(spark, sf):
    path = new_folder(spark)
    with_nan(field(spark, sf, GRID, "valid_time"), "tcc", CLEAR).write.parquet(path)
    back = tables.read_reanalysis_grid(spark, path)
    return back.select("valid_time", "latitude", "longitude", "rh", *[single(c).alias(c) for c in GRID])


@query(f"""WITH {SQL_FIELD} SELECT ts, latitude AS lat, longitude AS lon, CASE WHEN NOT {DRY} THEN {sql_single('precipitationCal')} END AS "precipitationCal" FROM fields""")
def stored_precipitation(spark, sf):
    path = new_folder(spark)
    rain = with_nan(field(spark, sf, SATELLITE, "ts"), "precipitationCal", DRY)
    rain.withColumnsRenamed({"latitude": "lat", "longitude": "lon"}).write.parquet(path)
    return tables.read_precip_grid(spark, path).select("ts", "lat", "lon", single("precipitationCal").alias("precipitationCal"))


SHOWN = ["temp", "rhum", "prcp", "wspd", "pres"]


@query(f"""WITH {sql_merged(60, 'user_id')} SELECT kind, location_id AS station_id, ts, CAST(NULL AS INTEGER) AS coco, {', '.join(f'{sql_single(OBS[c])} AS {c}' for c in SHOWN)}
FROM merged, (VALUES ('csv'), ('parquet')) f(kind)""")
def stored_observations(spark, sf):
    """Station observations, kept as text and as Parquet; the readers give the same rows."""
    rows = merged_cells(spark, sf, 60, "user_id").selectExpr("location_id AS station_id", "ts", *[f"{OBS[c]} AS {c}" for c in SHOWN])
    names = [f.split()[0] for f in tables.STATION_OBS.split(", ")]
    whole = rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast("int" if n == "coco" else "double").alias(n) for n in names])
    path = new_folder(spark)
    whole.write.option("header", True).csv(f"{path}/csv")
    rows.write.parquet(f"{path}/parquet")
    parts = [tables.read_station_obs(spark, f"{path}/{k}", k).select(F.lit(k).alias("kind"), "station_id", "ts", "coco", *[single(c).alias(c) for c in SHOWN])
             for k in ("csv", "parquet")]
    return parts[0].unionByName(parts[1])


@query(f"""SELECT station_id, latitude, longitude, name, elevation FROM (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, lat AS latitude, lon AS longitude, s_name AS name,
CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS elevation FROM (SELECT *, {sql_place('s_suppkey')} FROM supplier))""")
def stored_stations(spark, sf):
    path = new_folder(spark)
    more = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("station_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("elevation"))
    rows = places(spark, sf, "supplier", "s_suppkey", "station_id").withColumnsRenamed({"lat": "latitude", "lon": "longitude"}).join(more, "station_id")
    with_nan(rows, "elevation", "elevation < 0").write.parquet(path)
    return tables.read_stations(spark, path).select("station_id", "latitude", "longitude", "name", "elevation")


# Kept series: a first save of all users, a second one that replaces every third user, one of another source, and one that was never committed.
KEPT = "ts timestamp_ntz, v double, k double"
AGAIN = "CAST(location_id AS BIGINT) % 3 = 0"


def kept(spark, sf) -> str:
    path = new_folder(spark)
    rows = merged_cells(spark, sf, 60, "user_id")
    tables.write_series(rows, path, "stations", "2024-01-01", buckets=4)
    tables.write_series(rows.filter(AGAIN).withColumn("v", F.col("v") + 1).filter("hour(ts) < 12"), path, "stations", "2024-01-01", buckets=2)
    tables.write_series(rows.filter("k > 50"), path, "re/analysis", "2024-01-01", buckets=4)
    rows.withColumns({"month": F.lit("2024-01"), "bucket": F.lit(0)}).write.partitionBy("month", "bucket").parquet(
        f"{path}/rows/source=stations/start=2024-01-01/save=99999999999999999999-lost")
    return path


# A user without a row before noon is not in the second save and keeps the first one.
SQL_KEPT = f"""{sql_merged(60, 'user_id')}, later AS (SELECT location_id, ts, v + 1 AS v, k FROM merged WHERE {AGAIN} AND hour(ts) < 12),
kept AS (SELECT 'stations' AS source, * FROM later
  UNION ALL SELECT 'stations', * FROM merged WHERE location_id NOT IN (SELECT location_id FROM later)
  UNION ALL SELECT 're/analysis', * FROM merged WHERE k > 50)"""


@query(f"WITH {SQL_KEPT} SELECT source, '2024-01-01' AS start, location_id, ts, {sql_single('v')} AS v, {sql_single('k')} AS k FROM kept")
def kept_series(spark, sf):
    path = kept(spark, sf)
    both = [tables.read_series(spark, path, KEPT, s, "2024-01-01") for s in ("stations", "re/analysis", "satellite")]
    rows = both[0].unionByName(both[1]).unionByName(both[2])
    return rows.select("source", "start", "location_id", "ts", single("v").alias("v"), single("k").alias("k"))


@query(f"""WITH {SQL_KEPT} SELECT location_id, ts, {sql_single('v')} AS v, {sql_single('k')} AS k FROM kept
WHERE source = 'stations' AND location_id IN ('3', '4', '6') AND strftime(ts, '%Y-%m') = '2024-01'""")
def kept_series_of_places(spark, sf):
    rows = tables.read_series(spark, kept(spark, sf), KEPT, "stations", "2024-01-01", ["3", "4", "6"], ("2024-01", "2024-01"))
    return rows.select("location_id", "ts", single("v").alias("v"), single("k").alias("k"))


LISTED = ["v", "k"]


@query(f"WITH {sql_merged(60, 'user_id')}, {GAPPY}, {sql_stats('gappy', LISTED)}\n" + "\nUNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS name, '{c}' AS line, 24 AS input_steps, 12 AS output_steps, {sql_digits(f'{c}_median')} AS median, {sql_digits(f'{c}_mean')} AS mean, "
    f"{sql_digits(f'{c}_std')} AS std_pop FROM stats" for i, c in enumerate(LISTED)))
def kept_dataset_info(spark, sf):
    """Column lists, window lengths and fitted statistics, and the list of features one a line."""
    path = new_folder(spark)
    g = gappy(spark, sf)
    tables.write_dataset_info(spark, f"{path}/info", LISTED, ["v"], 24, 12, scaling.fit_scaler(g, LISTED))
    tables.write_feature_list(spark, f"{path}/list", LISTED)
    info = tables.read_dataset_info(spark, f"{path}/info")
    names = spark.createDataFrame(list(enumerate(info["features"])), "place int, name string")
    lines = spark.read.text(f"{path}/list").withColumnRenamed("value", "line")
    stats = info["stats"].select(F.col("column").alias("name"), *[digits(c).alias(c) for c in ("median", "mean", "std_pop")])
    return names.join(stats, "name").join(lines, F.col("name") == F.col("line")).withColumns(
        {"input_steps": F.lit(info["input_steps"]), "output_steps": F.lit(info["output_steps"])})


@query(f"WITH {SQL_CLEAN} SELECT location_id, lat, lon FROM clean")
def kept_locations(spark, sf):
    path = new_folder(spark)
    tables.write_locations(locations.clean_locations(raw_codes(spark, sf)), path)
    return tables.read_locations(spark, path)


@query(f"WITH {sql_merged(60, 'user_id')}, {GAPPY}, wide AS (SELECT *, v - k AS d FROM gappy), {sql_stats('wide', ['v', 'k', 'd'])} SELECT location_id, ts, "
       + ", ".join(f"{sql_digits(f'(coalesce({c}, {c}_median) - {c}_mean) / {c}_std')} AS {c}" for c in ("v", "k", "d")) + " FROM wide, stats")
def refitted_on_mismatch(spark, sf):
    """Statistics fitted on two columns do not fit a table of three, so they are fitted anew."""
    g = gappy(spark, sf)
    wide = g.withColumn("d", F.col("v") - F.col("k"))
    known = scaling.fit_scaler(g)
    if scaling.check_columns(wide, known):
        raise ValueError("the column lists should differ")
    out = scaling.normalize(wide, known, on_mismatch="refit")
    return out.select("location_id", "ts", *[digits(c).alias(c) for c in ("v", "k", "d")])
