"""Query register, and weather-like tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.timegrid import floor_to

QUERIES: dict = {}
SQL: dict[str, str] = {}
# The tables span 30 days; short chunks make every series span several of them.
CHUNK = 512


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


def single(c: Column | str) -> Column:
    """Value at single precision, so that the order of additions does not show."""
    if isinstance(c, str):
        return F.expr(f"cast(cast({c} as float) as double)")
    return c.cast("float").cast("double")


def sql_single(e: str) -> str:
    return f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"


def digits(c: Column | str, n: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.expr(f"round({c}, {n}) + 0D") if isinstance(c, str) else F.round(c, n) + F.lit(0.0)


def digits_of(name: str, n: int = 6) -> Column:
    """As ``digits``, for a column named many times at no cost.

    Round goes by way of decimal text, which costs more than a distance does. Where the next digits are not close to a half and
    the number is no large one, the nearest whole number of units is sure, and its quotient is the same double as the text's.
    """
    x = F.col(name)
    units = x * F.lit(float(10**n))
    sure = (F.abs(x) < 1e5) & (F.abs(units - F.floor(units) - 0.5) > 1e-3)
    return F.when(sure, F.floor(units + 0.5) / F.lit(float(10**n))).otherwise(F.round(x, n)) + F.lit(0.0)


def sql_digits(e: str, n: int = 6) -> str:
    return f"(round({e}, {n}) + 0.0::DOUBLE)"


# Cells: events per type and 15 minutes. Sums of cents and of k are exact, so both engines get equal values.
def cells(spark: SparkSession, sf: str, minutes: int = 15, by: str = "event_type") -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return (
        e.groupBy(F.col(by).cast("string").alias("location_id"), floor_to("ts", minutes * 60).alias("ts"),
                  F.pmod("user_id", F.lit(3)).alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
             F.sum(k).alias("ks"))
        .select("location_id", "ts", "part", (F.col("cents") / (F.col("n") * 100)).alias("v"), (F.col("ks") / F.col("n")).alias("k"))
    )


def sql_cells(minutes: int = 15, by: str = "event_type") -> str:
    return f"""cells AS (
  SELECT location_id, ts, part, cents::DOUBLE / (n * 100) AS v, ks::DOUBLE / n AS k FROM (
    SELECT CAST({by} AS VARCHAR) AS location_id, time_bucket(INTERVAL {minutes} MINUTE, ts) AS ts, user_id % 3 AS part,
      count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
      CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS ks
    FROM events GROUP BY 1, 2, 3))"""


def merged_cells(spark: SparkSession, sf: str, minutes: int = 15, by: str = "event_type") -> DataFrame:
    """One value per location and time: the mean over all events of the cell."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return (
        e.groupBy(F.col(by).cast("string").alias("location_id"), floor_to("ts", minutes * 60).alias("ts"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
             F.sum(k).alias("ks"))
        .select("location_id", "ts", (F.col("cents") / (F.col("n") * 100)).alias("v"), (F.col("ks") / F.col("n")).alias("k"))
    )


def sql_merged(minutes: int = 15, by: str = "event_type") -> str:
    return f"""merged AS (
  SELECT location_id, ts, cents::DOUBLE / (n * 100) AS v, ks::DOUBLE / n AS k FROM (
    SELECT CAST({by} AS VARCHAR) AS location_id, time_bucket(INTERVAL {minutes} MINUTE, ts) AS ts,
      count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
      CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS ks
    FROM events GROUP BY 1, 2))"""


# Three sources. Stations know no temperature at "signup", so that location takes it from the grid.
STATION_EXPR = {
    "temperature_celsius": "CASE WHEN location_id <> 'signup' THEN v / 10 - 5 END",
    C.HUMIDITY: "k", C.PRECIP: "v / 50", C.WIND_SPEED: "k / 5", C.WIND_DIR: "v", C.PRESSURE: "1000 + v / 10",
}
GRID_EXPR = {
    "temperature_celsius": "v / 8 - 3", C.HUMIDITY: "100 - k", C.WIND_SPEED: "k / 4", C.WIND_DIR: "v / 2",
    C.PRESSURE: "990 + v / 10", C.CLOUD: "k",
}
SATELLITE_EXPR = {C.PRECIP: "CASE WHEN location_id <> 'view' THEN v / 40 END"}
SOURCE_EXPR = {"stations": (2, STATION_EXPR), "reanalysis": (0, GRID_EXPR), "satellite": (1, SATELLITE_EXPR)}


def sources(spark: SparkSession, sf: str, minutes: int = 15, by: str = "event_type") -> dict[str, DataFrame]:
    c = cells(spark, sf, minutes, by)
    return {
        name: c.filter(F.col("part") == part).select("location_id", "ts", *[F.expr(e).alias(v) for v, e in exprs.items()])
        for name, (part, exprs) in SOURCE_EXPR.items()
    }


def sql_sources(minutes: int = 15, by: str = "event_type") -> str:
    parts = [sql_cells(minutes, by)]
    for name, (part, exprs) in SOURCE_EXPR.items():
        cols = ", ".join(f"{e} AS {v}" for v, e in exprs.items())
        parts.append(f"{name} AS (SELECT location_id, ts, {cols} FROM cells WHERE part = {part})")
    return ",\n".join(parts)


# A gapless series: one row per 15 minutes, the last known cell held.
OBSERVED = {
    C.TEMP: "v / 10 - 5", C.HUMIDITY: "k", C.PRECIP: "v / 50", C.WIND_SPEED: "k / 5", C.WIND_DIR: "v",
    C.PRESSURE: "1000 + v / 10", C.CLOUD: "k",
}


def observed(spark: SparkSession, sf: str) -> DataFrame:
    from isobar.operators import align

    filled = align.regular_series(merged_cells(spark, sf), ["v", "k"], limit=0, chunk=CHUNK)
    return filled.select("location_id", "ts", *[F.expr(e).alias(v) for v, e in OBSERVED.items()])


SQL_GRID = """grid AS (
  SELECT location_id, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts
  FROM (SELECT location_id, min(ts) AS lo, max(ts) AS hi FROM merged GROUP BY 1))"""


def sql_observed() -> str:
    cols = ", ".join(f"{e} AS {v}" for v, e in OBSERVED.items())
    return f"""{sql_merged()},
{SQL_GRID},
held AS (
  SELECT g.location_id, g.ts, last_value(m.v IGNORE NULLS) OVER w AS v, last_value(m.k IGNORE NULLS) OVER w AS k
  FROM grid g LEFT JOIN merged m ON m.location_id = g.location_id AND m.ts = g.ts
  WINDOW w AS (PARTITION BY g.location_id ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
observed AS (SELECT location_id, ts, {cols} FROM held)"""


# Places: coordinates worked out from a key.
def place(key: str, lat0: float = 24.0, lats: int = 800) -> dict[str, Column]:
    k = F.col(key)
    return {
        "lat": F.lit(lat0) + F.pmod(k * 37, F.lit(lats)) / 100,
        "lon": F.lit(-110.0) + F.pmod(k * 53, F.lit(1000)) / 100,
    }


def sql_place(key: str, lat0: float = 24.0, lats: int = 800) -> str:
    return (f"CAST({lat0} AS DOUBLE) + CAST(({key} * 37) % {lats} AS DOUBLE) / 100 AS lat, "
            f"CAST(-110.0 AS DOUBLE) + CAST(({key} * 53) % 1000 AS DOUBLE) / 100 AS lon")


def sql_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"2 * 6371.0088 * asin(least(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)), 1.0))")
