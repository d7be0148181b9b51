"""Forecasts in the form users read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions import calendar, categories
from isobar.functions.text import exact_round

ROUNDED = {
    "temp": (C.TEMP, 1),
    "humidity": (C.HUMIDITY, 1),
    "wind_speed": (C.WIND_SPEED, 1),
    "pressure": (C.PRESSURE, 1),
    "cloud_cover": (C.CLOUD, 1),
}


def format_forecast(scored: DataFrame, step: int = C.STEP_SECONDS) -> DataFrame:
    """One row per forecast step from (location_id, lat, lon, origin_ts, horizon, target variables)."""
    rain = exact_round(F.col(C.PRECIP), 2)
    stepwise = scored.select(
        "location_id", exact_round(F.col("lat"), 3).alias("lat"), exact_round(F.col("lon"), 3).alias("lon"), "origin_ts", "horizon",
        calendar.horizon_label(F.col("horizon"), step).alias("time"),
        calendar.horizon_time(F.col("origin_ts"), F.col("horizon"), step).alias("timestamp"),
        F.when(rain < 0, F.lit(0.0)).otherwise(rain).alias("precipitation_mm"),
        *[exact_round(F.col(v), digits).alias(name) for name, (v, digits) in ROUNDED.items()],
    )
    return stepwise.withColumn("desc", categories.description(
        F.col("temp"), F.col("precipitation_mm"), F.col("cloud_cover"), F.col("wind_speed")))


STEP_FIELDS = ["time", "timestamp", "temp", "precipitation_mm", "humidity", "wind_speed", "pressure", "cloud_cover", "desc"]


def pack_forecast(formatted: DataFrame, step: int = C.STEP_SECONDS) -> DataFrame:
    """One nested record per location and origin, with its steps in order."""
    fields = [calendar.iso_text(F.col("timestamp")).alias("timestamp") if f == "timestamp" else F.col(f) for f in STEP_FIELDS]
    entry = F.struct(F.col("horizon"), F.struct(*fields).alias("step"))
    info = F.struct(
        F.lit("6 hours").alias("input_window"), F.lit("6 hours").alias("output_window"),
        F.lit(f"{step // 60} minutes").alias("time_step"), F.size("_steps").alias("n_steps"),
    )
    return (
        formatted.groupBy("location_id", "origin_ts")
        .agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.array_sort(F.collect_list(entry)).alias("_steps"))
        .select(
            "location_id", "origin_ts", F.array("lat", "lon").alias("coords"),
            F.transform("_steps", lambda s: s["step"]).alias("forecast"), info.alias("model_info"),
        )
    )


def unpack_forecast(packed: DataFrame, step: int = C.STEP_SECONDS) -> DataFrame:
    """Steps of nested forecasts as rows, times worked out from their labels."""
    rows = packed.select("location_id", "origin_ts", F.explode("forecast").alias("s"))
    minutes = calendar.minutes_ahead(F.col("s.time"))
    return rows.select(
        "location_id", "origin_ts", minutes.alias("minutes_ahead"),
        calendar.horizon_time(F.col("origin_ts"), minutes, 60).alias("timestamp"),
        F.col("s.temp").alias(C.TEMP), F.col("s.precipitation_mm").alias(C.PRECIP),
        F.col("s.humidity").alias("humidity_percent"), F.col("s.wind_speed").alias(C.WIND_SPEED),
        F.col("s.pressure").alias(C.PRESSURE), F.col("s.cloud_cover").alias(C.CLOUD), F.col("s.desc").alias("description"),
    )


def first_steps(packed: DataFrame, n: int = 3) -> DataFrame:
    return packed.withColumn("forecast", F.slice("forecast", 1, n))
