"""Formulas and classes against known values."""

import math

import pytest
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions import calendar, categories, normals, physics, text, timegrid


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def lit(*vs):
    return [F.lit(None).cast("double") if v is None else F.lit(float(v)) for v in vs]


@pytest.mark.parametrize("build,want", [
    (lambda: physics.heat_index(*lit(35, 60)), 45.05017127),
    (lambda: physics.heat_index(*lit(20, 50)), 25.19491234),
    (lambda: physics.dewpoint(*lit(20, 50)), 9.26110663),
    (lambda: physics.dewpoint(*lit(30, 80)), 26.17090291),
    (lambda: physics.humidity_from_dewpoint(*lit(20, 10)), 52.54132558),
    (lambda: physics.wind_chill(*lit(5, 5)), 4.08284588),
    (lambda: physics.wind_speed(*lit(3, 4)), 5),
    (lambda: physics.wind_direction(*lit(3, 4)), 53.13010235),
    (lambda: physics.wind_direction(*lit(-1, -1)), 225),
    (lambda: physics.wind_direction(*lit(0, -1)), 270),
    (lambda: physics.wind_direction(*lit(0, -1), "meteorological"), 0),
    (lambda: physics.great_circle_km(*lit(28.6320, -106.0691, 31.6904, -106.4245)), 341.79039792),
    (lambda: physics.great_circle_km(*lit(28.6320, -106.0691, 28.1901, -105.47)), 76.46962926),
    (lambda: normals.temperature(F.lit("chihuahua_city"), "timestamp_ntz'2024-07-15 18:00:00'"), None),
])
def test_formulas(spark, build, want):
    if want is None:
        df = spark.sql("select timestamp_ntz'2024-07-15 18:00:00' ts")
        assert df.select(normals.temperature(F.lit("chihuahua_city")).alias("x")).first().x == pytest.approx(28.84026963)
        return
    assert one(spark, build()) == pytest.approx(want, abs=1e-7)


def test_missing_values(spark):
    assert one(spark, physics.dewpoint(*lit(20, 0))) is None
    assert one(spark, physics.wind_chill(*lit(5, None))) == 5
    assert one(spark, physics.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert one(spark, physics.non_negative(F.lit(float("nan")))) == 0
    assert one(spark, physics.finite(F.lit(float("-inf")))) is None
    df = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert tuple(physics.missing_as_null(df).first()) == (None, 1.0)


def test_classes(spark):
    df = spark.createDataFrame([(0.0,), (None,), (-1.0,), (2.5,), (7.6,), (10.0,)], "x double")
    got = [r[0] for r in df.select(categories.precip_class(F.col("x"))).collect()]
    assert got == ["no_rain", "unknown", "light_rain", "moderate_rain", "heavy_rain", "heavy_rain"]
    got = [r[0] for r in df.select(categories.cloud_class(F.col("x") * 10)).collect()]
    assert got == ["clear", "unknown", "clear", "partly_cloudy", "overcast", "overcast"]
    assert one(spark, categories.description(*lit(10, 7.6, 99, 10))) == "Temperatura agradable, Lluvia fuerte"
    assert one(spark, categories.description(*lit(9, 0.2, 61, 11))) == "Frío, Nublado, Ventoso"


def test_calendar(spark):
    df = spark.sql("select timestamp_ntz'2024-12-30 18:45:00' ts")  # a Monday
    r = df.select(*[e.alias(n) for n, e in calendar.temporal().items()]).first()
    assert (r.hour, r.day_of_week, r.month, r.day_of_year, r.season) == (18, 0, 12, 365, "fall")
    assert r.hour_sin == pytest.approx(-1) and r.month_cos == pytest.approx(math.cos(2 * math.pi * 11 / 12))
    assert (r.season_fall, r.season_winter) == (1, 0)
    label = calendar.horizon_label(F.lit(3))
    assert one(spark, label) == "+45min"
    assert one(spark, calendar.minutes_ahead(label)) == 45
    assert one(spark, calendar.minutes_ahead(F.lit("soon"))) is None


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_does_not_depend_on_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 02:37:11.5' ts")  # skipped in New York
        r = df.select(timegrid.seconds("ts").alias("s"), timegrid.floor_to("ts", 900).cast("string").alias("f")).first()
        assert (r.s, r.f) == (1710038231, "2024-03-10 02:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_exact_rounding_matches_python(spark):
    xs = [2.675, 0.125, 1.005, -0.005, 0.35, 44.5, 1234567.885, 0.8815]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r.x for r in df.select(text.exact_round(F.col("x"), 2).alias("x")).collect()]
    assert got == [round(x, 2) + 0.0 for x in xs]
    assert [r.x for r in df.select(text.fixed(F.col("x"), 0).alias("x")).collect()] == [f"{x:.0f}" for x in xs]


def test_regions(spark):
    rows = spark.createDataFrame([(31.5, -105.0), (28.0, -107.0), (28.0, -106.0)], "lat double, lon double")
    assert [r[0] for r in rows.select(normals.region(F.col("lat"), F.col("lon"))).collect()] == ["juarez", "mountains", "chihuahua_city"]
    assert set(C.NORMALS) == {"juarez", "mountains", "chihuahua_city"}
