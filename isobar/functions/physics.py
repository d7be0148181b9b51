"""Meteorological formulas and unit conversions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar import constants as C


def kelvin_to_celsius(k: Column) -> Column:
    return k - 273.15


def pascal_to_hpa(p: Column) -> Column:
    return p / 100


def kmh_to_ms(v: Column) -> Column:
    return v * 1000 / 3600


def hourly_intensity(mm_per_quarter_hour: Column) -> Column:
    return mm_per_quarter_hour * 4


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column, convention: str = "mathematical") -> Column:
    """Angle of the wind vector in [0, 360): counter-clockwise from east, or where the wind blows from."""
    if convention == "mathematical":
        return F.pmod(F.degrees(F.atan2(v, u)), F.lit(360.0))
    if convention == "meteorological":
        return F.pmod(F.degrees(F.atan2(u, v)) + 180, F.lit(360.0))
    raise ValueError(f"unknown convention {convention!r}")


def _magnus(t: Column) -> Column:
    return 17.625 * t / (243.04 + t)


def humidity_from_dewpoint(temp: Column, dewpoint: Column) -> Column:
    return 100 * F.exp(_magnus(dewpoint)) / F.exp(_magnus(temp))


def dewpoint(temp: Column, humidity: Column) -> Column:
    """Empty where humidity is not above zero."""
    alpha = F.ln(humidity / 100) + _magnus(temp)
    return 243.04 * alpha / (17.625 - alpha)


def heat_index(temp: Column, humidity: Column) -> Column:
    t, h = temp, humidity
    tt, hh = t * t, h * h
    return (
        -8.78469475556 + 1.61139411 * t + 2.33854883889 * h - 0.14611605 * t * h - 0.012308094 * tt
        - 0.01642482778 * hh + 0.002211732 * tt * h + 0.00072546 * t * hh - 0.000003582 * tt * hh
    )


def wind_chill(temp: Column, speed_ms: Column, v_unit: str = "ms") -> Column:
    """Felt temperature below 10 degrees with wind above 1.3 m/s, else the temperature itself."""
    speed = speed_ms * 3.6 if v_unit == "kmh" else speed_ms
    power = F.pow(speed, F.lit(0.16))
    cold = (temp < 10) & (speed_ms > 1.3)
    return F.when(cold, 13.12 + 0.6215 * temp - 11.37 * power + 0.3965 * temp * power).otherwise(temp)


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """Haversine distance on a sphere of mean earth radius; ``cos1`` and ``cos2`` are the latitudes' cosines where they are known."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    cos1 = F.cos(F.radians(lat1)) if cos1 is None else cos1
    cos2 = F.cos(F.radians(lat2)) if cos2 is None else cos2
    a = F.sin(dlat) * F.sin(dlat) + cos1 * cos2 * F.sin(dlon) * F.sin(dlon)
    return 2 * C.EARTH_RADIUS_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def inverse_distance_weight(distance_km: Column) -> Column:
    return 1 / (1 + distance_km)


def clip(value: Column, low: float | None, high: float | None) -> Column:
    """Bring a value into limits; empty stays empty."""
    bounded = value
    if low is not None:
        bounded = F.when(value < low, F.lit(float(low))).otherwise(bounded)
    if high is not None:
        bounded = F.when(value > high, F.lit(float(high))).otherwise(bounded)
    return bounded


def clip_columns(df: DataFrame, limits: Mapping[str, tuple[float | None, float | None]] = C.LIMITS) -> DataFrame:
    """Clip the columns that exist."""
    known = {c: clip(F.col(c), *limits[c]) for c in df.columns if c in limits}
    return df.withColumns(known) if known else df


def non_negative(value: Column) -> Column:
    """Missing or negative becomes 0."""
    number = finite(value)
    return F.when(number > 0, number).otherwise(F.lit(0.0))


def finite(value: Column) -> Column:
    """NaN and infinities become empty."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes empty in every floating-point column; apply to tables as they are read."""
    floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name))
              for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(floats) if floats else df
