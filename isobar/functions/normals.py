"""Climate normals: the expected value of each variable at a place and time."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.physics import clip, kmh_to_ms


def region(lat: Column, lon: Column) -> Column:
    return F.when(lat > 31.0, "juarez").when(lon < -106.5, "mountains").otherwise("chihuahua_city")


def _by_region(name: Column, pick: Callable) -> Column:
    """Parameter of a region; the table of regions is fixed and small."""
    (first, params), *rest = C.NORMALS.items()
    chosen = F.when(name == first, pick(params))
    for other, params in rest:
        chosen = chosen.when(name == other, pick(params))
    return chosen


def _season_angle(ts: str) -> Column:
    return F.sin(2 * math.pi * (F.dayofyear(ts) - 80) / 365)


def _decimal_hour(ts: str) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def temperature(name: Column, ts: str = "ts") -> Column:
    base = _by_region(name, lambda p: F.lit(p[0]))
    amplitude = _by_region(name, lambda p: F.lit(p[1]))
    return base + amplitude * _season_angle(ts) + 3 * F.sin(2 * math.pi * (_decimal_hour(ts) - 6) / 24)


def humidity(name: Column, ts: str = "ts") -> Column:
    base = _by_region(name, lambda p: F.lit(p[2]))
    return clip(base - 10 * _season_angle(ts) - 5 * F.sin(2 * math.pi * _decimal_hour(ts) / 24), 10, 90)


def monthly_rain(name: Column, ts: str = "ts") -> Column:
    months = _by_region(name, lambda p: F.array(*[F.lit(float(m)) for m in p[3]]))
    return F.element_at(months, F.month(ts))


def expected_rain(name: Column, ts: str = "ts") -> Column:
    """Expected amount per 15 minutes: chance of rain in the step times the mean amount of 2 mm."""
    chance = monthly_rain(name, ts) / 100 * (1 + 0.5 * F.sin(2 * math.pi * _decimal_hour(ts) / 24)) / 96
    return 2.0 * chance


def wind(name: Column) -> Column:
    return kmh_to_ms(_by_region(name, lambda p: F.lit(p[4])))


def pressure(name: Column) -> Column:
    return clip(_by_region(name, lambda p: F.lit(p[5])), 980, 1030)


def with_normals(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the region of (lat, lon) and ``normal_{variable}`` for every canonical variable."""
    name = F.col("region")
    return df.withColumn("region", region(F.col("lat"), F.col("lon"))).withColumns({
        f"normal_{C.TEMP}": temperature(name, ts),
        f"normal_{C.HUMIDITY}": humidity(name, ts),
        f"normal_{C.WIND_SPEED}": wind(name),
        f"normal_{C.WIND_DIR}": F.lit(225.0),
        f"normal_{C.PRESSURE}": pressure(name),
        f"normal_{C.PRECIP}": expected_rain(name, ts),
        f"normal_{C.CLOUD}": humidity(name, ts) / 2,
    })


def normal_series(grid: DataFrame, ts: str = "ts") -> DataFrame:
    """A stand-in series from the normals for rows of (location_id, lat, lon, ts)."""
    wide = with_normals(grid, ts)
    return wide.select("location_id", ts, *[F.col(f"normal_{v}").alias(v) for v in C.CANONICAL])


def with_anomalies(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add the departure of each existing canonical variable from its normal."""
    wide = with_normals(df, ts)
    return wide.withColumns({f"anomaly_{v}": F.col(v) - F.col(f"normal_{v}") for v in C.CANONICAL if v in df.columns})
