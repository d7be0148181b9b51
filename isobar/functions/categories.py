"""Classes and texts for weather values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.text import fixed


def precip_class(mm_per_hour: Column) -> Column:
    return (
        F.when(mm_per_hour == 0, "no_rain")
        .when(mm_per_hour < C.RAIN_MODERATE, "light_rain")
        .when(mm_per_hour < C.RAIN_HEAVY, "moderate_rain")
        .when(mm_per_hour >= C.RAIN_HEAVY, "heavy_rain")
        .otherwise("unknown")
    )


def cloud_class(percent: Column) -> Column:
    return (
        F.when(percent < 25, "clear").when(percent < 50, "partly_cloudy").when(percent < 75, "mostly_cloudy")
        .when(percent >= 75, "overcast").otherwise("unknown")
    )


def description(temp: Column, rain: Column, clouds: Column, wind: Column) -> Column:
    """Short Spanish text: temperature, then rain or clouds, then wind if strong."""
    warmth = (
        F.when(temp < C.COLD, "Frío").when(temp > C.HOT, "Caluroso").otherwise("Temperatura agradable")
    )
    sky = (
        F.when(rain > C.RAIN_HEAVY, "Lluvia torrencial")
        .when(rain > C.RAIN_MODERATE, "Lluvia fuerte")
        .when(rain > C.RAIN_LIGHT, "Lluvia ligera")
        .when(clouds > C.CLOUDY, "Nublado")
        .when(clouds > C.PARTLY_CLOUDY, "Parcialmente nublado")
        .otherwise("Despejado")
    )
    return F.concat_ws(", ", warmth, sky, F.when(wind > C.WINDY, "Ventoso"))


def rain_label(rain: Column) -> Column:
    return F.when(rain > 0.1, "LLUVIA").otherwise("SOLEADO")


def temperature_color(temp: Column) -> Column:
    return F.when(temp > C.HOT, "red").when(temp < C.COLD, "blue").otherwise("green")


def precip_flag(rain: Column) -> Column:
    """Which of the two marked rain levels a value reaches: 0, 1 or 2."""
    return F.when(rain >= C.RAIN_MODERATE, 2).when(rain >= C.RAIN_LIGHT, 1).otherwise(0)


def confidence(probability: Column) -> Column:
    return F.when(probability < 0.3, "low").when(probability < 0.7, "medium").otherwise("high")


def table_line() -> Column:
    """Fixed-width text of a forecast step, from the columns of a formatted forecast."""
    rain = F.concat(fixed(F.col("precipitation_mm"), 1), F.lit("mm"))
    return F.format_string(
        "%10s | %5sC | %7s %8s | %4s%% | %4sm/s | %6shPa | %4s%% | %s",
        F.col("time"), fixed(F.col("temp"), 1), rain, rain_label(F.col("precipitation_mm")), fixed(F.col("humidity"), 0),
        fixed(F.col("wind_speed"), 1), fixed(F.col("pressure"), 0), fixed(F.col("cloud_cover"), 0), F.col("desc"),
    )


def console_line() -> Column:
    """Narrower text of a forecast step, without clouds and rain label."""
    rain = F.concat(fixed(F.greatest(F.col("precipitation_mm"), F.lit(0.0)), 1), F.lit("mm"))
    return F.format_string(
        "%8s | %5sC | %7s | %4s%% | %4sm/s | %6shPa | %s",
        F.col("time"), fixed(F.col("temp"), 1), rain, fixed(F.col("humidity"), 0), fixed(F.col("wind_speed"), 1),
        fixed(F.col("pressure"), 0), F.col("desc"),
    )
