"""Rain probability from a provider's current conditions and hourly forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.functions.categories import confidence
from isobar.functions.physics import clip
from isobar.functions.text import exact_round

HOURS = 6
HOURLY = "array<struct<dt:bigint,pop:double,rain:map<string,double>>>"
FALLBACK_PROBABILITY = 0.1


def next_hours(hourly: Column = None, n: int = HOURS) -> Column:
    """The first hours of the forecast array."""
    return F.slice(F.col("hourly") if hourly is None else hourly, 1, n)


def rains(rain: Column) -> Column:
    """Whether a rain record says anything: an object with any entry, of one hour, three hours or another period."""
    return F.coalesce(F.size(F.map_keys(rain)) > 0, F.lit(False))


def hour_summary(hours: Column) -> dict[str, Column]:
    """Sum of rain chances, hours with a chance above 0.3, hours with rain, and number of hours."""
    chance = F.transform(hours, lambda h: F.coalesce(h["pop"], F.lit(0.0)))
    return {
        "pop_sum": F.aggregate(chance, F.lit(0.0), lambda a, p: a + p),
        "pop_hours": F.size(F.filter(chance, lambda p: p > 0.3)),
        "rain_hours": F.size(F.filter(hours, lambda h: rains(h["rain"]))),
        "n_hours": F.size(hours),
    }


def probability() -> Column:
    """Estimate from ``current`` and ``hourly``; missing numbers count as 0.

    Parts are added in a fixed order, since sums near the 0.3 threshold depend on it.
    """
    current = F.col("current")
    hours = F.coalesce(next_hours(), F.from_json(F.lit("[]"), HOURLY))
    s = hour_summary(hours)
    zero = F.lit(0.0)
    p = F.when(rains(current["rain"]), 0.4).otherwise(zero)
    p = p + F.when(F.coalesce(current["humidity"], zero) > 80, 0.2).otherwise(zero)
    p = p + F.when(F.coalesce(current["clouds"], zero) > 70, 0.2).otherwise(zero)
    p = F.aggregate(hours, p, lambda a, h: a + F.when(rains(h["rain"]), 0.1).otherwise(zero))
    p = p + F.when(s["n_hours"] > 0, s["pop_sum"] / s["n_hours"] * 0.3).otherwise(zero)
    p = p + F.when(s["pop_hours"] >= 3, 0.2).otherwise(zero)
    return clip(p, 0.0, 1.0)


def rain_results(payloads: DataFrame) -> DataFrame:
    """One result per location with a payload."""
    p = F.col("_p")
    return payloads.withColumn("_p", probability()).select(
        "location_id", exact_round(p, 3).alias("rain_probability"), (p > 0.3).alias("will_rain_next_6h"),
        confidence(p).alias("confidence_level"), F.lit("real_time_estimator").alias("model_type"),
        F.col("current").alias("current_conditions"), next_hours().alias("hourly_forecast"),
    )


def rain_for_locations(locations: DataFrame, payloads: DataFrame) -> DataFrame:
    """One result per location; where no payload arrived, the cautious default."""
    found = locations.join(rain_results(payloads), "location_id", "left")
    return found.withColumns({
        "rain_probability": F.coalesce("rain_probability", F.lit(FALLBACK_PROBABILITY)),
        "will_rain_next_6h": F.coalesce("will_rain_next_6h", F.lit(False)),
        "confidence_level": F.coalesce("confidence_level", F.lit("low")),
        "model_type": F.coalesce("model_type", F.lit("fallback")),
    })
