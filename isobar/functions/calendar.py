"""Calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.timegrid import plus_seconds


def parts(ts: str = "ts") -> dict[str, Column]:
    """Hour, weekday (Monday is 0), month and day of the year."""
    return {
        "hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts), "day_of_year": F.dayofyear(ts),
    }


def cyclic(ts: str = "ts") -> dict[str, Column]:
    """Sine and cosine of hour, weekday and month on their circles."""
    turns = {"hour": F.hour(ts) / 24, "dow": F.weekday(ts) / 7, "month": (F.month(ts) - 1) / 12}
    out = {}
    for name, turn in turns.items():
        out[f"{name}_sin"] = F.sin(2 * math.pi * turn)
        out[f"{name}_cos"] = F.cos(2 * math.pi * turn)
    return out


def season(ts: str = "ts") -> Column:
    """Quarter of the year by name: January to March is winter, and so on."""
    m = F.month(ts)
    return F.when(m <= 3, "winter").when(m <= 6, "spring").when(m <= 9, "summer").otherwise("fall")


def one_hot(category: Column, values: list[str], prefix: str) -> dict[str, Column]:
    """A 0/1 column per value of a fixed list."""
    return {f"{prefix}_{v}": (category == v).cast("int") for v in values}


def temporal(ts: str = "ts") -> dict[str, Column]:
    """All calendar features in output order."""
    return {**parts(ts), **cyclic(ts), "season": season(ts), **one_hot(season(ts), C.SEASONS, "season")}


def horizon_time(base: Column, horizon: Column, step: int = C.STEP_SECONDS) -> Column:
    """Time of a forecast step; step 1 is one interval after the base time."""
    return plus_seconds(base, horizon * step)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def horizon_label(horizon: Column, step: int = C.STEP_SECONDS) -> Column:
    return F.concat(F.lit("+"), (horizon * (step // 60)).cast("string"), F.lit("min"))


def minutes_ahead(label: Column) -> Column:
    """Minutes named by a horizon label."""
    return F.regexp_extract(label, r"^\+(\d+)min$", 1).try_cast("int")
