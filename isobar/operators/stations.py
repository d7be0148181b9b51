"""Ground stations: nearest ones, observations in canonical form, distance-weighted merge."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.physics import great_circle_km, inverse_distance_weight, kmh_to_ms
from isobar.operators.locations import within_radius


FAN_OUT = 8
DEEPEST = 6


def nearest_stations(locations: DataFrame, stations: DataFrame, radius_km: float = 50, k: int = 5,
                     salts: int = 1, capacity: int = 64) -> DataFrame:
    """Up to k stations within the radius of each location, with ``distance_km`` and ``rank``.

    Locations that share coordinates are searched once. Of stations at one place only the first k by
    name can be among the k nearest, so a pile of stations at one spot is cut to k before matching.

    Locations are matched with cells of stations first. From the cells' counts and distances follows how
    far the k-th station can be at most, and cells beyond that are dropped. Cells are split until
    none holds more than ``capacity`` stations, so that a crowded area is not compared pair by pair.
    """
    spot = Window.partitionBy("latitude", "longitude").orderBy("station_id")
    distinct = stations.withColumn("_rn", F.row_number().over(spot)).filter(F.col("_rn") <= k).select(
        "station_id", F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"))
    places = locations.select("lat", "lon").distinct().withColumn("_place", F.struct("lat", "lon"))

    root = math.degrees(radius_km / 2 / C.EARTH_RADIUS_KM)
    depth = 0
    while depth < DEEPEST:
        size = root / FAN_OUT**depth
        busiest = distinct.groupBy(F.expr(f"floor(_slat / {size})"), F.expr(f"floor(_slon / {size})")).count()
        if (busiest.agg(F.max("count")).first()[0] or 0) <= capacity:
            break
        depth += 1
    leaf = root / FAN_OUT**depth
    placed = distinct.selectExpr("*", f"floor(_slat / {leaf}) AS _r", f"floor(_slon / {leaf}) AS _c")

    def cells(level: int) -> DataFrame:
        """Cells with stations, their number, and a point of each; ids of the level above as _pr, _pc."""
        f = FAN_OUT ** (depth - level)
        size = root / FAN_OUT**level
        return (
            placed.groupBy(F.expr(f"floor(_r / {f})").alias("_r"), F.expr(f"floor(_c / {f})").alias("_c"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .selectExpr("_r", "_c", "_n", f"floor(_r / {FAN_OUT}) AS _pr", f"floor(_c / {FAN_OUT}) AS _pc",
                        f"least(greatest((_r + 0.5D) * {size}D, -90D), 90D) AS _clat", f"(_c + 0.5D) * {size}D AS _clon")
        )

    reach = _reach(root)
    top = cells(0).selectExpr("named_struct('r', _r, 'c', _c) AS _box", "_n", "_clat AS lat", "_clon AS lon")
    front = within_radius(places, top, radius_km + reach, "_place", "_box", salts, keep=["_n"], copied="points").selectExpr(
        "lat", "lon", "_box.r AS _r", "_box.c AS _c", "_n", "distance_km AS _km")
    front = _possible(front, k, radius_km, reach)
    for level in range(1, depth + 1):
        inner = cells(level).withColumnsRenamed({"_r": "_nr", "_c": "_nc", "_pr": "_r", "_pc": "_c"})
        km = great_circle_km(F.col("lat"), F.col("lon"), F.col("_clat"), F.col("_clon"))
        front = front.drop("_n").join(inner, ["_r", "_c"]).select(
            "lat", "lon", F.col("_nr").alias("_r"), F.col("_nc").alias("_c"), "_n", km.alias("_km"))
        front = _possible(front, k, radius_km, _reach(root / FAN_OUT**level))

    by_distance = Window.partitionBy("lat", "lon").orderBy("distance_km", "station_id")
    km = great_circle_km(F.col("lat"), F.col("lon"), F.col("_slat"), F.col("_slon"))
    best = (
        front.select("lat", "lon", "_r", "_c").join(placed, ["_r", "_c"])
        .select("lat", "lon", "station_id", km.alias("distance_km"))
        .filter(F.col("distance_km") <= radius_km)
        .withColumn("rank", F.row_number().over(by_distance))
        .filter(F.col("rank") <= k)
    )
    return locations.select("location_id", "lat", "lon").join(best, ["lat", "lon"]).select(
        "location_id", "station_id", "distance_km", "rank")


def _reach(size: float) -> float:
    """No point of a cell of this size in degrees is farther from the cell's own point."""
    return 1.5 * C.EARTH_RADIUS_KM * math.radians(size)


def _possible(front: DataFrame, k: int, radius_km: float, reach: float) -> DataFrame:
    """Cells that can hold one of the k nearest stations of their place."""
    place = Window.partitionBy("lat", "lon")
    nearest_first = place.orderBy("_km", "_r", "_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # All stations of the cells up to the one that completes k are at most this far away.
    enough = F.min(F.when(F.col("_upto") >= k, F.col("_km") + reach)).over(place)
    return (
        front.withColumn("_upto", F.sum("_n").over(nearest_first))
        .withColumn("_bound", F.least(F.coalesce(enough, F.lit(float(radius_km))), F.lit(float(radius_km))))
        .filter(F.col("_km") - reach <= F.col("_bound"))
        .select("lat", "lon", "_r", "_c", "_n")
    )


def with_station_details(nearest: DataFrame, stations: DataFrame) -> DataFrame:
    """Add name, country, region, position and elevation; a missing name or elevation gets a default."""
    details = stations.select(
        "station_id", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce("region", F.lit("")).alias("region"), "latitude", "longitude",
        F.coalesce("elevation", F.lit(0.0)).alias("elevation"),
    )
    return nearest.join(details, "station_id")


def canonical_observations(obs: DataFrame) -> DataFrame:
    """Station columns under canonical names, wind in m/s."""
    renamed = obs.withColumnsRenamed({k: v for k, v in C.STATION_COLUMNS.items() if k in obs.columns})
    winds = {c: kmh_to_ms(F.col(c)) for c in (C.WIND_SPEED, "wind_gust_ms") if c in renamed.columns}
    return renamed.withColumns(winds) if winds else renamed


def weighted_observations(obs: DataFrame, nearest: DataFrame, salts: int = 1) -> DataFrame:
    """Observations of the stations near each location, with distance and weight.

    ``salts`` spreads the observations of a busy station over several tasks when the table of near
    stations is too large to broadcast.
    """
    near = nearest.select("location_id", "station_id", "distance_km")
    on = ["station_id"]
    if salts > 1:
        near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        obs = obs.withColumn("_salt", F.pmod(F.xxhash64("ts"), F.lit(salts)).cast("int"))
        on = [*on, "_salt"]
    return obs.join(near, on).withColumn("weight", inverse_distance_weight(F.col("distance_km"))).drop("_salt")


def merge_stations(weighted: DataFrame, variables: Sequence[str] = C.MERGED_STATION_VARIABLES,
                   denominator: str = "all", wind: str = "linear") -> DataFrame:
    """Weighted mean per location and time.

    With denominator "all" the weights of every station reporting at that time count, also of those
    that lack the variable; "per_variable" counts only stations that have it. Wind direction is
    averaged as a number, or as an angle with ``wind="circular"``.
    """
    if denominator not in ("all", "per_variable") or wind not in ("linear", "circular"):
        raise ValueError(f"unknown option: {denominator!r}, {wind!r}")
    w = F.col("weight")
    out = []
    for v in (v for v in variables if v in weighted.columns):
        has = F.col(v).isNotNull()
        below = F.sum(w) if denominator == "all" else F.sum(F.when(has, w))
        if v == C.WIND_DIR and wind == "circular":
            angle = F.radians(v)
            mean = F.pmod(F.degrees(F.atan2(F.sum(F.sin(angle) * w), F.sum(F.cos(angle) * w))), F.lit(360.0))
        else:
            mean = F.sum(F.col(v) * w) / below
        out.append(mean.alias(v))
    return weighted.groupBy("location_id", "ts").agg(*out)
