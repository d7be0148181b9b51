"""One job from requested codes to unified series: coordinates, stations, grid, satellite, merge, and a stand-in where they fail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions import normals
from isobar.operators import align, grids, locations, series, stations
from isobar.plans.stage import materialized


@dataclass
class Landed:
    """Landed tables of a job; a source that is None is not used.

    stations with their observations; grid (valid_time, latitude, longitude, ...); satellite (ts, latitude, longitude, ...).
    """

    stations: DataFrame | None = None
    observations: DataFrame | None = None
    grid: DataFrame | None = None
    satellite: DataFrame | None = None


def requested_places(requests: DataFrame, known: DataFrame, code: str = "code") -> DataFrame:
    """One row (location_id, lat, lon) per requested code that resolves; codes asked for repeatedly count once."""
    found = locations.lookup(requests.select(code).distinct(), known, code).filter(F.col("match_kind") != "none")
    return found.select("location_id", "lat", "lon").dropDuplicates(["location_id"])


def station_series(places: DataFrame, table: DataFrame, observations: DataFrame, radius_km: float = 100, k: int = 3,
                   denominator: str = "all") -> DataFrame:
    """Canonical station rows per place: the k nearest stations within the radius, averaged by weight."""
    near = stations.nearest_stations(places, table, radius_km, k)
    weighted = stations.weighted_observations(stations.canonical_observations(observations), near)
    return stations.merge_stations(weighted, denominator=denominator)


def point_rows(places: DataFrame, field: DataFrame, margin: float, lat_ascending: bool = True) -> DataFrame:
    """Rows of the grid point nearest to each place; places without one within `margin` degrees on either axis have none."""
    near = grids.nearest_grid_points(places, field.select("latitude", "longitude"), lat_ascending=lat_ascending)
    inside = (F.abs(F.col("grid_lat") - F.col("lat")) <= margin) & (F.abs(F.col("grid_lon") - F.col("lon")) <= margin)
    return grids.extract_points(field, near.filter(inside))


def short_places(unified: DataFrame, places: DataFrame, min_rows: int) -> DataFrame:
    """Places whose series has fewer than `min_rows` rows, or none."""
    enough = unified.groupBy("location_id").count().filter(F.col("count") >= min_rows).select("location_id")
    return places.join(enough, "location_id", "left_anti")


def normal_rows(places: DataFrame, start: Column, end: Column, step: int = C.STEP_SECONDS) -> DataFrame:
    """A series of climate normals over the job's period, for the given places only."""
    times = F.sequence(start, end, F.expr(f"INTERVAL {step} SECOND"))
    return normals.normal_series(places.select("location_id", "lat", "lon", F.explode(times).alias("ts")))


def collect(requests: DataFrame, known: DataFrame, landed: Landed, start: Column, end: Column, *, code: str = "code",
            stand_in: DataFrame | None = None, min_rows: int = 20, radius_km: float = 100, k: int = 3, margin: float = 0.5,
            lat_ascending: bool = True, mode: str = "column", limit: int | None = 4, snap: str | None = None,
            step: int = C.STEP_SECONDS, chunk: int = series.CHUNK) -> DataFrame:
    """Series of all requested codes between two times: location_id, ts, canonical variables, source_kind.

    A place keeps its merged series ("observed") if that has `min_rows` rows or more. All others get the rows of `stand_in`, or climate
    normals over the period ("fallback"); these are read or made for the places that need them only. Codes without coordinates have no rows.
    The period reaches the scans of the landed tables. The merged series is kept as a table, so it is worked out once.
    """
    places = materialized(requested_places(requests, known, code))
    sources = {}
    if landed.stations is not None and landed.observations is not None:
        sources["stations"] = station_series(places, landed.stations, align.time_range(landed.observations, start, end), radius_km, k)
    if landed.grid is not None:
        rows = point_rows(places, align.time_range(landed.grid, start, end, "valid_time"), margin, lat_ascending)
        sources["reanalysis"] = grids.canonical_reanalysis(rows)
    if landed.satellite is not None:
        rows = point_rows(places, align.time_range(landed.satellite, start, end), margin, lat_ascending)
        sources["satellite"] = grids.canonical_satellite(rows)
    if not sources:
        return normal_rows(places, start, end, step).withColumn("source_kind", F.lit("fallback"))
    unified = materialized(align.unify(sources, limit=limit, mode=mode, snap=snap, step=step, chunk=chunk))
    needed = short_places(unified, places, min_rows)
    other = normal_rows(needed, start, end, step) if stand_in is None else (
        align.time_range(stand_in, start, end).join(needed.select("location_id"), "location_id", "left_semi"))
    kept = unified.join(needed.select("location_id"), "location_id", "left_anti").withColumn("source_kind", F.lit("observed"))
    return kept.unionByName(other.withColumn("source_kind", F.lit("fallback")), allowMissingColumns=True)
