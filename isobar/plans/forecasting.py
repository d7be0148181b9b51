"""Forecast jobs for many locations at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions import physics
from isobar.operators import align, features, locations, present, scaling, series
from isobar.plans.stage import materialized
from isobar.plans.training import Forecaster, score
INVALID, UNKNOWN, NO_DATA = C.ERROR_INVALID, C.ERROR_UNKNOWN, C.ERROR_NO_DATA


def prediction_input(recent: DataFrame, stats: DataFrame | Mapping, names: Sequence[str],
                     steps: int = C.INPUT_STEPS, regular: bool = True, chunk: int = series.CHUNK) -> DataFrame:
    """Scaled features of the last rows of each location that has enough of them.

    Only these rows and the few that their features look back at go on: each task keeps its newest before the shuffle.
    """
    newest = align.latest(recent, steps + C.PRESSURE_TENDENCY_STEPS)
    rows = features.model_features(newest, regular=regular, chunk=chunk)
    found = features.expected_columns(rows, names)
    scaled = scaling.normalize(rows, stats, found)
    return align.latest(scaled, steps, complete_only=True)


def latest_features(df: DataFrame, stats: DataFrame | Mapping, names: Sequence[str], regular: bool = False,
                    chunk: int = series.CHUNK) -> DataFrame:
    """The newest row of each location with the model's features, numeric ones scaled.

    Features are worked out on as many rows as the longest of them looks back at.
    """
    reach = max(C.PRESSURE_TENDENCY_STEPS, *C.LAGS, *C.WINDOWS, *C.DIFFS)
    wide = features.all_features(align.latest(df, reach + 1), regular=regular, chunk=chunk)
    found = features.expected_columns(wide, names)
    newest = align.latest(wide.select("location_id", "ts", *found), 1)
    return scaling.normalize(newest, stats, features.numeric_columns(newest, ["location_id"]))


def resolve_requests(requests: DataFrame, all_locations: DataFrame, served: DataFrame, code: str = "code") -> DataFrame:
    """Every request with ``match_kind``, coordinates, the ``place`` whose series answers it (null if none) and ``error``.

    Several requests may have one place. A known code is its own place; a code known by its prefix alone has the prefix's
    coordinates, and of the locations in ``served`` (location_id) the one nearest to them, by name among equals, is its place.
    A code that is not of five characters has no place, however its padded form would resolve. Repeated requests stay.
    """
    located = all_locations.join(served.select("location_id").distinct(), "location_id", "left_semi")
    nearest = located.agg(*[
        F.min(F.struct(physics.great_circle_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)), "location_id"))["location_id"].alias(p)
        for p, (lat, lon) in C.PREFIX_COORDINATES.items()
    ]).first()
    placed = locations.lookup(requests, all_locations, code)
    by_prefix = F.lit(None).cast("string")
    for p in C.PREFIX_COORDINATES:
        by_prefix = F.when(F.substring("location_id", 1, 2) == p, F.lit(nearest[p])).otherwise(by_prefix)
    valid = locations.valid_code(F.col(code))
    place = F.when(F.col("match_kind") == "exact", F.col("location_id")).when(F.col("match_kind") == "prefix", by_prefix)
    error = F.when(~valid, INVALID).when(F.col("match_kind") == "none", F.concat(F.lit(UNKNOWN), F.col(code)))
    return placed.withColumns({"error": error, "place": F.when(valid, place)}).drop("location_id")


def forecast(requests: DataFrame, all_locations: DataFrame, recent: DataFrame, model: Forecaster,
             stats: DataFrame | Mapping, names: Sequence[str], targets: Sequence[str] = C.TARGETS,
             code: str = "code", regular: bool = True, chunk: int = series.CHUNK) -> DataFrame:
    """Formatted forecast steps for the requested codes, at the coordinates of each request.

    Each place is worked out once, for all its requests. A code that is malformed, unknown or without enough recent data
    gives one row with its ``error``.
    """
    known_stats = stats if isinstance(stats, Mapping) else scaling.stats_by_name(stats)
    asked = materialized(resolve_requests(requests.select(code).distinct(), all_locations, recent, code))
    places = asked.select(F.col("place").alias("location_id")).filter("location_id is not null").distinct()
    inputs = prediction_input(recent.join(places, "location_id", "left_semi"), known_stats, names, regular=regular, chunk=chunk)
    origin = align.latest(inputs, 1).withColumnRenamed("ts", "origin_ts")
    scored = scaling.denormalize(score(model, origin, targets), known_stats, targets).withColumnRenamed("location_id", "place")
    steps = present.format_forecast(
        scored.join(asked.filter("place is not null").select(F.col(code).alias("location_id"), "place", "lat", "lon"), "place"))
    out = asked.select(code, "place", "error").join(steps.withColumnRenamed("location_id", code), code, "left")
    missing = F.when(F.col("error").isNull() & F.col("horizon").isNull(), NO_DATA)
    return out.withColumn("error", F.coalesce("error", missing)).withColumnRenamed("place", "location_id")
