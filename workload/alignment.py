"""Time grids, gap filling, merging of sources, and windows relative to a reference time."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.timegrid import at
from isobar.operators import align
from workload.base import (CHUNK, SOURCE_EXPR, SQL_GRID, cells, merged_cells, query, single, sources, sql_cells, sql_merged, sql_single,
                           sql_sources, table)

START, END = "2024-01-10 00:00:00", "2024-01-12 12:00:00"
REFERENCE = "2024-01-20 06:00:00"


@query(f"""SELECT event_id, ts, event_type, value FROM events
WHERE ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'""")
def scan_time_range(spark, sf):
    return align.time_range(table(spark, sf, "events"), at(START), at(END)).select("event_id", "ts", "event_type", "value")


@query(f"""SELECT event_id, ts, value FROM events
WHERE ts >= TIMESTAMP '{REFERENCE}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{REFERENCE}'""")
def scan_last_days(spark, sf):
    from isobar.sources.tables import read_last
    return read_last(table(spark, sf, "events"), at(REFERENCE), hours=0, days=7).select("event_id", "ts", "value")


def recent_sql(hours, least):
    return f"""WITH {sql_merged(15, 'user_id')},
r AS (SELECT location_id, ts, v FROM merged WHERE ts >= TIMESTAMP '{REFERENCE}' - INTERVAL {hours} HOUR AND ts <= TIMESTAMP '{REFERENCE}')
SELECT location_id, ts, v FROM r WHERE location_id IN (SELECT location_id FROM r GROUP BY 1 HAVING count(*) >= {least})"""


@query(recent_sql(96, 6))
def recent_window(spark, sf):
    return align.recent(merged_cells(spark, sf, by="user_id"), at(REFERENCE), 96, 6).select("location_id", "ts", "v")


@query(recent_sql(24, 2))
def recent_window_short(spark, sf):
    return align.recent(merged_cells(spark, sf, by="user_id"), at(REFERENCE), 24, 2).select("location_id", "ts", "v")


@query(f"""WITH {sql_sources()},
u AS (SELECT location_id, ts FROM stations UNION ALL SELECT location_id, ts FROM reanalysis UNION ALL SELECT location_id, ts FROM satellite)
SELECT location_id, min(ts) AS start_ts, max(ts) AS end_ts FROM u GROUP BY 1""")
def source_extents(spark, sf):
    return align.extents(list(sources(spark, sf).values()))


@query(f"""WITH {sql_sources()}
SELECT location_id, ts FROM stations UNION SELECT location_id, ts FROM reanalysis UNION SELECT location_id, ts FROM satellite""")
def source_timestamps(spark, sf):
    return align.all_timestamps(list(sources(spark, sf).values()))


@query(f"""WITH {sql_merged()},
{SQL_GRID} SELECT location_id, ts FROM grid""")
def time_spine(spark, sf):
    return align.spine(align.extents([merged_cells(spark, sf)]), chunk=CHUNK)


@query(f"""WITH {sql_merged()},
{SQL_GRID} SELECT g.location_id, g.ts, m.v FROM grid g LEFT JOIN merged m ON m.location_id = g.location_id AND m.ts = g.ts""")
def align_on_spine(spark, sf):
    m = merged_cells(spark, sf).select("location_id", "ts", "v")
    return align.reindex(align.spine(align.extents([m]), chunk=CHUNK), m)


def sql_interpolated(source: str, columns: list[str], limit: int | None, out: str = "interp", keep: str = "") -> str:
    """Linear by row number, forward, with a limit; from a frame (location_id, ts, columns)."""
    around, exprs = [], []
    for c in columns:
        at_ = f"CASE WHEN {c} IS NOT NULL THEN i END"
        around.append(f"last_value({c} IGNORE NULLS) OVER b AS {c}_pv, last_value({at_} IGNORE NULLS) OVER b AS {c}_pi, "
                      f"first_value({c} IGNORE NULLS) OVER a AS {c}_nv, first_value({at_} IGNORE NULLS) OVER a AS {c}_ni")
        reach = "" if limit is None else f"OR i - {c}_pi > {limit}"
        exprs.append(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_pi IS NULL {reach} THEN NULL "
                     f"WHEN {c}_ni IS NULL THEN {c}_pv ELSE {c}_pv + ({c}_nv - {c}_pv) * (i - {c}_pi) / ({c}_ni - {c}_pi) END AS {c}")
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY ts) AS i FROM {source}),
{out}_a AS (SELECT *, {', '.join(around)} FROM {out}_n
  WINDOW b AS (PARTITION BY location_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY location_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT location_id, ts, {keep}{', '.join(exprs)} FROM {out}_a)"""


def sql_filled(source: str, columns: list[str], out: str = "filled") -> str:
    """Forward fill, then backward fill."""
    f = ", ".join(f"last_value({c} IGNORE NULLS) OVER b AS {c}" for c in columns)
    g = ", ".join(f"coalesce({c}, first_value({c} IGNORE NULLS) OVER a) AS {c}" for c in columns)
    return f"""{out}_f AS (SELECT location_id, ts, {f} FROM {source}
  WINDOW b AS (PARTITION BY location_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{out} AS (SELECT location_id, ts, {g} FROM {out}_f
  WINDOW a AS (PARTITION BY location_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def singles(df, names):
    return df.select("location_id", "ts", *[single(n).alias(n) for n in names])


def sql_singles(source, names):
    return f"SELECT location_id, ts, {', '.join(f'{sql_single(n)} AS {n}' for n in names)} FROM {source}"


GAPPY = "gappy AS (SELECT location_id, ts, CASE WHEN v >= 20 THEN v END AS v, CASE WHEN k < 60 THEN k END AS k FROM merged)"


def gappy(spark, sf):
    """Hourly cells with many values missing."""
    m = merged_cells(spark, sf, 60, "user_id")
    return m.select("location_id", "ts", F.when(F.col("v") >= 20, F.col("v")).alias("v"), F.when(F.col("k") < 60, F.col("k")).alias("k"))


@query(f"""WITH {sql_merged(60, 'user_id')},
{GAPPY},
{sql_interpolated('gappy', ['v', 'k'], 4)} {sql_singles('interp', ['v', 'k'])}""")
def interpolate_rows(spark, sf):
    return singles(align.interpolate(gappy(spark, sf), ["v", "k"], 4, chunk=32, bucket_seconds=5 * 86400), ["v", "k"])


@query(f"""WITH {sql_merged(60, 'user_id')},
{GAPPY},
{sql_filled('gappy', ['v', 'k'])} SELECT location_id, ts, coalesce(v, 0) AS v, coalesce(k, 0) AS k FROM filled""")
def fill_forward_backward(spark, sf):
    return align.fill_gaps(gappy(spark, sf), ["v", "k"], zero=True, chunk=32, bucket_seconds=5 * 86400)


@query(f"""WITH {sql_merged()},
{SQL_GRID},
raw AS (SELECT g.location_id, g.ts, m.v FROM grid g LEFT JOIN merged m ON m.location_id = g.location_id AND m.ts = g.ts),
{sql_interpolated('raw', ['v'], 4)},
{sql_filled('interp', ['v'])} {sql_singles('filled', ['v'])}""")
def regular_series(spark, sf):
    return singles(align.regular_series(merged_cells(spark, sf), ["v"], chunk=CHUNK), ["v"])


@query(f"""WITH {sql_merged(60)},
hourly AS (SELECT location_id, ts, v / 2 - 20 AS temp_celsius, k * 2 AS relative_humidity_percent FROM merged),
g AS (SELECT location_id, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts
  FROM (SELECT location_id, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1)),
raw AS (SELECT g.location_id, g.ts, h.temp_celsius, h.relative_humidity_percent
  FROM g LEFT JOIN hourly h ON h.location_id = g.location_id AND h.ts = g.ts),
{sql_interpolated('raw', ['temp_celsius', 'relative_humidity_percent'], None)}
SELECT location_id, ts, {sql_single('least(greatest(temp_celsius, -50), 60)')} AS temp_celsius,
  {sql_single('least(greatest(relative_humidity_percent, 0), 100)')} AS relative_humidity_percent FROM interp""")
def upsample_hourly(spark, sf):
    m = merged_cells(spark, sf, 60)
    hourly = m.select("location_id", "ts", (F.col("v") / 2 - 20).alias(C.TEMP), (F.col("k") * 2).alias(C.HUMIDITY))
    return singles(align.upsample(hourly, [C.TEMP, C.HUMIDITY], chunk=CHUNK), [C.TEMP, C.HUMIDITY])


RAIN, SPEED, CLOUD_SHARE = "v * 15 - 100", "k * 2 - 40", "v * 3 - 30"
LIMITED = {C.PRECIP: "precipitation_mm", C.WIND_SPEED: "wind_speed_ms", C.CLOUD: "cloud_cover_percent"}


@query(f"""WITH {sql_merged(60)},
hourly AS (SELECT location_id, ts, {RAIN} AS precipitation_mm, {SPEED} AS wind_speed_ms, {CLOUD_SHARE} AS cloud_cover_percent FROM merged),
g AS (SELECT location_id, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts FROM (SELECT location_id, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1)),
raw AS (SELECT g.location_id, g.ts, {', '.join(f'h.{v}' for v in LIMITED.values())} FROM g LEFT JOIN hourly h ON h.location_id = g.location_id AND h.ts = g.ts),
{sql_interpolated('raw', list(LIMITED.values()), None)}
SELECT 'stations' AS source, location_id, ts, {sql_single('least(greatest(precipitation_mm, 0), 500)')} AS precipitation_mm,
  {sql_single('least(greatest(wind_speed_ms, 0), 100)')} AS wind_speed_ms, {sql_single('least(greatest(cloud_cover_percent, 0), 100)')} AS cloud_cover_percent FROM interp
UNION ALL SELECT 'satellite', location_id, ts, {sql_single('greatest(precipitation_mm, 0)')}, NULL, NULL FROM interp""")
def upsample_limits(spark, sf):
    """Rain above 500 mm is cut for stations and kept for satellites."""
    m = merged_cells(spark, sf, 60)
    hourly = m.select("location_id", "ts", F.expr(RAIN).alias(C.PRECIP), F.expr(SPEED).alias(C.WIND_SPEED), F.expr(CLOUD_SHARE).alias(C.CLOUD))
    station = align.upsample(hourly, list(LIMITED), chunk=CHUNK).select(F.lit("stations").alias("source"), "location_id", "ts", *[single(v).alias(v) for v in LIMITED])
    satellite = align.upsample(hourly, [C.PRECIP], chunk=CHUNK, source="satellite")
    return station.unionByName(
        satellite.select(F.lit("satellite").alias("source"), "location_id", "ts", single(C.PRECIP).alias(C.PRECIP)), allowMissingColumns=True)


OWN_VARIABLES = {s: list(exprs) for s, (_, exprs) in SOURCE_EXPR.items()}


def sql_stack(head: str | None = None, variables: dict[str, list[str]] = OWN_VARIABLES, rows: str = "cells") -> str:
    """All sources on the common grid, columns {source}_{variable}, each interpolated up to four steps."""
    names = [f"{s}_{v}" for s, own in variables.items() for v in own]
    cols = ", ".join(f"{s}.{v} AS {s}_{v}" for s, own in variables.items() for v in own)
    joins = " ".join(f"LEFT JOIN {s} ON {s}.location_id = g.location_id AND {s}.ts = g.ts" for s in variables)
    has = ", ".join(f"bool_or({n} IS NOT NULL) AS has_{n}" for n in names)
    return f"""{head or sql_sources()},
g AS (SELECT location_id, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts
  FROM (SELECT location_id, min(ts) AS lo, max(ts) AS hi FROM {rows} GROUP BY 1)),
raw AS (SELECT g.location_id, g.ts, {cols} FROM g {joins}),
flags AS (SELECT location_id AS flag_location, {has} FROM raw GROUP BY 1),
{sql_interpolated('raw', names, 4)}"""


def sql_choice(mode: str, variables: dict[str, list[str]] = OWN_VARIABLES) -> str:
    names = [f"{s}_{v}" for s, own in variables.items() for v in own]
    out = []
    for t, cand in align.candidates(names).items():
        if mode == "row":
            out.append(f"coalesce({', '.join(cand)}) AS {t}" if len(cand) > 1 else f"{cand[0]} AS {t}")
        else:
            out.append("CASE " + " ".join(f"WHEN has_{c} THEN {c}" for c in cand) + f" END AS {t}")
    return f"chosen AS (SELECT location_id, ts, {', '.join(out)} FROM interp JOIN flags ON flag_location = location_id)"


@query(f"""WITH {sql_stack()},
{sql_choice('column')},
{sql_filled('chosen', C.CANONICAL)} {sql_singles('filled', C.CANONICAL)}""")
def unify_by_column(spark, sf):
    return singles(align.unify(sources(spark, sf), chunk=CHUNK), C.CANONICAL)


@query(f"""WITH {sql_stack()},
{sql_choice('row')},
{sql_filled('chosen', C.CANONICAL)} {sql_singles('filled', C.CANONICAL)}""")
def unify_by_row(spark, sf):
    return singles(align.unify(sources(spark, sf), mode="row", chunk=CHUNK), C.CANONICAL)


@query(f"""WITH ev AS (SELECT event_type AS location_id, ts, event_id, value FROM events),
snapped AS (SELECT location_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_max(value, ts) AS temp_celsius FROM ev GROUP BY 1, 2),
g AS (SELECT location_id, unnest(generate_series(lo, hi, INTERVAL 15 MINUTE)) AS ts
  FROM (SELECT location_id, min(ts) AS lo, max(ts) AS hi FROM snapped GROUP BY 1)),
raw AS (SELECT g.location_id, g.ts, s.temp_celsius FROM g LEFT JOIN snapped s ON s.location_id = g.location_id AND s.ts = g.ts),
{sql_interpolated('raw', ['temp_celsius'], 4)},
{sql_filled('interp', ['temp_celsius'])} {sql_singles('filled', ['temp_celsius'])}""")
def unify_off_grid_rows(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("location_id"), "ts", F.col("value").alias("temperature_celsius"))
    return singles(align.unify({"stations": e}, snap="floor", chunk=CHUNK), [C.TEMP])


@query(f"""WITH {sql_sources()} SELECT location_id, bool_or(temperature_celsius IS NOT NULL) AS has_temperature_celsius,
  bool_or(precipitation_mm IS NOT NULL) AS has_precipitation_mm FROM stations GROUP BY 1""")
def source_availability(spark, sf):
    return align.availability(sources(spark, sf)["stations"], ["temperature_celsius", C.PRECIP])


@query(f"""WITH {sql_cells(15, 'user_id')},
main AS (SELECT location_id, ts, v FROM cells WHERE part <> 1 AND ts < TIMESTAMP '2024-01-12'),
other AS (SELECT location_id, ts, v FROM cells WHERE ts >= TIMESTAMP '2024-01-12'),
ok AS (SELECT location_id FROM main GROUP BY 1 HAVING count(*) >= 20)
SELECT location_id, ts, v, 'observed' AS source_kind FROM main WHERE location_id IN (SELECT location_id FROM ok)
UNION ALL SELECT location_id, ts, v, 'fallback' FROM other WHERE location_id NOT IN (SELECT location_id FROM ok)""")
def fallback_series(spark, sf):
    c = cells(spark, sf, 15, "user_id")
    split = at("2024-01-12 00:00:00")
    main = c.filter((F.col("part") != 1) & (F.col("ts") < split)).select("location_id", "ts", "v")
    other = c.filter(F.col("ts") >= split).select("location_id", "ts", "v")
    return align.with_fallback(main, other, 20)


@query(f"""WITH {sql_cells()} SELECT location_id, ts, part, v FROM cells""")
def stack_frames(spark, sf):
    c = cells(spark, sf).select("ts", "part", "v", "location_id")
    kinds = [r.location_id for r in c.select("location_id").distinct().collect()]
    return align.stack_locations({k: c.filter(F.col("location_id") == k).drop("location_id") for k in kinds})


@query(f"""WITH {sql_merged(15, 'user_id')} SELECT location_id, count(*) AS n_rows, count(*) >= 48 AS enough FROM merged GROUP BY 1""")
def rows_per_location(spark, sf):
    return align.row_counts(merged_cells(spark, sf, 15, "user_id"), min_rows=48)


@query(f"""WITH {sql_merged(15, 'user_id')},
r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY ts DESC) AS rn, count(*) OVER (PARTITION BY location_id) AS n FROM merged)
SELECT location_id, ts, v FROM r WHERE rn <= 24 AND n >= 24""")
def last_rows(spark, sf):
    return align.latest(merged_cells(spark, sf, 15, "user_id"), 24, complete_only=True).select("location_id", "ts", "v")


@query(f"""WITH {sql_merged(15, 'user_id')}
SELECT location_id, max(ts) AS ts, arg_max(v, ts) AS v FROM merged GROUP BY 1""")
def newest_row(spark, sf):
    return align.latest(merged_cells(spark, sf, 15, "user_id"), 1).select("location_id", "ts", "v")
