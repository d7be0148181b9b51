"""Regular time grids: spine, alignment, gap filling, and the merging of several sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.physics import clip_columns
from isobar.functions.timegrid import floor_to, plus_seconds, sql_floor, sql_plus, sql_seconds
from isobar.operators import series

KEYS = ["location_id"]


def extents(sources: Sequence[DataFrame], keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """First and last timestamp of each key over all sources."""
    stamps = [s.select(*keys, ts) for s in sources]
    return (
        reduce(DataFrame.unionByName, stamps)
        .groupBy(*keys)
        .agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    )


def all_timestamps(sources: Sequence[DataFrame], keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Distinct timestamps of each key over all sources."""
    return reduce(DataFrame.unionByName, [s.select(*keys, ts) for s in sources]).distinct()


def _bounds(ext: DataFrame, keys: Sequence[str], step: int, anchor: str) -> DataFrame:
    """Grid of each key: positions count steps from ``_origin``, from 0 to ``_last``."""
    origins = {"start": "start_ts", "midnight": sql_floor("start_ts", step)}
    if anchor not in origins:
        raise ValueError(f"anchor must be 'start' or 'midnight', not {anchor!r}")
    steps = f"(({sql_seconds('end_ts')} - {sql_seconds('_origin')}) div {step})"
    # A fraction of a second can put the last grid point just behind the end.
    beyond = f"IF({sql_plus('_origin', f'{steps} * {step}')} > end_ts, 1, 0)"
    others = [c for c in ext.columns if c not in (*keys, "start_ts", "end_ts")]
    return ext.withColumn("_origin", F.expr(origins[anchor])).selectExpr(
        *keys, "_origin", f"{steps} - {beyond} AS _last", *others)


def spine(ext: DataFrame, keys: Sequence[str] = KEYS, step: int = C.STEP_SECONDS, anchor: str = "start",
          chunk: int = series.CHUNK) -> DataFrame:
    """All grid timestamps from ``start_ts`` to ``end_ts`` of each key, both ends included."""
    c = series.CHUNK_COL
    return (
        _bounds(ext, keys, step, anchor)
        .selectExpr("*", f"explode(sequence(0L, {series.sql_chunk('_last', chunk)})) AS {c}")
        .repartition(*keys, c)
        .selectExpr(*keys, "_origin", f"explode(sequence({c} * {chunk}, least(_last, {c} * {chunk} + {chunk - 1}))) AS _tick")
        .selectExpr(*keys, f"{_sql_grid_time(step)} AS ts")
    )


def reindex(grid: DataFrame, source: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Put a source on a grid: rows of the source off the grid vanish, grid rows without data are null."""
    return grid.join(source, [*keys, ts], "left")


def on_grid(rows: DataFrame, bounds: DataFrame, values: Sequence[str], keys: Sequence[str], ts: str, step: int) -> DataFrame:
    """Rows with their grid position ``_tick`` and the columns of ``bounds``.

    A row whose timestamp is not exactly a grid point loses its values.
    """
    tick = f"cast(floor(({sql_seconds(ts)} - {sql_seconds('_origin')}) / {step}) as bigint)"
    others = [c for c in bounds.columns if c not in keys]
    return (
        rows.join(bounds, list(keys))
        .selectExpr(*keys, ts, *others, f"{tick} AS _tick", *values)
        .selectExpr(*keys, *others, "_tick", f"{_sql_grid_time(step)} = {ts} AS _exact", *values)
        .selectExpr(*keys, *others, "_tick", *[f"IF(_exact, {v}, NULL) AS {v}" for v in values])
    )


def snapped(df: DataFrame, snap: str | None, keys: Sequence[str] = KEYS, ts: str = "ts",
            step: int = C.STEP_SECONDS) -> DataFrame:
    """Move timestamps to the grid: None leaves them; of several rows in a step the latest known value counts."""
    if snap is None:
        return df
    if snap not in ("floor", "nearest"):
        raise ValueError(f"snap must be None, 'floor' or 'nearest', not {snap!r}")
    shifted = ts if snap == "floor" else sql_plus(ts, str(step // 2))
    values = [c for c in df.columns if c not in (*keys, ts)]
    return (
        df.withColumn("_cell", floor_to(shifted, step))
        .groupBy(*keys, F.col("_cell"))
        .agg(*[F.expr(f"max_by({v}, CASE WHEN {v} IS NOT NULL THEN {ts} END) AS {v}") for v in values])
        .withColumnRenamed("_cell", ts)
        .select(*df.columns)
    )


def _on_spine(placed: DataFrame, values: Sequence[str], keys: Sequence[str], chunk: int) -> DataFrame:
    """One row per grid point with the known values around it."""
    return series.neighbours(placed, keys, "_tick", values, chunk, "_last", ["_origin"])


def _sql_grid_time(step: int) -> str:
    return sql_plus("_origin", f"_tick * {step}")


def upsample(df: DataFrame, values: Sequence[str], limits: Mapping | None = None, keys: Sequence[str] = KEYS,
             ts: str = "ts", step: int = C.STEP_SECONDS, chunk: int = series.CHUNK, source: str = "stations") -> DataFrame:
    """Bring a coarser series to the grid by linear interpolation of any gap, then clip to the physical limits of its source.

    Satellite rain has no upper limit. The grid is anchored at midnight; timestamps off it are ignored.
    """
    bounds = _bounds(extents([df], keys, ts).withColumn("end_ts", floor_to("end_ts", step)), keys, step, "midnight")
    around = _on_spine(on_grid(df, bounds, values, keys, ts, step), values, keys, chunk)
    filled = around.selectExpr(
        *keys, f"{_sql_grid_time(step)} AS {ts}", *[f"{series.sql_interpolated(v, '_tick')} AS {v}" for v in values],
    )
    known = C.SATELLITE_LIMITS if source == "satellite" else C.LIMITS
    return clip_columns(filled, known if limits is None else limits)


def interpolate(df: DataFrame, values: Sequence[str], limit: int | None = 4, keys: Sequence[str] = KEYS,
                ts: str = "ts", fill: str = "none", bucket_seconds: int = 30 * 86400,
                chunk: int = series.CHUNK) -> DataFrame:
    """Fill gaps of an irregular series by row position.

    ``fill``: "none" leaves what the limit does not reach, "both" holds values forward and then
    takes the first known value for leading gaps, "zero" also puts 0 where nothing is known at all.
    """
    numbered = series.row_positions(
        df.select(*keys, ts, *values), keys, [F.col(ts)], series.chunk_of(sql_seconds(ts), bucket_seconds), "_pos",
    )
    around = series.neighbours(numbered, keys, "_pos", values, chunk, carried=[ts])
    return around.selectExpr(*keys, ts, *[f"{_sql_filled(v, '_pos', limit, fill)} AS {v}" for v in values])


def _sql_filled(v: str, pos: str, limit: int | None, fill: str) -> str:
    if fill == "none":
        return series.sql_interpolated(v, pos, limit)
    held = f"{series.sql_interpolated_and_held(v, pos, limit)}, {v}__nv"
    return f"coalesce({held}, 0)" if fill == "zero" else f"coalesce({held})"


def fill_gaps(df: DataFrame, values: Sequence[str], keys: Sequence[str] = KEYS, ts: str = "ts", zero: bool = False,
              bucket_seconds: int = 30 * 86400, chunk: int = series.CHUNK) -> DataFrame:
    """Forward fill, then backward fill, then optionally 0."""
    return interpolate(df, values, 0, keys, ts, "zero" if zero else "both", bucket_seconds, chunk)


def regular_series(df: DataFrame, values: Sequence[str], limit: int | None = 4, fill: str = "both",
                   keys: Sequence[str] = KEYS, ts: str = "ts", step: int = C.STEP_SECONDS, anchor: str = "start",
                   chunk: int = series.CHUNK) -> DataFrame:
    """Spine, alignment and gap filling of one source."""
    bounds = _bounds(extents([df], keys, ts), keys, step, anchor)
    around = _on_spine(on_grid(df, bounds, values, keys, ts, step), values, keys, chunk)
    return around.selectExpr(
        *keys, f"{_sql_grid_time(step)} AS {ts}", *[f"{_sql_filled(v, '_tick', limit, fill)} AS {v}" for v in values],
    )


def availability(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether a key has any value in each column, as ``has_{column}``."""
    return rows.groupBy(*keys).agg(*[F.expr(f"bool_or({c} IS NOT NULL) AS has_{c}") for c in columns])


def stack_sources(sources: Mapping[str, DataFrame], keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Rows of all sources, each variable under ``{source}_{variable}``."""
    parts = []
    for name, df in sources.items():
        known = [v for v in C.SOURCE_VARIABLES[name] if v in df.columns]
        parts.append(df.selectExpr(*keys, ts, *[f"cast({v} as double) AS {name}_{v}" for v in known]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def candidates(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns that can supply each canonical variable, preferred first."""
    found = {}
    for target in C.CANONICAL:
        names = [f"{s}_{v}" for s, v in C.SOURCE_PRIORITY[target]]
        names = [n for n in names if n in columns]
        if names:
            found[target] = names
    return found


def sql_prefer_available(names: Sequence[str]) -> str:
    """The first column that its key has at all; needs the flags of ``availability``."""
    return "CASE " + " ".join(f"WHEN has_{n} THEN {n}" for n in names) + " END"


def unify(sources: Mapping[str, DataFrame], limit: int | None = 4, mode: str = "column",
          snap: str | None = None, fill: bool = True, keys: Sequence[str] = KEYS, ts: str = "ts",
          step: int = C.STEP_SECONDS, anchor: str = "start", chunk: int = series.CHUNK) -> DataFrame:
    """Merge sources into one regular series per key with the canonical variables.

    Sources are named "stations", "reanalysis" or "satellite". In mode "column" a key takes a
    variable wholly from its preferred source if that source knows it at all; in mode "row" the
    other source fills in where the preferred one has nothing.
    """
    sources = {name: snapped(df, snap, keys, ts, step) for name, df in sources.items()}
    rows = stack_sources(sources, keys, ts)
    choice = candidates(rows.columns)
    used = sorted({c for names in choice.values() for c in names})

    facts = rows.groupBy(*keys).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
        *[F.expr(f"bool_or({c} IS NOT NULL) AS has_{c}") for c in used],
    )
    bounds = _bounds(facts, keys, step, anchor)
    placed = on_grid(rows, bounds, used, keys, ts, step)
    if mode == "row":
        around = _on_spine(placed, used, keys, chunk)
        final = {t: _sql_first_known(names, limit, fill) for t, names in choice.items()}
    elif mode == "column":
        picked = placed.selectExpr(
            *keys, "_origin", "_last", "_tick", *[f"{sql_prefer_available(names)} AS {t}" for t, names in choice.items()],
        )
        around = _on_spine(picked, list(choice), keys, chunk)
        final = {t: _sql_filled(t, "_tick", limit, "both" if fill else "none") for t in choice}
    else:
        raise ValueError(f"mode must be 'column' or 'row', not {mode!r}")
    return around.selectExpr(*keys, f"{_sql_grid_time(step)} AS {ts}", *[f"{e} AS {t}" for t, e in final.items()])


def _sql_first_known(names: Sequence[str], limit: int | None, fill: bool) -> str:
    here = ", ".join(series.sql_interpolated(n, "_tick", limit) for n in names)
    if not fill:
        return f"coalesce({here})"
    # The last position each column reaches, and what it holds there; ties go to the preferred column.
    held, ahead = [], []
    for rank, n in enumerate(names):
        reach = "_tick" if limit is None else f"least(_tick, {n}__pp + {limit})"
        value = series.sql_interpolated_and_held(n, "_tick", limit)
        held.append(f"CASE WHEN {n}__pp IS NOT NULL THEN named_struct('at', {reach}, 'rank', {-rank}, 'v', {value}) END")
        ahead.append(f"CASE WHEN {n}__np IS NOT NULL THEN named_struct('at', {n}__np, 'rank', {rank}, 'v', {n}__nv) END")
    if len(names) == 1:
        return f"coalesce({here}, ({held[0]}).v, {names[0]}__nv)"
    return f"coalesce({here}, greatest({', '.join(held)}).v, least({', '.join(ahead)}).v)"


def with_fallback(primary: DataFrame, fallback: DataFrame, min_rows: int = 20, keys: Sequence[str] = KEYS,
                  kinds: tuple[str, str] = ("observed", "fallback")) -> DataFrame:
    """Keys with at least ``min_rows`` rows keep their series, all others take the fallback series."""
    enough = primary.groupBy(*keys).count().filter(F.col("count") >= min_rows).select(*keys)
    kept = primary.join(enough, list(keys), "left_semi").withColumn("source_kind", F.lit(kinds[0]))
    other = fallback.join(enough, list(keys), "left_anti").withColumn("source_kind", F.lit(kinds[1]))
    return kept.unionByName(other, allowMissingColumns=True)


def stack_locations(frames: Mapping[str, DataFrame], key: str = "location_id") -> DataFrame:
    """Rows of one frame per location, with the location as a column."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn(key, F.lit(name)) for name, df in frames.items()],
    )


def recent(df: DataFrame, reference: Column, hours: float, min_rows: int = 0, keys: Sequence[str] = KEYS,
           ts: str = "ts", until_reference: bool = True) -> DataFrame:
    """Rows of the last hours before a reference time, for keys that have enough of them."""
    since = F.col(ts) >= plus_seconds(reference, int(-hours * 3600))
    window = df.filter(since & (F.col(ts) <= reference)) if until_reference else df.filter(since)
    if min_rows <= 0:
        return window
    enough = window.groupBy(*keys).count().filter(F.col("count") >= min_rows).select(*keys)
    return window.join(enough, list(keys), "left_semi")


def time_range(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).between(start, end))


def row_counts(df: DataFrame, keys: Sequence[str] = KEYS, min_rows: int = 0) -> DataFrame:
    """Rows per key, with whether they suffice."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("enough", F.col("n_rows") >= min_rows)


def latest(df: DataFrame, n: int = 1, keys: Sequence[str] = KEYS, ts: str = "ts",
           complete_only: bool = False) -> DataFrame:
    """The last n rows of each key; ``complete_only`` drops keys that have fewer."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(ts))
    top = df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n)
    if complete_only:
        top = top.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("_n") == n).drop("_n")
    return top.drop("_rn")
