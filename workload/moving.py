"""Features that look back along a series."""

from __future__ import annotations

from isobar import constants as C
from isobar.operators import align, features
from pyspark.sql import functions as F
from workload.base import CHUNK, SQL_GRID, digits, merged_cells, observed, query, single, sql_digits, sql_merged, sql_observed, sql_single

LAYOUT = {"regular": True, "chunk": CHUNK}
WATCHED = [C.TEMP, C.HUMIDITY]
# Values that are nearly 0 by cancellation are compared by absolute rounding, all others at single precision.
ABSOLUTE = ("_std_", "_diff_", "_rate_", "change")


def shown(df, names):
    return df.select("location_id", "ts", *[
        (digits(n) if any(m in n for m in ABSOLUTE) else single(n)).alias(n) for n in names])


def sql_shown(exprs: dict[str, str]) -> str:
    return ", ".join(
        f"{sql_digits(e) if any(m in n for m in ABSOLUTE) else sql_single(e)} AS {n}" for n, e in exprs.items())


W = "PARTITION BY location_id ORDER BY ts"


def sql_lag(v, k):
    return f"lag({v}, {k}) OVER ({W})"


def sql_full(agg, v, n):
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({v}) {frame} = {n} THEN {agg}({v}) {frame} END"


def sql_lags(vs):
    return {f"{v}_lag_{k}": sql_lag(v, k) for v in vs for k in C.LAGS}


def sql_rolling(vs):
    aggs = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return {f"{v}_rolling_{a}_{n}": sql_full(f, v, n) for v in vs for n in C.WINDOWS for a, f in aggs.items()}


def sql_cumulative(vs):
    return {f"{v}_{a}_{n}": sql_full(f, v, n) for v in vs for n in C.WINDOWS for a, f in (("cumsum", "sum"), ("cummean", "avg"))}


def sql_differences(vs):
    out = {}
    for v in vs:
        for d in C.DIFFS:
            out[f"{v}_diff_{d}"] = f"{v} - {sql_lag(v, d)}"
            out[f"{v}_rate_{d}"] = f"({v} - {sql_lag(v, d)}) / {d}"
    return out


def family(name, make_sql):
    exprs = make_sql(WATCHED)

    def run(spark, sf):
        df = observed(spark, sf).select("location_id", "ts", *WATCHED)
        return shown(features.moving_features(df, WATCHED, [name], **LAYOUT), list(exprs))

    run.__name__ = f"{name}_features"
    query(f"WITH {sql_observed()} SELECT location_id, ts, {sql_shown(exprs)} FROM observed")(run)


family("lag", sql_lags)
family("rolling", sql_rolling)
family("cumulative", sql_cumulative)
family("difference", sql_differences)


@query(f"""WITH {sql_merged(15, 'user_id')}
SELECT location_id, ts, {sql_shown({**sql_lags(['v']), **sql_rolling(['v']), **sql_differences(['v'])})} FROM merged""")
def irregular_features(spark, sf):
    """Rows at irregular times: frames count rows, not minutes."""
    df = merged_cells(spark, sf, by="user_id").select("location_id", "ts", "v")
    out = features.moving_features(df, ["v"], ["lag", "rolling", "difference"], chunk=32, bucket_seconds=5 * 86400)
    return shown(out, [c for c in out.columns if c.startswith("v_")])


LONG = [48, 49, 960]
SQL_LONG = {f"v_{a}_{n}": sql_full(f, "v", n) for n in LONG for a, f in (
    ("rolling_mean", "avg"), ("rolling_std", "stddev_samp"), ("rolling_min", "min"), ("rolling_max", "max"), ("cumsum", "sum"))}


@query(f"""WITH {sql_merged()}, {SQL_GRID}, s AS (SELECT g.location_id, g.ts, m.v FROM grid g LEFT JOIN merged m ON m.location_id = g.location_id AND m.ts = g.ts),
w AS (SELECT location_id, ts, CASE WHEN hour(ts) <> 5 OR day(ts) % 12 <> 3 THEN last_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS v FROM s)
SELECT location_id, ts, {sql_shown(SQL_LONG)} FROM w""")
def long_windows(spark, sf):
    """Windows of half a day, one row more, and ten days, longer than a chunk; an hour without values empties those that hold it."""
    filled = align.regular_series(merged_cells(spark, sf).select("location_id", "ts", "v"), ["v"], limit=0, chunk=CHUNK)
    gaps = filled.select("location_id", "ts", F.expr("CASE WHEN hour(ts) <> 5 OR day(ts) % 12 <> 3 THEN v END AS v"))
    return shown(features.moving_features(gaps, ["v"], ["rolling", "cumulative"], windows=LONG, periods=LONG, **LAYOUT), list(SQL_LONG))


@query(f"""WITH {sql_observed()} SELECT location_id, ts, {sql_shown({'pressure_change_3h': f"pressure_hpa - {sql_lag('pressure_hpa', 12)}"})} FROM observed""")
def pressure_tendency(spark, sf):
    df = observed(spark, sf).select("location_id", "ts", C.PRESSURE)
    return shown(features.over_series(df, features.pressure_tendency, 12, **LAYOUT), ["pressure_change_3h"])


SQL_CALENDAR = {
    "hour": "hour(ts)", "day_of_week": "isodow(ts) - 1", "month": "month(ts)", "day_of_year": "dayofyear(ts)",
}
SQL_CYCLIC = {f"{n}_{f}": f"{f}(2 * pi() * {e})" for n, e in {
    "hour": "hour(ts) / 24.0::DOUBLE", "dow": "(isodow(ts) - 1) / 7.0::DOUBLE", "month": "(month(ts) - 1) / 12.0::DOUBLE"}.items()
    for f in ("sin", "cos")}
SQL_SEASON = "CASE WHEN month(ts) <= 3 THEN 'winter' WHEN month(ts) <= 6 THEN 'spring' WHEN month(ts) <= 9 THEN 'summer' ELSE 'fall' END"

T, H, S = C.TEMP, C.HUMIDITY, C.WIND_SPEED
SQL_HEAT = (f"-8.78469475556 + 1.61139411 * {T} + 2.33854883889 * {H} - 0.14611605 * {T} * {H} - 0.012308094 * {T} * {T} "
            f"- 0.01642482778 * {H} * {H} + 0.002211732 * {T} * {T} * {H} + 0.00072546 * {T} * {H} * {H} "
            f"- 0.000003582 * {T} * {T} * {H} * {H}")
SQL_ALPHA = f"(CASE WHEN {H} > 0 THEN ln({H} / 100) END + 17.625 * {T} / (243.04 + {T}))"
SQL_WEATHER = {
    "heat_index": SQL_HEAT,
    "dewpoint_approx": f"243.04 * {SQL_ALPHA} / (17.625 - {SQL_ALPHA})",
    "wind_chill": f"CASE WHEN {T} < 10 AND {S} > 1.3 THEN 13.12 + 0.6215 * {T} - 11.37 * pow({S}, 0.16) + 0.3965 * {T} * pow({S}, 0.16) ELSE {T} END",
    "pressure_change_3h": f"pressure_hpa - {sql_lag('pressure_hpa', 12)}",
    "precip_intensity": "precipitation_mm * 4",
}
PRECIP = "precipitation_mm * 4"
SQL_PRECIP = {
    "precip_no_rain": f"{PRECIP} = 0", "precip_light_rain": f"{PRECIP} <> 0 AND {PRECIP} < 2.5",
    "precip_moderate_rain": f"{PRECIP} >= 2.5 AND {PRECIP} < 7.6", "precip_heavy_rain": f"{PRECIP} >= 7.6",
    "precip_unknown": f"{PRECIP} IS NULL",
}
SQL_CLOUD = {
    "cloud_clear": "cloud_cover_percent < 25", "cloud_partly_cloudy": "cloud_cover_percent >= 25 AND cloud_cover_percent < 50",
    "cloud_mostly_cloudy": "cloud_cover_percent >= 50 AND cloud_cover_percent < 75", "cloud_overcast": "cloud_cover_percent >= 75",
    "cloud_unknown": "cloud_cover_percent IS NULL",
}


def flags(exprs):
    return ", ".join(f"CAST(coalesce({e}, false) AS INTEGER) AS {n}" for n, e in exprs.items())


INTEGERS = [*SQL_CALENDAR, *[f"season_{s}" for s in C.SEASONS], *SQL_PRECIP, *SQL_CLOUD]


def all_sql(vs):
    moving = {**sql_lags(vs), **sql_rolling(vs), **sql_cumulative(vs), **sql_differences(vs)}
    seasons = ", ".join(f"CAST({SQL_SEASON} = '{s}' AS INTEGER) AS season_{s}" for s in C.SEASONS)
    cal = ", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in SQL_CALENDAR.items())
    cyc = ", ".join(f"{sql_digits(e)} AS {n}" for n, e in SQL_CYCLIC.items())
    weather = ", ".join(f"{sql_digits(e)} AS {n}" for n, e in SQL_WEATHER.items())
    base = ", ".join(f"{sql_single(v)} AS {v}" for v in C.CANONICAL)
    return (f"WITH {sql_observed()} SELECT location_id, ts, {base}, {cal}, {cyc}, {SQL_SEASON} AS season, {seasons}, "
            f"{sql_shown(moving)}, {weather}, {flags(SQL_PRECIP)}, {flags(SQL_CLOUD)} FROM observed")


@query(all_sql(C.CANONICAL))
def all_features(spark, sf):
    out = features.all_features(observed(spark, sf), **LAYOUT)
    rounded = [*SQL_CYCLIC, *SQL_WEATHER]
    return out.select("location_id", "ts", "season", *INTEGERS, *[
        (digits(n) if n in rounded or any(m in n for m in ABSOLUTE) else single(n)).alias(n)
        for n in out.columns if n not in ("location_id", "ts", "season", *INTEGERS)])


MODEL_SQL = {
    **{v: v for v in C.BASE_FEATURES},
    **{n: SQL_CYCLIC[n] for n in C.CYCLIC_FEATURES},
    **{f"{v}_lag_{k}": sql_lag(v, k) for v in C.BASE_FEATURES[:3] for k in (1, 2)},
    "heat_index": SQL_HEAT, "pressure_change_3h": SQL_WEATHER["pressure_change_3h"],
    **{f"{v}_diff_1": f"{v} - {sql_lag(v, 1)}" for v in (C.TEMP, C.HUMIDITY)},
}


def sql_model(name: str = "model") -> str:
    return f"{sql_observed()},\n{name} AS (SELECT location_id, ts, {', '.join(f'{e} AS {n}' for n, e in MODEL_SQL.items())} FROM observed)"


@query(f"WITH {sql_model()} SELECT location_id, ts, {', '.join(f'{sql_digits(n)} AS {n}' for n in MODEL_SQL)} FROM model")
def model_features(spark, sf):
    out = features.model_features(observed(spark, sf), **LAYOUT)
    return out.select("location_id", "ts", *[digits(n).alias(n) for n in out.columns[2:]])
