"""Calendar, physics, classes and normals, row by row."""

from __future__ import annotations

from isobar import constants as C
from isobar.functions import calendar, categories, normals, physics
from pyspark.sql import functions as F
from workload.base import digits, place, query, sql_digits, sql_place, table
from workload.moving import SQL_CALENDAR, SQL_CYCLIC, SQL_SEASON, flags


@query(f"""SELECT event_id, {', '.join(f'CAST({e} AS INTEGER) AS {n}' for n, e in SQL_CALENDAR.items())},
{', '.join(f'{sql_digits(e)} AS {n}' for n, e in SQL_CYCLIC.items())}, {SQL_SEASON} AS season,
{', '.join(f"CAST({SQL_SEASON} = '{s}' AS INTEGER) AS season_{s}" for s in C.SEASONS)}
FROM (SELECT o_orderkey AS event_id, o_orderdate + to_hours(o_orderkey % 24) AS ts FROM orders)""")
def calendar_features(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.timestamp_add("HOUR", F.pmod("o_orderkey", F.lit(24)), F.col("o_orderdate")).alias("ts"))
    out = df.select("event_id", *[e.alias(n) for n, e in calendar.temporal().items()])
    return out.select("event_id", *[(digits(n) if n in SQL_CYCLIC else F.col(n)).alias(n) for n in out.columns[1:]])


# Weather-like numbers of an order line.
LINE = {
    "t": "l_quantity - 20", "h": "l_discount * 1000", "s": "l_tax * 100 + l_linenumber", "p": "800 + l_quantity * 8",
    "u": "l_linenumber - 4 + l_discount", "w": "l_quantity / 10 - 2.53",
}


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", *[F.expr(e).cast("double").alias(n) for n, e in LINE.items()])


SQL_LINES = ("lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
             + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in LINE.items()) + " FROM lineitem)")
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
SQL_KEY = ", ".join(KEY)

SQL_ALPHA = "(CASE WHEN h > 0 THEN ln(h / 100) END + 17.625 * t / (243.04 + t))"
SQL_DIRECTION = "(degrees(atan2(w, u)) + 360) % 360"
PHYSICS = {
    "heat_index": ("-8.78469475556 + 1.61139411 * t + 2.33854883889 * h - 0.14611605 * t * h - 0.012308094 * t * t - 0.01642482778 * h * h "
                   "+ 0.002211732 * t * t * h + 0.00072546 * t * h * h - 0.000003582 * t * t * h * h"),
    "dewpoint": f"243.04 * {SQL_ALPHA} / (17.625 - {SQL_ALPHA})",
    "humidity": "100 * exp(17.625 * (t - 3) / (243.04 + t - 3)) / exp(17.625 * t / (243.04 + t))",
    "wind_chill": "CASE WHEN t < 10 AND s > 1.3 THEN 13.12 + 0.6215 * t - 11.37 * pow(s, 0.16) + 0.3965 * t * pow(s, 0.16) ELSE t END",
    "wind_chill_kmh": "CASE WHEN t < 10 AND s > 1.3 THEN 13.12 + 0.6215 * t - 11.37 * pow(s * 3.6, 0.16) + 0.3965 * t * pow(s * 3.6, 0.16) ELSE t END",
    "wind_speed": "sqrt(u * u + w * w)",
    "wind_direction": SQL_DIRECTION,
    "wind_from": "(degrees(atan2(u, w)) + 180) % 360",
}


@query(f"""WITH {SQL_LINES} SELECT {SQL_KEY}, {', '.join(f'{sql_digits(e, 5)} AS {n}' for n, e in PHYSICS.items())} FROM lines""")
def physics_formulas(spark, sf):
    t, h, s, u, w = (F.col(c) for c in "thsuw")
    out = {
        "heat_index": physics.heat_index(t, h), "dewpoint": physics.dewpoint(t, h),
        "humidity": physics.humidity_from_dewpoint(t, t - 3), "wind_chill": physics.wind_chill(t, s),
        "wind_chill_kmh": physics.wind_chill(t, s, "kmh"), "wind_speed": physics.wind_speed(u, w),
        "wind_direction": physics.wind_direction(u, w), "wind_from": physics.wind_direction(u, w, "meteorological"),
    }
    return lines(spark, sf).select(*KEY, *[digits(e, 5).alias(n) for n, e in out.items()])


@query(f"""WITH {SQL_LINES} SELECT {SQL_KEY}, {sql_digits('t + 300 - 273.15')} AS celsius, {sql_digits('p * 100 / 100')} AS hpa,
{sql_digits('s * 1000 / 3600')} AS ms, {sql_digits('s * 4')} AS mm_per_hour, least(greatest(t * 3, -50), 60) AS temp_celsius,
least(greatest(h * 2 - 10, 0), 100) AS relative_humidity_percent, least(greatest(p, 800), 1100) AS pressure_hpa,
greatest(w, 0) AS precipitation_mm FROM lines""")
def units_and_limits(spark, sf):
    df = lines(spark, sf).select(
        *KEY, digits(physics.kelvin_to_celsius(F.col("t") + 300)).alias("celsius"), digits(physics.pascal_to_hpa(F.col("p") * 100)).alias("hpa"),
        digits(physics.kmh_to_ms(F.col("s"))).alias("ms"), digits(physics.hourly_intensity(F.col("s"))).alias("mm_per_hour"),
        (F.col("t") * 3).alias(C.TEMP), (F.col("h") * 2 - 10).alias(C.HUMIDITY), F.col("p").alias(C.PRESSURE),
        physics.non_negative(F.col("w")).alias(C.PRECIP),
    )
    return physics.clip_columns(df, {k: v for k, v in C.LIMITS.items() if k != C.PRECIP})


@query(f"""WITH {SQL_LINES} SELECT {SQL_KEY}, CASE WHEN l_quantity > 1 THEN 1 / (l_quantity - 1) END AS inverse FROM lines""")
def infinite_as_missing(spark, sf):
    q = F.col("l_quantity") - 1
    return lines(spark, sf).select(*KEY, physics.finite(F.when(q == 0, F.lit(float("inf"))).otherwise(1 / q)).alias("inverse"))


RAIN = "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0 ELSE s / 1.25 END"
CLOUD = "CASE WHEN l_linenumber = 5 THEN NULL ELSE h END"
SQL_RAIN = {
    "precip_no_rain": "rain = 0", "precip_light_rain": "rain <> 0 AND rain < 2.5", "precip_moderate_rain": "rain >= 2.5 AND rain < 7.6",
    "precip_heavy_rain": "rain >= 7.6", "precip_unknown": "rain IS NULL",
}
SQL_CLOUDS = {
    "cloud_clear": "cloud < 25", "cloud_partly_cloudy": "cloud >= 25 AND cloud < 50", "cloud_mostly_cloudy": "cloud >= 50 AND cloud < 75",
    "cloud_overcast": "cloud >= 75", "cloud_unknown": "cloud IS NULL",
}


def pick(names, exprs):
    return "CASE " + " ".join(f"WHEN {e} THEN '{n.split('_', 1)[1]}'" for n, e in exprs.items()) + " END"


@query(f"""WITH {SQL_LINES}, c AS (SELECT *, {RAIN} AS rain, {CLOUD} AS cloud FROM lines)
SELECT {SQL_KEY}, {pick('precip', SQL_RAIN)} AS precip_category, {pick('cloud', SQL_CLOUDS)} AS cloud_category,
{flags(SQL_RAIN)}, {flags(SQL_CLOUDS)} FROM c""")
def weather_classes(spark, sf):
    rain, cloud = categories.precip_class(F.expr(RAIN)), categories.cloud_class(F.expr(CLOUD))
    return lines(spark, sf).select(
        *KEY, rain.alias("precip_category"), cloud.alias("cloud_category"),
        *[e.alias(n) for n, e in calendar.one_hot(rain, C.PRECIP_CLASSES, "precip").items()],
        *[e.alias(n) for n, e in calendar.one_hot(cloud, C.CLOUD_CLASSES, "cloud").items()],
    )


@query(f"""WITH {SQL_LINES} SELECT {SQL_KEY}, concat_ws(', ',
CASE WHEN t < 10 THEN 'Frío' WHEN t > 30 THEN 'Caluroso' ELSE 'Temperatura agradable' END,
CASE WHEN w > 7.6 THEN 'Lluvia torrencial' WHEN w > 2.5 THEN 'Lluvia fuerte' WHEN w > 0.2 THEN 'Lluvia ligera'
  WHEN h > 60 THEN 'Nublado' WHEN h > 25 THEN 'Parcialmente nublado' ELSE 'Despejado' END,
CASE WHEN s > 10 THEN 'Ventoso' END) AS description,
CASE WHEN w > 0.1 THEN 'LLUVIA' ELSE 'SOLEADO' END AS rain_label,
CASE WHEN t > 30 THEN 'red' WHEN t < 10 THEN 'blue' ELSE 'green' END AS color,
CASE WHEN w >= 2.5 THEN 2 WHEN w >= 0.2 THEN 1 ELSE 0 END AS precip_flag,
CASE WHEN h / 100 < 0.3 THEN 'low' WHEN h / 100 < 0.7 THEN 'medium' ELSE 'high' END AS confidence FROM lines""")
def descriptions(spark, sf):
    t, h, s, w = (F.col(c) for c in "thsw")
    return lines(spark, sf).select(
        *KEY, categories.description(t, w, h, s).alias("description"), categories.rain_label(w).alias("rain_label"),
        categories.temperature_color(t).alias("color"), categories.precip_flag(w).alias("precip_flag"),
        categories.confidence(h / 100).alias("confidence"),
    )


def by_region(i):
    cases = " ".join(f"WHEN '{r}' THEN {p[i]}::DOUBLE" for r, p in C.NORMALS.items())
    return f"(CASE region {cases} END)"


MONTHLY = "(CASE region " + " ".join(
    f"WHEN '{r}' THEN {[float(x) for x in p[3]]}[month(ts)]" for r, p in C.NORMALS.items()) + " END)"
YEAR = "sin(2 * pi() * (dayofyear(ts) - 80) / 365.0::DOUBLE)"
CLOCK = "(hour(ts) + minute(ts) / 60.0::DOUBLE)"
SQL_NORMALS = {
    f"normal_{C.TEMP}": f"{by_region(0)} + {by_region(1)} * {YEAR} + 3 * sin(2 * pi() * ({CLOCK} - 6) / 24)",
    f"normal_{C.HUMIDITY}": f"least(greatest({by_region(2)} - 10 * {YEAR} - 5 * sin(2 * pi() * {CLOCK} / 24), 10), 90)",
    f"normal_{C.PRECIP}": f"2 * {MONTHLY} / 100 * (1 + 0.5 * sin(2 * pi() * {CLOCK} / 24)) / 96",
    f"normal_{C.WIND_SPEED}": f"{by_region(4)} * 1000 / 3600",
    f"normal_{C.PRESSURE}": f"least(greatest({by_region(5)}, 980), 1030)",
    f"anomaly_{C.TEMP}": f"temp_celsius - ({by_region(0)} + {by_region(1)} * {YEAR} + 3 * sin(2 * pi() * ({CLOCK} - 6) / 24))",
}


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey * 7 % 1440) AS ts, {sql_place('o_custkey')},
  CAST(o_orderkey % 40 AS DOUBLE) AS temp_celsius FROM orders),
r AS (SELECT *, CASE WHEN lat > 31 THEN 'juarez' WHEN lon < -106.5 THEN 'mountains' ELSE 'chihuahua_city' END AS region FROM o)
SELECT o_orderkey, region, {', '.join(f'{sql_digits(e)} AS {n}' for n, e in SQL_NORMALS.items())} FROM r""")
def climate_normals(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.timestamp_add("MINUTE", F.pmod(F.col("o_orderkey") * 7, F.lit(1440)), F.col("o_orderdate")).alias("ts"),
        *[e.alias(n) for n, e in place("o_custkey").items()], F.pmod("o_orderkey", F.lit(40)).cast("double").alias(C.TEMP))
    return normals.with_anomalies(o).select("o_orderkey", "region", *[digits(n).alias(n) for n in SQL_NORMALS])
