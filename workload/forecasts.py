"""Forecast text and records, rain estimates, and the training and forecast jobs."""

from __future__ import annotations

from isobar import constants as C
from isobar.functions import categories
from isobar.functions.timegrid import sql_seconds
from isobar.operators import present, rain, sequences
from isobar.plans import forecasting, training
from isobar.plans.stage import materialized
from isobar.sources.tables import parse_payloads
from pyspark.sql import functions as F
from workload.base import CHUNK, digits, observed, place, query, sql_digits, sql_km, sql_observed, sql_place, table
from workload.datasets import sql_stats
from workload.moving import MODEL_SQL, sql_model

def sql_exact(e: str, n: int) -> str:
    """Rounding of the stored binary value, halves to even."""
    return f"(CAST(printf('%.{n}f', CAST({e} AS DOUBLE)) AS DOUBLE) + 0.0::DOUBLE)"


def scored(spark, sf):
    o = observed(spark, sf).withColumn("_k", F.ascii("location_id")).withColumn(
        "_i", F.expr("cast(hour(ts) * 4 + minute(ts) div 15 as int)"))
    return o.select(
        "location_id", *[e.alias(n) for n, e in place("_k").items()], F.expr("timestampadd(MINUTE, -15 * (_i % 24 + 1), ts)").alias("origin_ts"),
        F.expr("_i % 24 + 1").alias("horizon"), *C.TARGETS)


SQL_FORMAT = f"""keyed AS (SELECT *, ascii(location_id) AS k, CAST(hour(ts) * 4 + minute(ts) // 15 AS INTEGER) AS i FROM observed),
scored AS (SELECT location_id, {sql_place('k')}, ts, ts - to_minutes(15 * (i % 24 + 1)) AS origin_ts, i % 24 + 1 AS horizon,
  {', '.join(C.TARGETS)} FROM keyed),
steps AS (SELECT location_id, {sql_exact('lat', 3)} AS lat, {sql_exact('lon', 3)} AS lon, origin_ts, horizon, '+' || CAST(horizon * 15 AS VARCHAR) || 'min' AS time, ts AS timestamp,
  CASE WHEN {sql_exact('precipitation_mm', 2)} < 0 THEN 0 ELSE {sql_exact('precipitation_mm', 2)} END AS precipitation_mm, {sql_exact('temp_celsius', 1)} AS temp,
  {sql_exact(C.HUMIDITY, 1)} AS humidity, {sql_exact(C.WIND_SPEED, 1)} AS wind_speed, {sql_exact(C.PRESSURE, 1)} AS pressure, {sql_exact(C.CLOUD, 1)} AS cloud_cover FROM scored),
formatted AS (SELECT *, concat_ws(', ', CASE WHEN temp < 10 THEN 'Frío' WHEN temp > 30 THEN 'Caluroso' ELSE 'Temperatura agradable' END,
  CASE WHEN precipitation_mm > 7.6 THEN 'Lluvia torrencial' WHEN precipitation_mm > 2.5 THEN 'Lluvia fuerte' WHEN precipitation_mm > 0.2 THEN 'Lluvia ligera'
    WHEN cloud_cover > 60 THEN 'Nublado' WHEN cloud_cover > 25 THEN 'Parcialmente nublado' ELSE 'Despejado' END,
  CASE WHEN wind_speed > 10 THEN 'Ventoso' END) AS "desc" FROM steps)"""


@query(f"WITH {sql_observed()}, {SQL_FORMAT} SELECT * FROM formatted")
def formatted_forecast(spark, sf):
    return present.format_forecast(scored(spark, sf))


@query(f"""WITH {sql_observed()}, {SQL_FORMAT} SELECT location_id, origin_ts, horizon,
printf('%10s | %5.1fC | %7s %8s | %4.0f%% | %4.1fm/s | %6.0fhPa | %4.0f%% | %s', time, temp, printf('%.1fmm', precipitation_mm),
  CASE WHEN precipitation_mm > 0.1 THEN 'LLUVIA' ELSE 'SOLEADO' END, humidity, wind_speed, pressure, cloud_cover, "desc") AS line,
printf('%8s | %5.1fC | %7s | %4.0f%% | %4.1fm/s | %6.0fhPa | %s', time, temp, printf('%.1fmm', precipitation_mm), humidity, wind_speed, pressure, "desc") AS console
FROM formatted""")
def forecast_lines(spark, sf):
    return present.format_forecast(scored(spark, sf)).select(
        "location_id", "origin_ts", "horizon", categories.table_line().alias("line"), categories.console_line().alias("console"))


@query(f"""WITH {sql_observed()}, {SQL_FORMAT} SELECT location_id, origin_ts, CAST(horizon * 15 AS INTEGER) AS minutes_ahead, timestamp, temp AS temp_celsius, precipitation_mm,
humidity AS humidity_percent, wind_speed AS wind_speed_ms, pressure AS pressure_hpa, cloud_cover AS cloud_cover_percent, "desc" AS description FROM formatted""")
def packed_and_unpacked(spark, sf):
    return present.unpack_forecast(present.pack_forecast(present.format_forecast(scored(spark, sf))))


@query(f"""WITH {sql_observed()}, {SQL_FORMAT}, r AS (SELECT *, row_number() OVER (PARTITION BY location_id, origin_ts ORDER BY horizon) AS rn,
  count(*) OVER (PARTITION BY location_id, origin_ts) AS n FROM formatted)
SELECT location_id, origin_ts, lat, lon, n AS n_steps, '15 minutes' AS time_step, time, "desc", strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS at_text FROM r WHERE rn <= 3""")
def first_forecast_steps(spark, sf):
    packed = present.first_steps(present.pack_forecast(present.format_forecast(scored(spark, sf))))
    return packed.select(
        "location_id", "origin_ts", F.col("coords")[0].alias("lat"), F.col("coords")[1].alias("lon"),
        F.col("model_info.n_steps").cast("long").alias("n_steps"), F.col("model_info.time_step").alias("time_step"), F.explode("forecast").alias("s"),
    ).select("location_id", "origin_ts", "lat", "lon", "n_steps", "time_step", "s.time", "s.desc", F.col("s.timestamp").alias("at_text"))


# Provider payloads: a location is a user in a week; its newest event is the current conditions, all its events are hours.
LOCATION = "concat_ws('-', user_id, date_format(date_trunc('WEEK', ts), 'yyyyMMdd'))"


def payload_text(spark, sf):
    e = table(spark, sf, "events").withColumns(
        {"k": F.get_json_object("props", "$.k").cast("double"), "location_id": F.expr(LOCATION)})
    both = e.groupBy("location_id").agg(
        F.array_sort(F.collect_list(F.expr("named_struct('ts', ts, 'dt', event_id, 'pop', k / 100, 'value', value)"))).alias("hs"),
        F.expr("max_by(struct(k, value), struct(ts, event_id))").alias("c"))
    body = F.expr("""to_json(named_struct('current', named_struct('temp', c.value, 'humidity', c.k, 'clouds', 100 - c.k,
      'rain', IF(c.value > 40, map(IF(c.k > 50, '1h', '3h'), c.value), NULL)), 'hourly', transform(hs, x -> named_struct('dt', x.dt, 'pop', x.pop,
        'rain', IF(x.value > 60, map(IF(x.dt % 2 = 0, '1h', '3h'), x.value), NULL))), 'daily', array(1, 2)))""")
    return both.select("location_id", body.alias("payload"))


SQL_PAYLOAD = """weekly AS (SELECT *, user_id || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS location_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events),
e AS (SELECT location_id, k, value, row_number() OVER (PARTITION BY location_id ORDER BY ts, event_id) AS rn,
  row_number() OVER (PARTITION BY location_id ORDER BY ts DESC, event_id DESC) AS back FROM weekly),
cur AS (SELECT location_id, k, value FROM e WHERE back = 1),
hrs AS (SELECT location_id, list_sum(list(k / 100 ORDER BY rn)) AS pop_sum, count(*) FILTER (k / 100 > 0.3) AS pop_hours, count(*) FILTER (value > 60) AS rain_hours,
  count(*) AS n_hours FROM e WHERE rn <= 6 GROUP BY 1),
p0 AS (SELECT location_id, CAST(CASE WHEN value > 40 THEN 0.4 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN k > 80 THEN 0.2 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN 100 - k > 70 THEN 0.2 ELSE 0 END AS DOUBLE) AS p FROM cur),
p1 AS (SELECT location_id, p + CAST(CASE WHEN rain_hours > 0 THEN 0.1 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN rain_hours > 1 THEN 0.1 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN rain_hours > 2 THEN 0.1 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN rain_hours > 3 THEN 0.1 ELSE 0 END AS DOUBLE)
  + CAST(CASE WHEN rain_hours > 4 THEN 0.1 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN rain_hours > 5 THEN 0.1 ELSE 0 END AS DOUBLE)
  + pop_sum / n_hours * 0.3::DOUBLE + CAST(CASE WHEN pop_hours >= 3 THEN 0.2 ELSE 0 END AS DOUBLE) AS p FROM p0 JOIN hrs USING (location_id)),
prob AS (SELECT location_id, least(greatest(p, 0), 1) AS p FROM p1)"""


@query(f"""WITH {SQL_PAYLOAD}, n AS (SELECT location_id, least(count(*), 24) AS n FROM e GROUP BY 1)
SELECT location_id, k AS humidity, value AS temp, value > 40 AS raining, CAST(n.n AS INTEGER) AS n_hourly FROM cur JOIN n USING (location_id)""")
def provider_payloads(spark, sf):
    p = parse_payloads(payload_text(spark, sf))
    return p.select("location_id", "current.humidity", "current.temp", rain.rains(F.col("current.rain")).alias("raining"), F.size("hourly").alias("n_hourly"))


@query(f"WITH {SQL_PAYLOAD} SELECT location_id, {sql_digits('pop_sum')} AS pop_sum, CAST(pop_hours AS INTEGER) AS pop_hours, "
       "CAST(rain_hours AS INTEGER) AS rain_hours, CAST(n_hours AS INTEGER) AS n_hours FROM hrs")
def provider_hours(spark, sf):
    p = parse_payloads(payload_text(spark, sf)).select("location_id", *[e.alias(n) for n, e in rain.hour_summary(rain.next_hours()).items()])
    return p.withColumn("pop_sum", digits("pop_sum"))


@query(f"""WITH {SQL_PAYLOAD} SELECT location_id, {sql_exact('p', 3)} AS rain_probability, p > 0.3::DOUBLE AS will_rain_next_6h,
CASE WHEN p < 0.3::DOUBLE THEN 'low' WHEN p < 0.7::DOUBLE THEN 'medium' ELSE 'high' END AS confidence_level FROM prob""")
def rain_probability(spark, sf):
    return rain.rain_results(parse_payloads(payload_text(spark, sf))).select(
        "location_id", "rain_probability", "will_rain_next_6h", "confidence_level")


SECOND_WEEK = "CAST(c_custkey AS {text}) || '-20240108'"


@query(f"""WITH {SQL_PAYLOAD} SELECT c.location_id, coalesce({sql_exact('p', 3)}, 0.1) AS rain_probability,
coalesce(p > 0.3::DOUBLE, false) AS will_rain_next_6h, CASE WHEN p IS NULL OR p < 0.3::DOUBLE THEN 'low' WHEN p < 0.7::DOUBLE THEN 'medium' ELSE 'high' END AS confidence_level,
CASE WHEN p IS NULL THEN 'fallback' ELSE 'real_time_estimator' END AS model_type
FROM (SELECT {SECOND_WEEK.format(text='VARCHAR')} AS location_id FROM customer) c LEFT JOIN prob ON prob.location_id = c.location_id""")
def rain_for_locations(spark, sf):
    known = table(spark, sf, "customer").select(F.expr(SECOND_WEEK.format(text="STRING")).alias("location_id"))
    return rain.rain_for_locations(known, parse_payloads(payload_text(spark, sf))).drop("current_conditions", "hourly_forecast")


# Training and forecasting jobs.
SQL_ORIGIN_RANK = "md5(concat_ws('|', '42', location_id, CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)))"
SQL_SPLIT_STATS = "\nUNION ALL ".join(
    f"SELECT '{s}' AS split, n_samples, 24 AS input_steps, {len(MODEL_SQL)} AS n_features, 24 AS output_steps, 6 AS n_targets, {sql_digits('xm', 4)} AS X_mean, "
    f"{sql_digits('xs', 4)} AS X_std, {sql_digits('ym', 4)} AS y_mean, {sql_digits('ys', 4)} AS y_std FROM summary WHERE split = '{s}'" for s in ("train", "val", "test"))


EXACT = {c: f"((coalesce(r.{c}, {c}_median) - {c}_mean) / {c}_std)" for c in MODEL_SQL}
SCALED = {c: f"CAST({e} AS FLOAT)" for c, e in EXACT.items()}


def sql_training_dataset() -> str:
    return f"""{sql_samples()},
inputs AS (SELECT split, unnest([{', '.join(SCALED.values())}]) AS x FROM origins o JOIN placed r ON r.location_id = o.location_id AND r.i BETWEEN o.i - 23 AND o.i, stats),
outputs AS (SELECT split, unnest([{', '.join(SCALED[t] for t in C.TARGETS)}]) AS x FROM origins o JOIN placed r ON r.location_id = o.location_id AND r.i BETWEEN o.i + 1 AND o.i + 24, stats),
summary AS (SELECT split, n_samples, xm, xs, ym, ys FROM (SELECT split, count(*) AS n_samples FROM origins GROUP BY 1)
  JOIN (SELECT split, avg(x::DOUBLE) AS xm, stddev_pop(x::DOUBLE) AS xs FROM inputs GROUP BY 1) USING (split)
  JOIN (SELECT split, avg(x::DOUBLE) AS ym, stddev_pop(x::DOUBLE) AS ys FROM outputs GROUP BY 1) USING (split))
{SQL_SPLIT_STATS}"""


def sql_samples() -> str:
    """Origins with their split, and statistics, in CTEs."""
    return f"""WITH {sql_model()},
placed AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY location_id) AS n FROM model),
ranked AS (SELECT location_id, ts, i, {SQL_ORIGIN_RANK} AS h, row_number() OVER (PARTITION BY location_id ORDER BY {SQL_ORIGIN_RANK}, ts) AS rn FROM placed WHERE i >= 24 AND i + 24 <= n),
drawn AS (SELECT *, row_number() OVER (ORDER BY h, location_id, ts) - 1 AS k, count(*) OVER () AS m FROM ranked WHERE rn <= 40),
sized AS (SELECT *, ceil(0.15::DOUBLE * m) AS n_test FROM drawn),
origins AS (SELECT location_id, i, CASE WHEN k < n_test THEN 'test' WHEN k < n_test + ceil(0.15::DOUBLE / (1 - 0.15::DOUBLE) * (m - n_test)) THEN 'val' ELSE 'train' END AS split FROM sized),
held_out AS (SELECT DISTINCT o.location_id, o.i + d AS i FROM origins o, range(-23, 25) t(d) WHERE split <> 'train'),
fitting AS (SELECT p.* FROM placed p ANTI JOIN held_out USING (location_id, i)),
{sql_stats('fitting', list(MODEL_SQL))}"""


@query(sql_training_dataset())
def training_dataset(spark, sf):
    """Sizes, and means and deviations of all scaled inputs and targets, of each split."""
    data = training.build_dataset(materialized(observed(spark, sf)), chunk=CHUNK, rank=origin_rank())
    out = sequences.dataset_statistics(materialized(data.samples))
    return out.withColumns({c: digits(c, 4) for c in ("X_mean", "X_std", "y_mean", "y_std")})


def code_requests(spark, sf):
    """Codes of all shapes from customer numbers: short, padded, of a known prefix, and with letters."""
    return table(spark, sf, "customer").select(F.expr(
        "CASE c_custkey % 4 WHEN 0 THEN cast(c_custkey AS string) WHEN 1 THEN lpad(cast(c_custkey % 100000 AS string), 5, '0') "
        "WHEN 2 THEN concat(element_at(array('31', '32', '33', '34'), cast(c_custkey % 16 div 4 + 1 AS int)), lpad(cast(c_custkey % 1000 AS string), 3, '0')) "
        "ELSE concat('x', c_custkey) END").alias("code"))


def code_places(spark, sf):
    """Known locations by supplier number; those with an odd number have a series."""
    s = table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("location_id"), *[e.alias(n) for n, e in place("s_suppkey").items()])
    return s, s.filter(F.col("location_id").cast("long") % 2 == 1).select("location_id")


SQL_NEAREST = " UNION ALL ".join(
    f"SELECT '{p}' AS prefix, arg_min(location_id, struct_pack(d := {sql_km('lat', 'lon', f'{lat}::DOUBLE', f'{lon}::DOUBLE')}, l := location_id)) AS near FROM served"
    for p, (lat, lon) in C.PREFIX_COORDINATES.items())


@query(f"""WITH requests AS (SELECT CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')
  WHEN 2 THEN (['31', '32', '33', '34'])[c_custkey % 16 // 4 + 1] || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') ELSE 'x' || c_custkey END AS code FROM customer),
known AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS location_id, s_suppkey % 2 = 1 AS has, {sql_place('s_suppkey')} FROM supplier),
served AS (SELECT * FROM known WHERE has), near AS ({SQL_NEAREST}),
padded AS (SELECT code, CASE WHEN length(code) < 5 THEN lpad(code, 5, '0') ELSE code END AS full_code FROM requests),
kinds AS (SELECT code, k.location_id AS exact, near, CASE WHEN k.location_id IS NOT NULL THEN 'exact' WHEN prefix IS NOT NULL THEN 'prefix' ELSE 'none' END AS match_kind
  FROM padded LEFT JOIN known k ON k.location_id = full_code LEFT JOIN near ON prefix = substr(full_code, 1, 2))
SELECT code, match_kind, CASE WHEN length(code) = 5 THEN coalesce(exact, near) END AS place,
  CASE WHEN length(code) <> 5 THEN '{C.ERROR_INVALID}' WHEN match_kind = 'none' THEN '{C.ERROR_UNKNOWN}' || code END AS error FROM kinds""")
def request_places(spark, sf):
    """Which series answers each requested code, and the error of those that none answers."""
    known, served = code_places(spark, sf)
    return forecasting.resolve_requests(code_requests(spark, sf), known, served).select("code", "match_kind", "place", "error")


def sql_fitted() -> str:
    """Ridge regression of all targets from moments, the system solved by elimination, in CTEs."""
    k, m = len(MODEL_SQL), len(C.TARGETS)
    return f"""{sql_samples().replace("WITH ", "WITH RECURSIVE ", 1)},
xs AS MATERIALIZED (SELECT o.location_id, o.i, split, [{', '.join(EXACT.values())}]::DOUBLE[] AS x FROM origins o JOIN placed r ON r.location_id = o.location_id AND r.i = o.i, stats),
ys AS MATERIALIZED (SELECT o.location_id, o.i, split, r.i - o.i AS h, [{', '.join(SCALED[t] for t in C.TARGETS)}]::DOUBLE[] AS y
  FROM origins o JOIN placed r ON r.location_id = o.location_id AND r.i BETWEEN o.i + 1 AND o.i + 24, stats),
z AS MATERIALIZED (SELECT list_concat(any_value(x), [{', '.join(f'avg(y[{t}])' for t in range(1, m + 1))}]) AS z FROM xs JOIN ys USING (location_id, i) WHERE xs.split = 'train' GROUP BY location_id, i),
moments AS (SELECT a, b, avg(z[a] * z[b]) - avg(z[a]) * avg(z[b]) + CASE WHEN a = b THEN 1e-3::DOUBLE ELSE 0 END AS v FROM z, range(1, {k + 1}) r(a), range(1, {k + m + 1}) q(b) GROUP BY a, b),
matrix AS (SELECT list(v ORDER BY a) AS rows FROM (SELECT a, list(v ORDER BY b) AS v FROM moments GROUP BY a)),
solve AS (SELECT 1 AS p, rows FROM matrix UNION ALL
  SELECT p + 1, list_transform(range(1, {k + 1}), lambda r: CASE WHEN r = p THEN list_transform(rows[p], lambda v: v / rows[p][p])
    ELSE list_transform(range(1, {k + m + 1}), lambda c: rows[r][c] - rows[r][p] * rows[p][c] / rows[p][p]) END) FROM solve WHERE p <= {k}),
slopes AS MATERIALIZED (SELECT t, list_transform(range(1, {k + 1}), lambda a: rows[a][{k} + t]) AS slope FROM solve, range(1, {m + 1}) q(t) WHERE p = {k + 1}),
centre AS MATERIALIZED (SELECT list(v ORDER BY a) AS mean FROM (SELECT a, avg(z[a]) AS v FROM z, range(1, {k + 1}) r(a) GROUP BY a)),
offsets AS MATERIALIZED (SELECT t, h, any_value(avg_y) - any_value(list_dot_product(slope, mean)) AS intercept
  FROM (SELECT t, h, avg(y[t]) AS avg_y FROM ys, range(1, {m + 1}) q(t) WHERE split = 'train' GROUP BY t, h) JOIN slopes USING (t), centre GROUP BY t, h)"""


def sql_forecaster() -> str:
    """Scores of the fitted models on the test windows."""
    m = len(C.TARGETS)
    target = {name: "CASE t " + " ".join(f"WHEN {i} THEN any_value({c}_{name})" for i, c in enumerate(C.TARGETS, 1)) + " END" for name in ("mean", "std")}
    named = "CASE t " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(C.TARGETS, 1)) + " END"
    weight = "CASE t " + " ".join(f"WHEN {i} THEN {float(C.LOSS_WEIGHTS[c])}" for i, c in enumerate(C.TARGETS, 1)) + " END"
    return f"""{sql_fitted()},
pairs AS MATERIALIZED (SELECT t, list_dot_product(slope, x) + intercept AS prediction, y[t] AS target FROM ys JOIN xs USING (location_id, i) JOIN offsets USING (h) JOIN slopes USING (t) WHERE ys.split = 'test'),
scale AS (SELECT t, {target['mean']} AS mean, {target['std']} AS std FROM stats, range(1, {m + 1}) q(t) GROUP BY t),
original AS (SELECT t, prediction * std + mean AS prediction, target * std + mean AS target FROM pairs JOIN scale USING (t))
SELECT {named} AS variable, count(*) AS n, {sql_digits('avg(pow(prediction - target, 2))', 4)} AS mse, {sql_digits('sqrt(avg(pow(prediction - target, 2)))', 5)} AS rmse,
  {sql_digits('avg(abs(prediction - target))', 5)} AS mae, {sql_digits('CASE WHEN var_pop(target) <> 0 THEN 1 - sum(pow(prediction - target, 2)) / (var_pop(target) * count(*)) ELSE 0 END', 5)} AS r2
FROM original GROUP BY t
UNION ALL SELECT 'weighted loss', NULL, {sql_digits(f'avg({weight} * pow(prediction - target, 2))', 4)}, NULL, NULL, NULL FROM pairs"""


def origin_rank():
    digest = F.md5(F.concat_ws("|", F.lit("42"), "location_id", F.expr(f"cast({sql_seconds('origin_ts')} as string)")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


@query(sql_forecaster())
def forecaster_scores(spark, sf):
    """Fit on all locations, scores per variable on held-out windows."""
    _, _, scores = training.train(spark, observed(spark, sf), chunk=CHUNK, rank=origin_rank())
    loss = scores["loss"].select(F.lit("weighted loss").alias("variable"), F.col("weighted_mse").alias("mse"))
    out = scores["per_variable"].unionByName(loss, allowMissingColumns=True)
    return out.select("variable", "n", digits("mse", 4).alias("mse"), *[digits(c, 5).alias(c) for c in ("rmse", "mae", "r2")])


def sql_forecast_for_codes() -> str:
    predicted = ", ".join(f"(list_dot_product(s[{t}], x) + c[{t}]) * {v}_std + {v}_mean AS {v}" for t, v in enumerate(C.TARGETS, 1))
    prefixes = {axis: "CASE substr(code, 1, 2) " + " ".join(f"WHEN '{p}' THEN {at[i]}::DOUBLE" for p, at in C.PREFIX_COORDINATES.items()) + " END" for i, axis in enumerate(("lat", "lon"))}
    return f"""{sql_fitted()},
known AS (SELECT DISTINCT location_id, {sql_place('ascii(location_id)')} FROM observed), served AS (SELECT * FROM known), near AS ({SQL_NEAREST}),
requests AS (SELECT location_id AS code FROM known UNION SELECT CAST(c_custkey * 41 AS VARCHAR) FROM customer UNION SELECT unnest(['5', '00005', '31999'])),
asked AS (SELECT code, CASE WHEN length(code) = 5 THEN coalesce(k.location_id, near) END AS place, coalesce(k.lat, {prefixes['lat']}) AS lat, coalesce(k.lon, {prefixes['lon']}) AS lon,
    CASE WHEN length(code) <> 5 THEN '{C.ERROR_INVALID}' WHEN k.location_id IS NULL AND near IS NULL THEN '{C.ERROR_UNKNOWN}' || code END AS error
  FROM requests LEFT JOIN known k ON k.location_id = code LEFT JOIN near ON prefix = substr(code, 1, 2)),
newest AS (SELECT r.location_id, r.ts, [{', '.join(EXACT.values())}]::DOUBLE[] AS x FROM placed r, stats WHERE r.i = r.n AND r.n >= 24),
fitted AS (SELECT list(slope ORDER BY t) AS s FROM slopes), offset_lists AS (SELECT h, list(intercept ORDER BY t) AS c FROM offsets GROUP BY h),
scored AS (SELECT code AS location_id, lat, lon, n.ts AS origin_ts, n.ts + to_minutes(CAST(15 * h AS BIGINT)) AS ts, CAST(h AS INTEGER) AS horizon, {predicted}
  FROM asked JOIN newest n ON n.location_id = place, fitted, offset_lists, stats),
{SQL_FORMAT[SQL_FORMAT.index("steps AS ("):]}
SELECT code, place AS location_id, coalesce(error, CASE WHEN horizon IS NULL THEN '{C.ERROR_NO_DATA}' END) AS error, f.* EXCLUDE (location_id)
FROM asked LEFT JOIN formatted f ON f.location_id = code"""


@query(sql_forecast_for_codes())
def forecast_for_codes(spark, sf):
    """Forecasts for every kind of event as location, for codes known by their prefix, and error rows for all others."""
    o = materialized(observed(spark, sf))
    model, data, _ = training.train(spark, o, chunk=CHUNK, rank=origin_rank())
    kinds = o.select("location_id").distinct().withColumn("_k", F.ascii("location_id"))
    known = kinds.select("location_id", *[e.alias(n) for n, e in place("_k").items()])
    asked = kinds.select(F.col("location_id").alias("code")).unionByName(
        table(spark, sf, "customer").select((F.col("c_custkey") * 41).cast("string").alias("code"))).unionByName(
        spark.createDataFrame([("5",), ("00005",), ("31999",)], "code string"))
    return forecasting.forecast(asked, known, o, model, data.stats, data.features, chunk=CHUNK)
