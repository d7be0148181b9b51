"""Scaling, supervised windows, samples, splits and scores."""

from __future__ import annotations

from isobar import constants as C
from isobar.functions.timegrid import sql_seconds
from isobar.operators import metrics, scaling, sequences
from isobar.plans import forecasting, training
from isobar.plans.stage import materialized
from pyspark.sql import functions as F
from workload.base import CHUNK, digits, merged_cells, observed, query, single, sql_digits, sql_merged, sql_observed, sql_single, table
from workload.alignment import GAPPY, gappy
from workload.moving import MODEL_SQL, sql_model
from workload.rowwise import KEY, SQL_KEY, SQL_LINES, lines


def sql_stats(source: str, columns) -> str:
    """One row with median, mean and deviation of each column after filling."""
    med = ", ".join(f"coalesce(median({c}), 0) AS {c}_med" for c in columns)
    rest = ", ".join(
        f"avg(coalesce({c}, {c}_med)) AS {c}_mean, CASE WHEN stddev_pop(coalesce({c}, {c}_med)) = 0 THEN 1 ELSE stddev_pop(coalesce({c}, {c}_med)) END AS {c}_std, "
        f"any_value({c}_med) AS {c}_median" for c in columns)
    return f"med AS (SELECT {med} FROM {source}),\nstats AS (SELECT {rest} FROM {source}, med)"


@query(f"WITH {sql_merged(60, 'user_id')}, {GAPPY}, {sql_stats('gappy', ['v', 'k'])}\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {sql_digits(f'{c}_median')} AS median, {sql_digits(f'{c}_mean')} AS mean, {sql_digits(f'{c}_std')} AS std_pop FROM stats"
    for c in ("v", "k")))
def scaler_statistics(spark, sf):
    stats = scaling.fit_scaler(gappy(spark, sf), ["v", "k"])
    return stats.select("column", *[digits(c).alias(c) for c in ("median", "mean", "std_pop")])


@query(f"WITH {sql_merged(60, 'user_id')}, {GAPPY}, {sql_stats('gappy', ['v', 'k'])} SELECT location_id, ts, "
       + ", ".join(f"{sql_digits(f'(coalesce({c}, {c}_median) - {c}_mean) / {c}_std')} AS {c}" for c in ("v", "k")) + " FROM gappy, stats")
def normalized(spark, sf):
    g = gappy(spark, sf)
    return scaling.normalize(g, scaling.fit_scaler(g)).select("location_id", "ts", digits("v").alias("v"), digits("k").alias("k"))


@query(f"WITH {sql_merged(60, 'user_id')}, {GAPPY}, {sql_stats('gappy', ['v', 'k'])} SELECT location_id, ts, "
       + ", ".join(f"{sql_digits(f'coalesce({c}, {c}_median)', 5)} AS {c}" for c in ("v", "k")) + " FROM gappy, stats")
def normalized_and_back(spark, sf):
    g = gappy(spark, sf)
    stats = scaling.stats_by_name(scaling.fit_scaler(g))
    back = scaling.denormalize(scaling.normalize(g, stats), stats)
    return back.select("location_id", "ts", digits("v", 5).alias("v"), digits("k", 5).alias("k"))


TYPICAL = {
    C.TEMP: "z * 5 + 15", C.PRECIP: "greatest(z * 2 + 0.5, 0)", C.HUMIDITY: "least(greatest(z * 20 + 60, 0), 100)",
    C.WIND_SPEED: "greatest(z * 2 + 3, 0)", C.PRESSURE: "greatest(z * 10 + 1013, 800)", C.CLOUD: "least(greatest(z * 30 + 50, 0), 100)",
}


@query(f"WITH {SQL_LINES}, zs AS (SELECT *, t / 8 AS z FROM lines) SELECT {SQL_KEY}, "
       + ", ".join(f"{sql_digits(e)} AS {c}" for c, e in TYPICAL.items()) + " FROM zs")
def typical_denormalized(spark, sf):
    z = lines(spark, sf).select(*KEY, *[(F.col("t") / 8).alias(c) for c in C.TARGETS])
    return scaling.denormalize_typical(z).select(*KEY, *[digits(c).alias(c) for c in C.TARGETS])


FEATURES = [C.TEMP, C.HUMIDITY, C.PRESSURE]
W = "OVER (PARTITION BY location_id ORDER BY ts)"


@query(f"""WITH {sql_observed()}, w AS (SELECT location_id, ts AS origin_ts, {sql_single(f'lag(temp_celsius, 23) {W}')} AS first_in,
{sql_single('pressure_hpa')} AS last_in, {sql_single(f'lead(temp_celsius, 1) {W}')} AS first_out, {sql_single(f'lead(cloud_cover_percent, 24) {W}')} AS last_out,
lag(ts, 23) {W} AS back, lead(ts, 24) {W} AS ahead FROM observed)
SELECT location_id, origin_ts, first_in, last_in, first_out, last_out, 24 AS n_in, 24 AS n_out, 3 AS n_features, 6 AS n_targets
FROM w WHERE back IS NOT NULL AND ahead IS NOT NULL""")
def supervised_windows(spark, sf):
    w = sequences.windows(observed(spark, sf), FEATURES, regular=True, chunk=CHUNK)
    return w.select(
        "location_id", "origin_ts", F.expr("cast(X[0][0] as double)").alias("first_in"), F.expr("cast(X[23][2] as double)").alias("last_in"),
        F.expr("cast(y[0][0] as double)").alias("first_out"), F.expr("cast(y[23][5] as double)").alias("last_out"),
        F.size("X").alias("n_in"), F.size("y").alias("n_out"), F.size(F.col("X")[0]).alias("n_features"), F.size(F.col("y")[0]).alias("n_targets"))


SQL_STACKED = f"""w AS (SELECT location_id, ts AS origin_ts, 'types' AS collection, lag(ts, 23) {W} AS back, lead(ts, 24) {W} AS ahead, {sql_single('temp_celsius')} AS now,
  {sql_single(f'lead(temp_celsius, 24) {W}')} AS last_out FROM observed), n AS (SELECT location_id, ts, 'users' AS collection, lag(ts, 23) {W} AS back, lead(ts, 24) {W} AS ahead,
  {sql_single('v')} AS now, {sql_single(f'lead(v, 24) {W}')} AS last_out FROM users)"""


@query(f"""WITH {sql_observed()}, {sql_merged(15, 'user_id').replace("merged AS", "users AS", 1)}, {SQL_STACKED}
SELECT collection, location_id, origin_ts, now, last_out FROM (SELECT * FROM w UNION ALL SELECT * FROM n) WHERE back IS NOT NULL AND ahead IS NOT NULL""")
def stacked_samples(spark, sf):
    """Windows of regular and of irregular series as one set of samples."""
    o = observed(spark, sf).select("location_id", "ts", F.col(C.TEMP).alias("v"))
    u = merged_cells(spark, sf, 15, "user_id").select("ts", "v", "location_id")
    regular = sequences.windows(o, ["v"], ["v"], regular=True, chunk=CHUNK).withColumn("collection", F.lit("types"))
    irregular = sequences.windows(u, ["v"], ["v"], chunk=32, bucket_seconds=5 * 86400).withColumn("collection", F.lit("users"))
    s = sequences.stack_samples([regular, irregular])
    return s.select("collection", "location_id", "origin_ts", F.expr("cast(X[23][0] as double)").alias("now"), F.expr("cast(y[23][0] as double)").alias("last_out"))


@query(f"""WITH {sql_merged(15, 'user_id')}, n AS (SELECT location_id, ts, v, row_number() {W} AS i, count(*) OVER (PARTITION BY location_id) AS n FROM merged)
SELECT a.location_id, a.ts AS origin_ts, CAST(b.i - a.i AS INTEGER) AS horizon, {sql_single('b.v')} AS target_v
FROM n a JOIN n b ON a.location_id = b.location_id AND b.i BETWEEN a.i + 1 AND a.i + 12 WHERE a.i >= 24 AND a.i + 12 <= a.n""")
def window_targets_long(spark, sf):
    """Irregular series: windows count rows."""
    m = merged_cells(spark, sf, 15, "user_id").select("location_id", "ts", "v")
    w = sequences.windows(m, ["v"], ["v"], 24, 12, inputs="last", chunk=32, bucket_seconds=5 * 86400).drop("v")
    return sequences.long_targets(w, ["v"])


def ranked(*parts):
    return F.md5(F.concat_ws("|", F.lit("42"), *parts))


SQL_RANK = "md5(concat_ws('|', '42', location_id, CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR)))"


def rank():
    return ranked("location_id", F.expr(f"cast({sql_seconds('ts')} as string)"))


@query(f"""WITH {sql_merged(15, 'user_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY {SQL_RANK}, ts) AS rn FROM merged)
SELECT location_id, ts, v FROM r WHERE rn <= 40""")
def sample_per_location(spark, sf):
    m = merged_cells(spark, sf, 15, "user_id").select("location_id", "ts", "v")
    return sequences.cap_per_location(m, 40, unique=["ts"], rank=rank())


@query(f"""WITH {sql_merged(15, 'user_id')}, r AS (SELECT location_id, ts, v, row_number() {W} AS rn, count(*) OVER (PARTITION BY location_id) AS n FROM merged),
d AS (SELECT location_id, copy, CAST('0x' || substr(md5(concat_ws('|', '42', location_id, CAST(copy AS VARCHAR))), 1, 7) AS BIGINT) % n + 1 AS rn
  FROM (SELECT DISTINCT location_id, n FROM r WHERE n < 80) s, LATERAL (SELECT unnest(generate_series(1, 80 - n)) AS copy))
SELECT location_id, ts, v, 0 AS copy FROM merged UNION ALL
SELECT r.location_id, r.ts, r.v, CAST(d.copy AS INTEGER) FROM r JOIN d ON d.location_id = r.location_id AND d.rn = r.rn""")
def pad_samples(spark, sf):
    m = merged_cells(spark, sf, 15, "user_id").select("location_id", "ts", "v")
    draw = F.conv(F.substring(ranked("location_id", F.col("copy").cast("string")), 1, 7), 16, 10).cast("long")
    return sequences.pad_per_location(m, 80, unique=["ts"], draw=draw)


@query(f"""WITH {sql_merged(15, 'user_id')}, r AS (SELECT location_id, ts, row_number() OVER (ORDER BY {SQL_RANK}, location_id, ts) - 1 AS i, count(*) OVER () AS n FROM merged),
s AS (SELECT *, ceil(0.15::DOUBLE * n) AS n_test FROM r),
q AS (SELECT *, n_test + ceil(0.15::DOUBLE / (1 - 0.15::DOUBLE) * (n - n_test)) AS upto FROM s)
SELECT location_id, ts, CASE WHEN i < n_test THEN 'test' WHEN i < upto THEN 'val' ELSE 'train' END AS split FROM q""")
def split_exact(spark, sf):
    m = materialized(merged_cells(spark, sf, 15, "user_id").select("location_id", "ts"))
    return sequences.split_exact(m, ["location_id", "ts"], rank=F.conv(F.substring(rank(), 1, 15), 16, 10).cast("long"))


@query(f"""WITH {sql_observed()}, i AS (SELECT *, row_number() {W} AS i, count(*) OVER (PARTITION BY location_id) AS n FROM observed),
o AS (SELECT location_id, i, CASE WHEN hour(ts) < 12 THEN 'train' WHEN hour(ts) < 18 THEN 'val' ELSE 'test' END AS split FROM i WHERE i >= 24 AND i + 24 <= n),
f AS (SELECT location_id, i, unnest([temp_celsius::FLOAT, relative_humidity_percent::FLOAT, pressure_hpa::FLOAT]) AS x FROM i),
t AS (SELECT location_id, i, unnest([temp_celsius::FLOAT, precipitation_mm::FLOAT, relative_humidity_percent::FLOAT, wind_speed_ms::FLOAT, pressure_hpa::FLOAT, cloud_cover_percent::FLOAT]) AS x FROM i),
a AS (SELECT split, count(*) AS n_samples FROM o GROUP BY 1),
b AS (SELECT split, avg(x::DOUBLE) AS m, stddev_pop(x::DOUBLE) AS s FROM o JOIN f ON f.location_id = o.location_id AND f.i BETWEEN o.i - 23 AND o.i GROUP BY 1),
c AS (SELECT split, avg(x::DOUBLE) AS m, stddev_pop(x::DOUBLE) AS s FROM o JOIN t ON t.location_id = o.location_id AND t.i BETWEEN o.i + 1 AND o.i + 24 GROUP BY 1)
SELECT a.split, n_samples, 24 AS input_steps, 3 AS n_features, 24 AS output_steps, 6 AS n_targets, {sql_digits('b.m', 4)} AS X_mean, {sql_digits('b.s', 4)} AS X_std,
  {sql_digits('c.m', 4)} AS y_mean, {sql_digits('c.s', 4)} AS y_std FROM a JOIN b ON b.split = a.split JOIN c ON c.split = a.split""")
def dataset_statistics(spark, sf):
    w = sequences.windows(observed(spark, sf), FEATURES, regular=True, chunk=CHUNK)
    hour = F.hour("origin_ts")
    out = sequences.dataset_statistics(w.withColumn("split", F.when(hour < 12, "train").when(hour < 18, "val").otherwise("test")))
    return out.withColumns({c: digits(c, 4) for c in ("X_mean", "X_std", "y_mean", "y_std")})


SQL_PAIRS = f"""pairs AS (SELECT p.location_id, p.ts AS origin_ts, 24 AS horizon, unnest({C.TARGETS}) AS variable,
  unnest([{', '.join(f'p.{t}' for t in C.TARGETS)}]) AS prediction, unnest([{', '.join(f't.{t}' for t in C.TARGETS)}]) AS target
  FROM observed p JOIN observed t ON t.location_id = p.location_id AND t.ts = p.ts + INTERVAL 6 HOUR)"""


def persistence(spark, sf):
    """The values at the origin as predictions for six hours later, and what was then observed."""
    o = observed(spark, sf).withColumn("horizon", F.lit(24))
    return o.withColumnRenamed("ts", "origin_ts"), o.withColumn("origin_ts", F.expr("ts - INTERVAL 6 HOURS"))


@query(f"""WITH {sql_observed()}, {SQL_PAIRS} SELECT location_id, origin_ts, horizon, variable, {sql_single('prediction')} AS prediction,
{sql_single('target')} AS target FROM pairs""")
def forecast_pairs(spark, sf):
    p = metrics.pair(*persistence(spark, sf))
    return p.select(*metrics.IDS, single("prediction").alias("prediction"), single("target").alias("target"))


@query(f"""WITH {sql_observed()}, {SQL_PAIRS} SELECT {sql_digits("avg(CASE variable WHEN 'temp_celsius' THEN 2.0 WHEN 'precipitation_mm' THEN 3.0 ELSE 1.0 END * pow(prediction - target, 2))", 5)} AS weighted_mse FROM pairs""")
def weighted_error(spark, sf):
    return metrics.weighted_mse(metrics.pair(*persistence(spark, sf))).select(digits("weighted_mse", 5).alias("weighted_mse"))


@query(f"""WITH {sql_observed()}, {SQL_PAIRS} SELECT variable, count(*) AS n, {sql_digits('avg(pow(prediction - target, 2))', 5)} AS mse,
{sql_digits('sqrt(avg(pow(prediction - target, 2)))')} AS rmse, {sql_digits('avg(abs(prediction - target))')} AS mae,
{sql_digits('1 - sum(pow(prediction - target, 2)) / (var_pop(target) * count(*))')} AS r2 FROM pairs GROUP BY 1""")
def scores_by_variable(spark, sf):
    s = metrics.per_variable(metrics.pair(*persistence(spark, sf)))
    return s.select("variable", "n", digits("mse", 5).alias("mse"), *[digits(c).alias(c) for c in ("rmse", "mae", "r2")])


def sql_scaled_tail(n: int) -> str:
    names = list(MODEL_SQL)
    cols = ", ".join(f"{sql_digits(f'(coalesce({c}, {c}_median) - {c}_mean) / {c}_std', 5)} AS {c}" for c in names)
    return f"""WITH {sql_model()}, {sql_stats('model', names)},
r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY ts DESC) AS rn FROM model)
SELECT location_id, ts, {cols} FROM r, stats WHERE rn <= {n}"""


def shown(df):
    return df.select("location_id", "ts", *[digits(c, 5).alias(c) for c in MODEL_SQL])


def fitted(spark, sf):
    o = materialized(observed(spark, sf))
    return o, scaling.fit_scaler(materialized(training.model_rows(o, CHUNK)), list(MODEL_SQL))


@query(sql_scaled_tail(24))
def prediction_input(spark, sf):
    o, stats = fitted(spark, sf)
    return shown(forecasting.prediction_input(o, stats, list(MODEL_SQL), chunk=CHUNK))


@query(sql_scaled_tail(1))
def latest_features(spark, sf):
    o, stats = fitted(spark, sf)
    return shown(forecasting.latest_features(o, stats, list(MODEL_SQL), regular=True, chunk=CHUNK))


@query(f"""WITH {sql_merged(15, 'user_id')}, e AS (SELECT location_id, count(*) >= 48 AS enough FROM merged GROUP BY 1)
SELECT count(*) AS n_locations, count(e.location_id) AS n_observed, count(*) FILTER (e.enough) AS n_trainable
FROM customer c LEFT JOIN e ON e.location_id = CAST(c_custkey AS VARCHAR)""")
def training_readiness(spark, sf):
    known = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("location_id"))
    return training.readiness(known, merged_cells(spark, sf, 15, "user_id"))
