"""Scaling, windows, samples, splits, scores, forecasts and rain estimates."""

import datetime as dt
import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.operators import align, features, metrics, present, rain, scaling, sequences
from isobar.plans import forecasting, training
from isobar.sources import tables
from tests.conftest import at


def series(spark, n, locations=("a",), seed=1):
    rng = random.Random(seed)
    rows = [(loc, at(15 * i), *[round(rng.gauss(m, s), 2) for m, s in ((15, 5), (50, 10), (3, 1), (180, 30), (1000, 5), (1, 1), (50, 20))])
            for loc in locations for i in range(n)]
    return spark.createDataFrame(rows, "location_id string, ts timestamp_ntz, " + ", ".join(f"{v} double" for v in C.CANONICAL))


@pytest.mark.parametrize("gather", [3, 50, 10**6])
def test_exact_median(spark, gather):
    rng = random.Random(2)
    xs = [rng.choice([0.0, 0.0, round(rng.gauss(5, 3), 1)]) for _ in range(801)]
    ys = [rng.gauss(0, 1) if rng.random() < 0.9 else None for _ in range(800)] + [float("inf")]
    df = spark.createDataFrame(list(zip(xs, ys, [None] * 801)), "x double, y double, z double")
    got = scaling.exact_medians(df, ["x", "y", "z"], gather)
    assert got["x"] == statistics.median(xs)
    assert got["y"] == statistics.median([y for y in ys if y is not None and abs(y) < 1e300])
    assert got["z"] is None
    assert scaling.exact_medians(spark.createDataFrame([(3.0,), (1.0,), (2.0,), (10.0,)], "v double"), ["v"])["v"] == 2.5


def test_scaler_round_trip_and_mismatch(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", None, 5.0), ("b", 4.0, 5.0), ("b", 10.0, 5.0)], "location_id string, x double, y double")
    stats = scaling.fit_scaler(df)
    r = {s["column"]: (s["median"], s["mean"], s["std_pop"]) for s in stats.collect()}
    assert r["x"] == pytest.approx((4, 4.75, statistics.pstdev([1, 4, 4, 10]))) and r["y"] == (5, 5, 1)
    back = scaling.denormalize(scaling.normalize(df, stats), stats)
    assert sorted(x.x for x in back.collect()) == pytest.approx([1, 4, 4, 10])
    with pytest.raises(ValueError):
        scaling.normalize(df.drop("y"), stats)
    assert scaling.normalize(df.drop("y"), stats, on_mismatch="refit").count() == 4
    assert scaling.approximate_medians(df, ["x"])["x"] == 4


def test_feature_selection_matches_published_list(spark):
    df = features.all_features(series(spark, 30), regular=True)
    assert features.select_features(df.columns) == [
        "temp_celsius", "relative_humidity_percent", "precipitation_mm", "wind_speed_ms", "pressure_hpa", "cloud_cover_percent",
        "hour_sin", "hour_cos", "month_sin", "month_cos", "temp_celsius_lag_1", "temp_celsius_lag_2", "relative_humidity_percent_lag_1",
        "relative_humidity_percent_lag_2", "precipitation_mm_lag_1", "precipitation_mm_lag_2", "heat_index", "pressure_change_3h",
        "temp_celsius_diff_1", "relative_humidity_percent_diff_1"]
    assert len(df.columns) - 9 == 7 * 28 + 15 + 5 + 10
    short = features.model_features(series(spark, 30), regular=True)
    wide = features.model_frame(df)
    assert short.columns == wide.columns
    assert sorted(map(str, short.collect())) == sorted(map(str, wide.collect()))


def test_long_windows_use_frames(spark):
    df = series(spark, 80).select("location_id", "ts", C.TEMP)
    out = features.moving_features(df, [C.TEMP], ["rolling"], windows=[60], regular=True, chunk=7).orderBy("ts").toPandas()
    want = df.orderBy("ts").toPandas()[C.TEMP].rolling(60)
    assert out[f"{C.TEMP}_rolling_mean_60"].dropna().tolist() == pytest.approx(want.mean().dropna().tolist())
    assert out[f"{C.TEMP}_rolling_std_60"].dropna().tolist() == pytest.approx(want.std().dropna().tolist())


def test_expected_columns(spark):
    df = series(spark, 1)
    assert features.expected_columns(df, ["nope", C.TEMP]) == [C.TEMP]
    with pytest.raises(ValueError):
        features.expected_columns(df, ["nope"])


@pytest.mark.parametrize("chunk,regular", [(7, True), (7, False), (4096, True)])
def test_window_count_and_content(spark, chunk, regular):
    df = series(spark, 60)
    out = sequences.windows(df, [C.TEMP, C.CLOUD], regular=regular, chunk=chunk, bucket_seconds=7200).orderBy("origin_ts").collect()
    rows = df.orderBy("ts").collect()
    assert len(out) == 13
    for i, r in enumerate(out):
        assert r.origin_ts == rows[i + 23].ts
        assert [x[0] for x in r.X] == pytest.approx([q.temp_celsius for q in rows[i:i + 24]], rel=1e-6)
        assert [y[5] for y in r.y] == pytest.approx([q.cloud_cover_percent for q in rows[i + 24:i + 48]], rel=1e-6)
    assert sequences.windows(series(spark, 47), [C.TEMP]).count() == 0


def test_sample_counts(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [("b", i) for i in range(7)], "location_id string, origin_ts int")
    out = sequences.balance(df, 40)
    assert {r.location_id: r["count"] for r in out.groupBy("location_id").count().collect()} == {"a": 40, "b": 40}
    assert out.filter("location_id = 'b' and copy = 0").count() == 7
    assert out.filter("location_id = 'a'").select("origin_ts").distinct().count() == 40
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sequences.balance(df.repartition(3), 40).collect()))


def test_split_sizes(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    out = sequences.split_exact(df, ["k"])
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert got == {"test": 150, "val": 150, "train": 700}
    assert sequences.split_sizes(13) == (9, 2, 2)
    share = {r.split: r["count"] for r in sequences.split_hashed(df, ["k"]).groupBy("split").count().collect()}
    assert sum(share.values()) == 1000 and 600 < share["train"] < 800


@pytest.mark.parametrize("n", [0, 1, 2, 13, 997])
def test_split_exact_with_equal_ranks(spark, n):
    """Sizes are exact and rows of equal rank go by their keys; only compared, never sent anywhere, when ranks differ."""
    df = spark.createDataFrame([(i,) for i in range(n)], "k bigint")
    n_train, n_val, n_test = sequences.split_sizes(n)
    for size in (1, 5, 10**9):
        near = F.pmod(F.col("k") * 7919, F.lit(size)) - 3
        for rank in (near, near * (1 << 33)):
            out = sequences.split_exact(df, ["k"], rank=rank)
            key = [(i * 7919 % size, i) for i in range(n)]
            place = {i: p for p, (_, i) in enumerate(sorted(key))}
            want = {i: "test" if p < n_test else "val" if p < n_test + n_val else "train" for i, p in place.items()}
            assert {r.k: r.split for r in out.collect()} == want
    if n == 997:
        plan = sequences.split_exact(df, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_metrics(spark):
    rows = [("temp_celsius", 1.0, 2.0), ("temp_celsius", 3.0, 4.0), ("temp_celsius", None, 4.0), ("precipitation_mm", 1.0, 1.0), ("precipitation_mm", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "variable string, prediction double, target double")
    got = {r.variable: r for r in metrics.per_variable(df).collect()}
    assert (got["temp_celsius"].mse, got["temp_celsius"].mae, got["temp_celsius"].r2, got["temp_celsius"].n) == (1, 1, 0, 2)
    assert got["precipitation_mm"].r2 == 0
    assert metrics.weighted_mse(df).first()[0] == pytest.approx(2 * 2 / 4)


def payload(current, hourly):
    return json.dumps({"current": current, "hourly": hourly, "minutely": [1]})


@pytest.mark.parametrize("current,hourly,p,label", [
    ({"humidity": 85, "clouds": 75, "rain": {"1h": 0.0}}, [{"pop": x, "rain": {"1h": 1} if i == 0 else None} for i, x in enumerate((.5, .4, .4, .1, 0, 0))], 1.0, "high"),
    ({"humidity": 85, "clouds": 0}, [{"pop": x} for x in (.5, .4, .4, .1, 0, 0, 1, 1)], 0.47, "medium"),
    ({"humidity": 80, "clouds": 70, "rain": {}}, [], 0.0, "low"),
    ({"rain": {"3h": 1.5}}, [{"rain": {}}], 0.4, "medium"),
    ({"rain": {}}, [{"rain": {"3h": 0.2}}], 0.1, "low"),
    ({}, [{}, {"rain": {"1h": 2}}, {"rain": {"1h": 2}}, {"rain": {"1h": 2}}], 0.3, "medium"),
])
def test_rain_estimate(spark, current, hourly, p, label):
    df = spark.createDataFrame([("a", payload(current, hourly))], "location_id string, payload string")
    r = rain.rain_results(tables.parse_payloads(df)).first()
    assert r.rain_probability == pytest.approx(p) and r.confidence_level == label
    # 0.1 added three times is just above 0.3.
    assert r.will_rain_next_6h == (p >= 0.3)
    assert len(r.hourly_forecast) == min(6, len(hourly))


def test_rain_fallback(spark):
    known = spark.createDataFrame([("a",), ("b",)], "location_id string")
    df = spark.createDataFrame([("a", payload({}, []))], "location_id string, payload string")
    got = {r.location_id: (r.rain_probability, r.model_type) for r in rain.rain_for_locations(known, tables.parse_payloads(df)).collect()}
    assert got == {"a": (0.0, "real_time_estimator"), "b": (0.1, "fallback")}


def test_payload_hours_are_cut(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"location_id": "a", "current": {"temp": 1}, "hourly": [{"dt": i} for i in range(48)]}))
    assert len(tables.read_payloads(spark, str(tmp_path)).first().hourly) == 24


def test_series_store(spark, tmp_path):
    path, cols = str(tmp_path / "kept"), "ts timestamp_ntz, temp_celsius double"
    empty = tables.read_series(spark, path, cols, "stations", "2024-01-01")
    assert empty.count() == 0 and "location_id" in empty.columns
    df = series(spark, 30, ("a", "b")).select("location_id", "ts", "temp_celsius")
    tables.write_series(df, path, "stations", "2024-01-01")
    tables.write_series(df.filter("location_id = 'a'").limit(5), path, "stations", "2024-01-01")
    back = tables.read_series(spark, path, cols, "stations", "2024-01-01")
    assert {r.location_id: r["count"] for r in back.groupBy("location_id").count().collect()} == {"a": 5, "b": 30}
    one = tables.read_series(spark, path, cols, "stations", "2024-01-01", ["b"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 30 and re.search(r"PartitionFilters: \[[^]]*\(bucket#\d+ = \d+\)", plan)
    assert tables.read_series(spark, path, cols, "reanalysis", "2024-01-01").count() == 0


def test_series_store_layout(spark, tmp_path):
    """Files follow months and buckets; months are pruned; a save without its marker is not read."""
    path, cols = str(tmp_path / "kept"), "ts timestamp_ntz, v double"
    hours = F.explode(F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-03-31 23:00:00', interval 1 hour)"))
    df = spark.range(40).select(F.col("id").cast("string").alias("location_id"), hours.alias("ts"), F.lit(1.0).alias("v"))
    tables.write_series(df, path, "grid", "2024", buckets=4)
    assert len(list((tmp_path / "kept").rglob("rows/**/*.parquet"))) == 3 * 4
    march = tables.read_series(spark, path, cols, "grid", "2024", months=("2024-03", "2024-12"))
    assert march.agg(F.min("ts"), F.count("*")).first() == (dt.datetime(2024, 3, 1), 40 * 31 * 24)
    assert re.search(r"PartitionFilters: \[[^]]*month#\d+ >= 2024-03", march._jdf.queryExecution().executedPlan().toString())
    tables.write_series(df.limit(0), path, "grid", "2024", buckets=4)
    tables.write_series(df.filter("location_id = '7'").limit(3), path, "grid", "2024", buckets=2)
    again = tables.read_series(spark, path, cols, "grid", "2024", ["7", "8", "none"])
    assert {r.location_id: r["count"] for r in again.groupBy("location_id").count().collect()} == {"7": 3, "8": 91 * 24}
    newest = max((tmp_path / "kept" / "places" / "source=grid" / "start=2024").iterdir())
    (newest / "_SUCCESS").rename(newest / "_STARTED")
    assert tables.read_series(spark, path, cols, "grid", "2024", ["7"]).count() == 91 * 24


def test_stored_tables(spark, tmp_path):
    stats = scaling.fit_scaler(series(spark, 10))
    tables.write_dataset_info(spark, str(tmp_path / "info"), ["x", "y"], ["x"], 24, 12, stats)
    info = tables.read_dataset_info(spark, str(tmp_path / "info"))
    assert (info["features"], info["targets"], info["input_steps"], info["output_steps"]) == (["x", "y"], ["x"], 24, 12)
    assert sorted(map(tuple, info["stats"].collect())) == sorted(map(tuple, stats.collect()))
    tables.write_feature_list(spark, str(tmp_path / "list"), ["b", "a"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["b", "a"]
    locs = spark.createDataFrame([("a", float("nan"), 1.0)], tables.LOCATIONS)
    tables.write_locations(locs, str(tmp_path / "loc"))
    assert tuple(tables.read_locations(spark, str(tmp_path / "loc")).first()) == ("a", None, 1.0)


def test_pushed_filters(spark, tmp_path):
    df = series(spark, 50)
    df.write.parquet(str(tmp_path / "o"))
    got = align.time_range(spark.read.parquet(str(tmp_path / "o")), F.expr("timestamp_ntz'2024-01-01 01:00:00'"),
                           F.expr("timestamp_ntz'2024-01-01 02:00:00'")).select("ts", C.TEMP)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 5
    assert "GreaterThanOrEqual(ts" in plan and C.PRESSURE not in plan


def test_train_and_forecast(spark, tmp_path):
    df = series(spark, 140, ("31000", "32000"))
    model, data, scores = training.train(spark, df, str(tmp_path / "m"), per_location=10)
    per = {r.variable: r for r in scores["per_variable"].collect()}
    assert set(per) == set(C.TARGETS) and all(r.n == 3 * 24 for r in per.values())
    assert scores["loss"].first()[0] > 0
    assert {r.split: r["count"] for r in data.samples.groupBy("split").count().collect()} == {"train": 14, "val": 3, "test": 3}
    known = spark.createDataFrame([("31000", 28.6, -106.0), ("33000", 28.1, -105.4)], tables.LOCATIONS)
    asked = spark.createDataFrame([("31000",), ("33000",), ("12",), ("99999",)], "code string")
    out = forecasting.forecast(asked, known, df, model, data.stats, data.features)
    rows = out.orderBy("code", "horizon").collect()
    good = [r for r in rows if r.code == "31000"]
    assert [r.time for r in good] == [f"+{15 * h}min" for h in range(1, 25)]
    assert good[0].timestamp == at(15 * 140) and good[0].error is None
    errors = {r.code: r.error for r in rows if r.error}
    assert errors == {"33000": forecasting.NO_DATA, "12": forecasting.INVALID, "99999": forecasting.UNKNOWN + "99999"}
    packed = present.pack_forecast(out.filter("error is null"))
    assert len(packed.first().forecast) == 24 and packed.first().model_info.n_steps == 24


def test_dataset_from_first_location(spark):
    data = training.build_dataset(series(spark, 60, ("a", "b")), per_location=5, fit_scope="first_location")
    stats = sequences.dataset_statistics(data.samples)
    assert {r.split: r.n_samples for r in stats.collect()} == {"train": 6, "val": 2, "test": 2}
    assert stats.first().n_features == 20
