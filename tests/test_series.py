"""Gap filling, alignment and moving features, against pandas and against other chunk sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.operators import align, features, series
from tests.conftest import at

_ = None
GOLDEN_IN = [_, 1, _, _, _, _, _, _, 8, _, _, _, _, _, _]
GOLDEN_LINEAR = [_, 1, 2, 3, 4, 5, _, _, 8, 8, 8, 8, 8, _, _]
GOLDEN_FILLED = [1, 1, 2, 3, 4, 5, 5, 5, 8, 8, 8, 8, 8, 8, 8]


def make(spark, values, step=15, loc="a"):
    rows = [(loc, at(i * step), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "location_id string, ts timestamp_ntz, v double")


def values(df, c="v"):
    return [r[c] for r in df.orderBy("location_id", "ts").collect()]


@pytest.mark.parametrize("chunk,bucket", [(1, 900), (3, 3600), (4, 10**6), (100, 3600)])
def test_interpolate_golden(spark, chunk, bucket):
    df = make(spark, GOLDEN_IN)
    assert values(align.interpolate(df, ["v"], 4, chunk=chunk, bucket_seconds=bucket)) == GOLDEN_LINEAR
    assert values(align.interpolate(df, ["v"], 4, fill="both", chunk=chunk, bucket_seconds=bucket)) == GOLDEN_FILLED


@pytest.mark.parametrize("chunk", [1, 3, 8, 1000])
def test_regular_series_golden(spark, chunk):
    df = make(spark, GOLDEN_IN)
    sparse = df.filter("v is not null or ts = '2024-01-01 00:00:00' or ts = '2024-01-01 03:30:00'")
    assert values(align.regular_series(sparse, ["v"], chunk=chunk)) == GOLDEN_FILLED
    assert values(align.regular_series(sparse, ["v"], fill="none", chunk=chunk)) == GOLDEN_LINEAR


def test_upsample_hourly(spark):
    df = make(spark, [1, None, 3], step=60)
    out = align.upsample(df, ["v"], chunk=3)
    assert values(out) == [1 + 0.25 * i for i in range(9)]


def test_spine(spark):
    ext = spark.sql("select 'a' location_id, timestamp_ntz'2024-09-15 12:00:00' start_ts, timestamp_ntz'2024-09-15 18:00:00' end_ts")
    for chunk in (1, 4, 25, 1000):
        rows = align.spine(ext, chunk=chunk).orderBy("ts").collect()
        assert len(rows) == 25
        assert {(b.ts - a.ts).seconds for a, b in zip(rows, rows[1:])} == {900}


def test_spine_stops_before_partial_step(spark):
    ext = spark.sql("select 'a' location_id, timestamp_ntz'2024-01-01 00:00:00.5' start_ts, timestamp_ntz'2024-01-01 00:30:00.2' end_ts")
    assert align.spine(ext).count() == 2


def random_frame(seed, n, share_missing=0.4, locations=3):
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(locations):
        ts = pd.date_range("2024-01-01", periods=n, freq="15min") + pd.Timedelta(minutes=15 * int(rng.integers(0, 50)))
        x = np.round(rng.normal(20, 8, n), 2)
        y = np.round(rng.uniform(0, 100, n), 2)
        x[rng.random(n) < share_missing] = np.nan
        y[rng.random(n) < 0.1] = np.nan
        parts.append(pd.DataFrame({"location_id": f"l{k}", "ts": ts, "x": x, "y": y}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, pdf):
    rows = [(r.location_id, r.ts.to_pydatetime(), *(None if np.isnan(v) else float(v) for v in (r.x, r.y)))
            for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "location_id string, ts timestamp_ntz, x double, y double")


@pytest.mark.parametrize("chunk", [5, 16, 4096])
def test_interpolation_matches_pandas(spark, chunk):
    pdf = random_frame(1, 90, 0.8)
    got = align.interpolate(to_spark(spark, pdf), ["x", "y"], 4, fill="both", chunk=chunk, bucket_seconds=7200)
    got = got.orderBy("location_id", "ts").toPandas()
    want = pd.concat([
        g[["x", "y"]].interpolate(method="linear", limit=4).ffill().bfill() for _, g in pdf.groupby("location_id")
    ])
    np.testing.assert_allclose(got[["x", "y"]].to_numpy(), want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("chunk,regular", [(13, True), (13, False), (4096, True), (20, False)])
def test_moving_features_match_pandas(spark, chunk, regular):
    pdf = random_frame(2, 80)
    got = features.moving_features(to_spark(spark, pdf), ["x", "y"], chunk=chunk, regular=regular, bucket_seconds=5400)
    got = got.orderBy("location_id", "ts").toPandas()
    assert len(got) == len(pdf)
    for _, g in pdf.groupby("location_id"):
        mine = got[got.location_id == g.location_id.iloc[0]]
        for v in ("x", "y"):
            s = g[v]
            for k in C.LAGS:
                np.testing.assert_allclose(mine[f"{v}_lag_{k}"].astype(float), s.shift(k))
            for w in C.WINDOWS:
                r = s.rolling(w)
                for name, want in (("rolling_mean", r.mean()), ("rolling_std", r.std()), ("rolling_min", r.min()),
                                   ("rolling_max", r.max()), ("cumsum", r.sum()), ("cummean", r.mean())):
                    np.testing.assert_allclose(mine[f"{v}_{name}_{w}"].astype(float), want, rtol=1e-9, atol=1e-9)
            for d in C.DIFFS:
                np.testing.assert_allclose(mine[f"{v}_diff_{d}"].astype(float), s.diff(d))
                np.testing.assert_allclose(mine[f"{v}_rate_{d}"].astype(float), s.diff(d) / d)


def test_lag_counts_rows_when_irregular(spark):
    df = make(spark, [1, 2, 3, 4]).filter("v <> 2")
    out = features.moving_features(df, ["v"], ["lag"], lags=[1], bucket_seconds=900)
    assert values(out, "v_lag_1") == [None, 1, 3]


def test_row_positions_are_exact(spark):
    df = to_spark(spark, random_frame(3, 60))
    out = series.row_positions(df, ["location_id"], [F.col("ts")], F.hour("ts") + 24 * F.dayofyear("ts"))
    for loc in ("l0", "l1", "l2"):
        rows = out.filter(F.col("location_id") == loc).orderBy("ts").collect()
        assert [r.pos for r in rows] == list(range(60))


def sources(spark):
    def frame(rows, cols):
        return spark.createDataFrame(rows, "location_id string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in cols))

    stations = frame([("a", at(0), 10.0, None), ("a", at(60), 14.0, 1.0), ("b", at(0), None, 2.0), ("b", at(30), None, 4.0)],
                     ["temperature_celsius", "precipitation_mm"])
    grid = frame([("a", at(0), 99.0, 50.0), ("a", at(120), 99.0, 70.0), ("b", at(15), 5.0, 10.0), ("b", at(31), 7.0, 20.0)],
                 ["temperature_celsius", "cloud_cover_percent"])
    sat = frame([("a", at(30), 0.5)], ["precipitation_mm"])
    return {"stations": stations, "reanalysis": grid, "satellite": sat}


@pytest.mark.parametrize("chunk", [2, 5, 1000])
def test_unify_by_column(spark, chunk):
    out = align.unify(sources(spark), chunk=chunk).orderBy("location_id", "ts").collect()
    a = [r for r in out if r.location_id == "a"]
    b = [r for r in out if r.location_id == "b"]
    assert len(a) == 9 and len(b) == 3  # b ends at 00:31, the grid at 00:30
    assert [r.temp_celsius for r in a] == [10, 11, 12, 13, 14, 14, 14, 14, 14]
    assert {r.precipitation_mm for r in a} == {0.5}
    assert [r.cloud_cover_percent for r in a] == [50, 52.5, 55, 57.5, 60, 60, 60, 60, 70]
    assert [r.temp_celsius for r in b] == [5, 5, 5]
    assert [r.precipitation_mm for r in b] == [2, 3, 4]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_unify_by_row(spark, chunk):
    out = align.unify(sources(spark), mode="row", chunk=chunk).orderBy("location_id", "ts").collect()
    a = [r for r in out if r.location_id == "a"]
    assert [r.temp_celsius for r in a] == [10, 11, 12, 13, 14, 14, 14, 14, 14]
    assert [r.precipitation_mm for r in a] == [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 1, 1]


def test_row_mode_matches_pandas(spark):
    rng = np.random.default_rng(5)
    ts = pd.date_range("2024-01-01", periods=70, freq="15min")
    x, y = np.round(rng.normal(0, 5, 70), 2), np.round(rng.normal(0, 5, 70), 2)
    x[rng.random(70) < 0.85] = np.nan
    y[rng.random(70) < 0.85] = np.nan
    pdf = pd.DataFrame({"location_id": "a", "ts": ts, "x": x, "y": y})
    df = to_spark(spark, pdf)
    st = df.select("location_id", "ts", F.col("x").alias("temperature_celsius"))
    gr = df.select("location_id", "ts", F.col("y").alias("temperature_celsius"))
    got = align.unify({"stations": st, "reanalysis": gr}, mode="row", chunk=9).orderBy("ts").toPandas().temp_celsius
    fx, fy = (pdf[c].interpolate(method="linear", limit=4) for c in ("x", "y"))
    np.testing.assert_allclose(got, fx.fillna(fy).ffill().bfill(), rtol=1e-12)


def test_snap_keeps_off_grid_rows(spark):
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(17), 3.0), ("a", at(20), 4.0), ("a", at(30), 2.0)],
                               "location_id string, ts timestamp_ntz, temperature_celsius double")
    out = align.unify({"stations": df}, snap="floor")
    assert values(out, "temp_celsius") == [1, 4, 2]
    assert values(align.unify({"stations": df}), "temp_celsius") == [1, 1.5, 2]


def test_fallback_and_recent(spark):
    enough = make(spark, range(25), loc="a").unionByName(make(spark, range(5), loc="b"))
    other = make(spark, range(30), loc="a").unionByName(make(spark, range(30), loc="b"))
    out = align.with_fallback(enough, other, 20).groupBy("location_id", "source_kind").count().collect()
    assert {(r.location_id, r.source_kind, r["count"]) for r in out} == {("a", "observed", 25), ("b", "fallback", 30)}
    ref = F.expr("timestamp_ntz'2024-01-01 06:00:00'")
    assert align.recent(enough, ref, 6, 20).select("location_id").distinct().count() == 1
    assert align.latest(enough, 24, complete_only=True).count() == 24


def test_series_with_one_location_is_split(spark):
    df = make(spark, range(2000))
    w = series.with_halo(df.withColumn("pos", F.expr("cast(v as bigint)")), ["location_id"], "pos", 12, chunk=100)
    sizes = [r["count"] for r in w.groupBy(series.CHUNK_COL).count().collect()]
    assert max(sizes) <= 112 and len(sizes) == 21


def test_all_features_use_one_shuffle(spark):
    df = make(spark, range(50)).withColumnRenamed("v", C.TEMP)
    plan = features.all_features(df, regular=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan
