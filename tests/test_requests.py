"""Windows at chosen origins, newest rows before features, and requests by code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.operators import scaling, sequences
from isobar.plans import forecasting, training
from isobar.sources import tables
from tests.conftest import at
from tests.test_datasets import series


def test_windows_at_origins_equal_all_windows(spark):
    df = series(spark, 130, ("a", "b"))
    names = [C.TEMP, C.PRESSURE]
    whole = sequences.windows(df, names, regular=True, chunk=32)
    random.seed(3)
    picked = [(r.location_id, r.origin_ts, k % 3) for k, r in enumerate(random.sample(whole.select("location_id", "origin_ts").collect(), 20))]
    first = df.agg(F.min("ts")).first()[0]
    origins = spark.createDataFrame([*picked, ("a", first, 9), (*picked[0][:2], 7)], "location_id string, origin_ts timestamp_ntz, copy int")
    for kind in ("window", "last"):
        got = sequences.windows_at(df, origins, names, inputs=kind)
        want = sequences.windows(df, names, inputs=kind, regular=True, chunk=32).join(origins, ["location_id", "origin_ts"])
        assert got.count() == 21
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert sequences.windows_at(df, origins.limit(0), names).count() == 0


def test_rows_join_their_origins_before_anything_is_put_together(spark):
    data = training.build_dataset(series(spark, 60, ("a", "b")), per_location=3)
    plan = data.samples._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Aggregate") < plan.rindex("Join")


def test_statistics_leave_held_out_windows_out(spark):
    df = series(spark, 200, ("a",))
    ticks = df.select("location_id", "ts").orderBy("ts").collect()
    origins = spark.createDataFrame([("a", ticks[i].ts) for i in (60, 70)], "location_id string, origin_ts timestamp_ntz")
    left = {r.ts for r in sequences.outside_windows(df, origins).collect()}
    assert left == {r.ts for i, r in enumerate(ticks) if not 37 <= i <= 94}


def test_only_newest_rows_reach_the_features(spark, tmp_path):
    series(spark, 300, ("a", "b")).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    names = [C.TEMP, "pressure_change_3h"]
    stats = {n: (0.0, 0.0, 1.0) for n in names}
    for out in (forecasting.prediction_input(df, stats, names), forecasting.latest_features(df, stats, names)):
        plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
        limits, shuffles = [i for i, x in enumerate(plan) if "WindowGroupLimit" in x], [i for i, x in enumerate(plan) if "Exchange" in x]
        # Plans are printed from the end: the deepest limit stands below the deepest shuffle.
        assert max(limits) > max(shuffles)


def test_places_of_requests(spark):
    known = spark.createDataFrame([("00005", 25.0, -105.0), ("31000", 28.7, -106.1), ("32000", 31.6, -106.4), ("31500", 29.5, -107.0)], tables.LOCATIONS)
    served = spark.createDataFrame([("31500",), ("32000",), ("32000",), ("00005",)], "location_id string")
    codes = ["5", "00005", "31999", "31000", "99999", "33001", None, "123456", "00005"]
    asked = spark.createDataFrame([(c,) for c in codes], "code string")
    got = sorted(((r.code, r.match_kind, r.place, r.error) for r in forecasting.resolve_requests(asked, known, served).collect()), key=str)
    assert got == sorted([
        ("5", "exact", None, C.ERROR_INVALID), ("00005", "exact", "00005", None), ("00005", "exact", "00005", None), ("31999", "prefix", "31500", None),
        ("31000", "exact", "31000", None), ("99999", "none", None, C.ERROR_UNKNOWN + "99999"), ("33001", "prefix", "31500", None),
        (None, "none", None, C.ERROR_INVALID), ("123456", "none", None, C.ERROR_INVALID)], key=str)
    nothing = forecasting.resolve_requests(asked, known, served.limit(0)).filter("code = '31999'").first()
    assert nothing.place is None and nothing.error is None


def test_forecast_of_short_prefix_and_known_codes(spark):
    df = series(spark, 140, ("00005", "32000"))
    model, data, _ = training.train(spark, df, per_location=10)
    known = spark.createDataFrame([("00005", 28.6, -106.0), ("32000", 31.6, -106.4), ("31000", 28.7, -106.1)], tables.LOCATIONS)
    asked = spark.createDataFrame([(c,) for c in ("5", "00005", "31999", "31000", "5")], "code string")
    out = forecasting.forecast(asked, known, df, model, data.stats, data.features).collect()
    count = {c: sum(r.code == c and r.horizon is not None for r in out) for c in ("5", "00005", "31999", "31000")}
    assert count == {"5": 0, "00005": 24, "31999": 24, "31000": 0} and len(out) == 50
    assert {(r.code, r.error) for r in out if r.error} == {("5", C.ERROR_INVALID), ("31000", C.ERROR_NO_DATA)}
    assert {(r.lat, r.lon) for r in out if r.code == "31999"} == {(28.632, -106.069)}
    steps = {c: sorted((r.horizon, r.temp) for r in out if r.code == c) for c in ("00005", "31999")}
    assert steps["00005"] == steps["31999"]


def test_forecaster_equals_least_squares_and_is_kept(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, targets = rng.normal(size=(80, 3)), C.TARGETS[:2]
    y = rng.normal(size=(80, 24, 2)) + (x @ rng.normal(size=(3, 2)))[:, None, :]
    rows = [("a", at(15 * i), *map(float, x[i]), [[float(v) for v in step] for step in y[i]]) for i in range(80)]
    df = spark.createDataFrame(rows, "location_id string, origin_ts timestamp_ntz, f0 double, f1 double, f2 double, y array<array<float>>").repartition(3)
    model = training.fit_forecaster(df, ["f0", "f1", "f2"], targets, reg=0.0)
    # Every step is a row of its own with an indicator of its step.
    wide = np.concatenate([np.repeat(x, 24, 0), np.tile(np.eye(24), (80, 1))], 1)
    best = np.linalg.lstsq(wide, y.astype(np.float32).astype(float).reshape(-1, 2), rcond=None)[0]
    assert np.allclose(model.slopes, best[:3].T) and np.allclose(model.intercepts, best[3:].T)
    model.write(spark, str(tmp_path / "m"))
    again = training.Forecaster.read(spark, str(tmp_path / "m"), model.features, targets)
    assert again == model
    got = training.score(again, df.drop("y"), targets).filter("horizon = 5").orderBy("origin_ts").collect()
    assert np.allclose([r[targets[1]] for r in got], (wide @ best).reshape(80, 24, 2)[:, 4, 1])
    with pytest.raises(ValueError):
        training.fit_forecaster(df.limit(0), ["f0"], targets)


def test_medians_of_ties_tails_and_extremes(spark):
    rng = random.Random(9)
    columns = {
        "ties": [float(rng.randrange(3)) for _ in range(501)], "even": [1.0, 2.0] * 250 + [None], "one": [7.5] * 501,
        "tail": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(501)], "none": [None] * 501,
        "close": [1.0 + k * 2 ** -52 for k in range(500)] + [1e18], "huge": [-1.7e308, 1.7e308] * 250 + [float("inf")],
        "mixed": [None if k % 7 == 0 else float("nan") if k % 7 == 1 else rng.gauss(0, 1) for k in range(501)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(4)
    for bins in (32, 512):
        got = scaling.exact_medians(df, list(columns), bins)
        for c, values in columns.items():
            known = [v for v in values if v is not None and np.isfinite(v)]
            assert got[c] == (float(np.median(known)) if known else None), c
