"""The collection job on small hand-made tables."""

from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.timegrid import at as instant
from isobar.plans import collection
from tests.conftest import at


def collect(*tables, **options):
    return collection.collect(*tables, instant("2024-01-01 00:00:00"), instant("2024-01-01 06:00:00"), **options)


def tables(spark):
    asked = spark.createDataFrame([("1",), ("00001",), ("2",), ("3",), ("99",), (None,)], "code string")
    known = spark.createDataFrame([("00001", 28.0, -106.0), ("00002", 28.0, -100.0), ("00003", 20.0, -90.0)], "location_id string, lat double, lon double")
    station = spark.createDataFrame([("s", "S", None, None, 28.1, -106.0, None)],
                                    "station_id string, name string, country string, region string, latitude double, longitude double, elevation double")
    seen = spark.createDataFrame([("s", at(60 * h), 10.0 + h, 36.0) for h in range(-2, 9)], "station_id string, ts timestamp_ntz, temp double, wspd double")
    # Two rows only, 30 minutes apart, near place 2.
    rain = spark.createDataFrame([(at(0), 28.2, -100.1, 1.0), (at(30), 28.2, -100.1, -5.0)], "ts timestamp_ntz, latitude double, longitude double, precipitationCal double")
    return asked, known, collection.Landed(station, seen, None, rain)


def test_each_place_by_its_own_rows(spark):
    asked, known, landed = tables(spark)
    rows = collect(asked, known, landed).collect()
    kinds = {(r["location_id"], r["source_kind"]) for r in rows}
    assert kinds == {("00001", "observed"), ("00002", "fallback"), ("00003", "fallback")}
    first = sorted((r["ts"], r[C.TEMP], r[C.WIND_SPEED]) for r in rows if r["location_id"] == "00001")
    # The period cuts the reports at 00:00 and 06:00; hours are interpolated in quarters.
    assert len(first) == 25 and first[0] == (at(0), 10.0, 10.0) and first[1][1] == 10.25 and first[-1][:2] == (at(360), 16.0)
    assert sum(r["location_id"] == "00003" for r in rows) == 25
    few = collect(asked, known, landed, min_rows=3).filter("location_id = '00002'")
    assert [(r["ts"], r[C.PRECIP], r["source_kind"]) for r in few.orderBy("ts").collect()] == [
        (at(0), 1.0, "observed"), (at(15), 0.5, "observed"), (at(30), 0.0, "observed")]


def test_given_stand_in_and_no_sources(spark):
    asked, known, landed = tables(spark)
    stand_in = spark.createDataFrame([(k, at(m), 1.0) for k in ("00001", "00003", "x") for m in (0, 15, 999)], f"location_id string, ts timestamp_ntz, {C.TEMP} double")
    rows = collect(asked, known, landed, stand_in=stand_in).filter("source_kind = 'fallback'").collect()
    assert sorted((r["location_id"], r["ts"], r[C.TEMP]) for r in rows) == [("00003", at(0), 1.0), ("00003", at(15), 1.0)]
    none = collect(asked, known, collection.Landed())
    assert none.groupBy("location_id").count().filter(F.col("count") == 25).count() == 3
    assert collect(asked.limit(0), known, landed).count() == 0


def test_normals_are_made_after_the_places_are_chosen(spark):
    asked, known, landed = tables(spark)
    plan = collect(asked, known, landed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("LeftAnti", plan.index("Generate"))
    assert "Python" not in plan
