"""Locations, stations and grids against brute force and known values."""

import functools
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import workload
from isobar import constants as C
from isobar.operators import grids, locations, stations
from isobar.sources import tables
from tests.conftest import at


def km(a, b):
    la, lo, lb, lob = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2
    return 2 * C.EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h)))


def test_city_table(spark):
    rows = locations.city_locations(spark).collect()
    assert len(rows) == 34
    prefixes = [r.location_id[:2] for r in rows]
    assert [prefixes.count(p) for p in ("31", "32", "33")] == [14, 8, 12]
    by = {r.location_id: (r.lat, r.lon) for r in rows}
    assert by["33200"] == (27.0333, -106.0833)


def test_clean_codes(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_bytes(
        "c_estado,d_cp,latitud,longitud,nombre\n08,5,28.1,-106.1,Mé\nchihuahua,123456,28.2,-106.2,x\n08,5,28.9,-106.9,x\n"
        "09,7,28.1,-106.1,x\n08,8,n/a,-106.1,x\n08,9,40,-106.1,x\n".encode("latin-1"))
    raw = tables.read_postal_csv(spark, str(path))
    got = {r.location_id: (r.lat, r.lon) for r in locations.clean_locations(raw).collect()}
    assert got == {"00005": (28.9, -106.9), "123456": (28.2, -106.2)}
    assert "Mé" in [r.nombre for r in raw.collect()]
    none = locations.build_locations(raw.select("d_cp", "row_seq"), locations.city_locations(spark))
    assert none.count() == 34


def test_last_entry_over_cut_and_packed_files(spark, tmp_path):
    """Files are cut into blocks and packed by size; the last row in path and line order still counts."""
    sizes = [3, 400, 1, 90]
    for i, n in enumerate(sizes):
        lines = [f"08,{k % 7},28.{i}{k:04d},-106.5" for k in range(n)]
        (tmp_path / f"part-{i}.csv").write_text("c_estado,d_cp,latitud,longitud\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        raw = tables.read_postal_csv(spark, str(tmp_path))
        got = {r.location_id: r.lat for r in locations.clean_locations(raw).collect()}
        parts = raw.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = {f"{k % 7:05d}": float(f"28.{i}{k:04d}") for i, n in enumerate(sizes) for k in range(n)}
    assert parts > 4 and got == want


def test_lookup_kinds(spark):
    asked = spark.createDataFrame([("31000",), ("31999",), ("99999",), ("5",)], "code string")
    got = {r.code: (r.match_kind, r.lat) for r in locations.lookup(asked, locations.city_locations(spark)).collect()}
    assert got == {"31000": ("exact", 28.6320), "31999": ("prefix", 28.6320), "99999": ("none", None), "5": ("none", None)}


@pytest.mark.parametrize("radius,low,high,salts", [(300, -85, 88, 1), (40, 20, 35, 3), (2000, -89.9, 89.9, 1)])
def test_radius_matches_brute_force(spark, radius, low, high, salts):
    rng = random.Random(radius)
    pts = [(f"p{i}", rng.uniform(low, high), rng.choice([rng.uniform(-180, 180), 179.9, -179.9, -106.0])) for i in range(250)]
    cen = [(f"c{i}", rng.uniform(low, high), rng.choice([rng.uniform(-180, 180), 179.95, -106.1])) for i in range(80)]
    p = spark.createDataFrame(pts, "location_id string, lat double, lon double")
    c = spark.createDataFrame(cen, "center_id string, lat double, lon double")
    got = [(r.center_id, r.location_id) for r in locations.within_radius(c, p, radius, salts=salts).collect()]
    want = {(a, b) for a, la, lo in cen for b, lb, lob in pts if km((la, lo), (lb, lob)) <= radius}
    assert len(got) == len(set(got))
    assert set(got) == want and want


@pytest.mark.parametrize("capacity,k,radius,lat", [(64, 3, 80, 28.0), (4, 3, 80, 28.0), (2, 5, 300, 88.5), (1, 1, 80, -28.0)])
def test_nearest_stations_with_piles_and_clusters(spark, capacity, k, radius, lat):
    rng = random.Random(4)
    spot = lambda: (rng.uniform(lat - 1, lat + 1), rng.uniform(178, 182) if lat > 80 else rng.uniform(-107, -105))
    wrap = lambda x: (x + 180) % 360 - 180
    st = [(f"s{i:03d}", lat, -106.0) for i in range(50)] + [(f"t{i:03d}", y, wrap(x)) for i in range(60) for y, x in [spot()]]
    st += [(f"u{i:03d}", lat + rng.uniform(0, 1e-3), -106 + rng.uniform(0, 1e-3)) for i in range(60)]
    lo = [(f"l{i:03d}", lat + 0.01, -106.01) for i in range(30)] + [(f"m{i:03d}", y, wrap(x)) for i in range(30) for y, x in [spot()]]
    s = spark.createDataFrame(st, "station_id string, latitude double, longitude double")
    l = spark.createDataFrame(lo, "location_id string, lat double, lon double")
    got = {}
    for r in stations.nearest_stations(l, s, radius, k, capacity=capacity, salts=2).orderBy("location_id", "rank").collect():
        got.setdefault(r.location_id, []).append((r.distance_km, r.station_id))
    for name, la, lon in lo:
        near = sorted((km((la, lon), (a, b)), n) for n, a, b in st if km((la, lon), (a, b)) <= radius)[:k]
        mine = got.get(name, [])
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in near], abs=1e-6)
        if lat < 80:
            assert [n for _, n in mine] == [n for _, n in near]


def test_station_details_get_defaults(spark):
    near = spark.createDataFrame([("a", "s1", 1.0, 1)], "location_id string, station_id string, distance_km double, rank int")
    s = spark.createDataFrame([("s1", None, None, None, 28.0, -106.0, None)], tables.STATIONS)
    r = stations.with_station_details(near, s).first()
    assert (r["name"], r.country, r.elevation) == ("Unknown", "", 0.0)


def test_weighted_merge(spark):
    rows = [("a", at(0), 20.0, 1.0), ("a", at(0), 10.0, 0.1), ("a", at(60), 20.0, 1.0), ("a", at(60), None, 0.1)]
    df = spark.createDataFrame(rows, "location_id string, ts timestamp_ntz, temperature_celsius double, weight double")
    got = [r.temperature_celsius for r in stations.merge_stations(df).orderBy("ts").collect()]
    assert got == pytest.approx([19.09090909, 18.18181818])
    got = [r.temperature_celsius for r in stations.merge_stations(df, denominator="per_variable").orderBy("ts").collect()]
    assert got == pytest.approx([19.09090909, 20.0])


def test_circular_wind(spark):
    df = spark.createDataFrame([("a", at(0), 350.0, 1.0), ("a", at(0), 20.0, 1.0)],
                               "location_id string, ts timestamp_ntz, wind_direction_deg double, weight double")
    assert stations.merge_stations(df, wind="circular").first().wind_direction_deg == pytest.approx(5)
    assert stations.merge_stations(df).first().wind_direction_deg == pytest.approx(185)


def test_salted_observations_are_the_same(spark):
    obs = spark.createDataFrame([(f"s{i % 3}", at(i), float(i)) for i in range(30)], "station_id string, ts timestamp_ntz, temp double")
    near = spark.createDataFrame([("a", "s0", 1.0), ("b", "s0", 2.0), ("b", "s2", 0.0)], "location_id string, station_id string, distance_km double")
    plain = stations.weighted_observations(obs, near).collect()
    salted = stations.weighted_observations(obs, near, salts=4).select(*stations.weighted_observations(obs, near).columns).collect()
    assert sorted(plain) == sorted(salted) and len(plain) == 30


@pytest.mark.parametrize("ascending", [True, False])
def test_nearest_axis_value(spark, ascending):
    rng = random.Random(1)
    axis = [x / 4 for x in range(80, 140, 3)]
    vals = [rng.choice([rng.uniform(10, 50), rng.choice(axis) + 0.375, rng.choice(axis)]) for _ in range(200)]
    a = spark.createDataFrame([(x,) for x in axis], "lat double")
    v = spark.createDataFrame([(x,) for x in vals], "lat double")
    order = sorted(axis, reverse=not ascending)
    for r in grids.nearest_axis_value(v, a, "lat", ascending).collect():
        assert r.nearest == min(order, key=lambda x: abs(x - r.lat))


def test_reanalysis_aliases(spark):
    df = spark.sql("""select 'a' location_id, timestamp_ntz'2024-01-01 00:00:00' valid_time, 293.15D `2m_temperature`,
      283.15D d2m, 90000D sp, 100000D surface_pressure, 0.5D tcc, 3D `10m_u_component_of_wind`, 4D `10m_v_component_of_wind`""")
    r = grids.canonical_reanalysis(df).first()
    assert r.temperature_celsius == pytest.approx(20) and r.relative_humidity_percent == pytest.approx(52.54132558)
    assert (r.pressure_hpa, r.cloud_cover_percent, r.wind_speed_ms) == (1000, 50, 5)
    with_rh = df.withColumn("rh", F.lit(33.0))
    assert grids.canonical_reanalysis(with_rh).first().relative_humidity_percent == 33


def test_stratified_sample_quotas(spark):
    codes = [f"31{i:03d}" for i in range(20)] + [f"32{i:03d}" for i in range(3)] + [f"33{i:03d}" for i in range(9)] + ["40000"]
    df = spark.createDataFrame([(c,) for c in codes], "location_id string")
    got = sorted(r.location_id[:2] for r in locations.stratified_sample(df, 10).collect())
    assert got == ["31"] * 4 + ["32"] * 3 + ["33"] * 3
    few = df.filter("location_id >= '33005'")
    assert locations.stratified_sample(few, 10).count() == few.count()


def test_radius_search_of_small_tables_is_dealt_over_tasks(spark):
    """Few bytes, many pairs: cells go to all shuffle partitions, a crowded cell's centers to several."""
    rng = random.Random(5)
    rows = lambda name, n: [(f"{name}{i}", 28 + rng.uniform(0, 0.2), -106 + rng.uniform(0, 0.2)) for i in range(n)] + [(None, None, -106.0)]
    c = spark.createDataFrame(rows("c", 200), "center_id string, lat double, lon double").coalesce(1)
    p = spark.createDataFrame(rows("p", 300), "location_id string, lat double, lon double").coalesce(1)
    near = locations.within_radius(c, p, 60, capacity=10)
    assert near.count() == 200 * 300 and near.columns == ["center_id", "lat", "lon", "location_id", "_plat", "_plon", "distance_km"]
    used = near.select(F.spark_partition_id().alias("p")).distinct().count()
    assert near.rdd.getNumPartitions() == 8 and used > 4


def test_ranks_come_in_order_by_one_shuffle(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "c", None]), f"p{i % 90:02d}", rng.choice([0.0, 4.0, 5.0, rng.uniform(0, 60)])) for i in range(400)]
    pairs = spark.createDataFrame(rows, "center_id string, location_id string, distance_km double")
    ranked = locations.ranked_by_distance(pairs, 5.0)
    got = [(r.center_id or "", r["rank"], r.distance_km, r.location_id) for r in ranked.collect()]
    want = []
    for c in ("", "a", "b", "c"):
        mine = sorted((d, p) for x, p, d in rows if (x or "") == c)
        want += [(c, i, d, p) for i, (d, p) in enumerate(mine, 1)]
    assert got == want
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan and "Sort" not in plan


def test_grid_columns_are_worked_out_once_per_grid_row(spark):
    """Many locations at one point: a column of the grid is computed before the rows are repeated."""
    g = spark.createDataFrame([(28.0, -106.0, 280.0 + i) for i in range(5)] + [(20.0, -106.0, 1.0)], "latitude double, longitude double, t2m double")
    points = spark.createDataFrame([(f"l{i}", 28.0, -106.0) for i in range(50)], "location_id string, grid_lat double, grid_lon double")
    rows = grids.rows_at_points(g, points)
    assert rows.count() == 5
    out = grids.extract_points(rows.withColumn("t", F.round(F.exp("t2m"), 3)), points, deal=True)
    assert out.count() == 250 and out.distinct().count() == 250
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Repartition") < plan.index("round(")


def shuffled_rows(df):
    """Rows that all shuffles of a frame write, counted as it runs."""
    df._jdf.collectToPython()

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            return walk(node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_radius_search_shuffles_its_inputs_not_their_product(spark):
    """Points were copied to nine cells for each 256 centers, and dealt twice, so the shuffle grew with the product."""
    rng = random.Random(7)
    rows = lambda name, n: [(f"{name}{i}", 28 + rng.uniform(0, 0.5), -106 + rng.uniform(0, 0.5)) for i in range(n)]
    c = spark.createDataFrame(rows("c", 400), "center_id string, lat double, lon double")
    p = spark.createDataFrame(rows("p", 3000), "location_id string, lat double, lon double")
    near = locations.within_radius(c, p, 60).select("center_id", "location_id", "distance_km")
    assert shuffled_rows(near) < 3000 + 9 * 400 + 500


@pytest.mark.parametrize("copied", ["centers", "points"])
@pytest.mark.parametrize("radius,lat,capacity", [(30, 28.0, 3), (500, 88.0, 7), (0.001, 28.0, 2)])
def test_crowded_cells_are_cut_on_both_sides(spark, copied, radius, lat, capacity):
    rng = random.Random(8)
    size = radius / 60
    spot = lambda: (min(lat + rng.uniform(0, size), 90.0), (rng.uniform(-180, 180) if lat > 80 else -106 + rng.uniform(0, size)))
    cen = [(rng.choice([None, f"c{i}"]), *spot()) for i in range(60)] + [("twice", 28.0, -106.0)] * 2
    pts = [(rng.choice([None, f"p{i}"]), *spot()) for i in range(150)] + [("twice", 28.0, -106.0)] * 3
    c = spark.createDataFrame([*cen, ("x", None, 1.0)], "center_id string, lat double, lon double")
    p = spark.createDataFrame([*pts, ("y", float("nan"), 1.0)], "location_id string, lat double, lon double")
    got = locations.within_radius(c, p, radius, salts=2, capacity=capacity, copied=copied).collect()
    found = sorted((r.lat, r.lon, r._plat, r._plon, r.center_id or "", r.location_id or "") for r in got)
    want = [(*a, *b, i or "", j or "") for i, *a in cen for j, *b in pts if km(a, b) <= radius]
    assert found == sorted(want) and want
    assert all(r.distance_km == pytest.approx(km((r.lat, r.lon), (r._plat, r._plon)), abs=1e-9) for r in got)


def test_digits_of_a_column_are_those_of_round(spark):
    from workload.base import digits, digits_of
    rng = random.Random(9)
    values = [0.0, -0.0, 1e-7, -1e-7, 5e-7, 0.0000015, -2.5e-6, 1.0000005, 2.675, 59.9999995, 59.9999994999, 99999.9999999, 1e5, 1e17, -1e300,
              float("nan"), float("inf"), None, *[rng.uniform(-1, 1) * 10 ** rng.randint(-8, 8) for _ in range(3000)],
              *[(2 * rng.randint(0, 10**8) + 1) / 2e6 for _ in range(1000)], *[rng.randint(0, 10**9) / 1e6 for _ in range(500)]]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(digits("v", 6).alias("a"), digits_of("v", 6).alias("b"))
    assert all(repr(r.a) == repr(r.b) for r in df.collect())


@pytest.mark.parametrize("lat,work", [(28.0, 16_000_000), (28.0, 500), (89.5, 900)])
def test_ranks_of_shares_need_no_shuffle_of_pairs(spark, lat, work):
    """Pairs were kept as a table and shuffled; now only centers and points are, however many shares there are."""
    rng = random.Random(11)
    spot = lambda: (min(lat + rng.uniform(0, 0.7), 90.0), rng.uniform(-180, 180) if lat > 80 else -106 + rng.uniform(0, 0.7))
    cen = [(f"c{i}", *spot()) for i in range(40)] + [("c50", 28.0, -106.0)] * 2
    pts = [(f"p{i:03d}", *spot()) for i in range(300)] + [("p007", 28.0, -106.0)] * 3 + [(None, 28.0, -106.0)]
    c = spark.createDataFrame([*cen, ("x", None, 1.0)], "center_id string, lat double, lon double")
    p = spark.createDataFrame([*pts, ("y", float("nan"), 1.0)], "location_id string, lat double, lon double")
    shares = locations.within_radius_of_shares(c, p, 60, work=work)
    assert (len(shares) > 1) == (work < 1000)
    ranked = [locations.ranked_by_distance(s, 5.0, dealt_by=locations.CELL) for s in shares]
    out = functools.reduce(DataFrame.unionAll, ranked).select("center_id", "location_id", "distance_km", "rank")
    got = sorted((r.center_id, r["rank"], r.location_id or "", r.distance_km) for r in out.collect())
    near = [(a, km(x, y), b or "") for a, *x in cen for b, *y in pts if km(x, y) <= 60]
    counts = {a: sum(n[0] == a for n in near) for a, _, _ in near}
    assert [(g[0], g[1]) for g in got] == [(a, i) for a in sorted(counts) for i in range(1, counts[a] + 1)] and len(near) > 4000
    assert sorted((g[0], g[2]) for g in got) == sorted((a, b) for a, _, b in near)
    assert all(g[3] <= h[3] and (g[3] < h[3] or g[2] <= h[2]) for g, h in zip(got, got[1:]) if g[0] == h[0])
    assert shuffled_rows(out) < 3 * 5 * len(pts) < len(near)


def test_ranked_query_neither_keeps_nor_shuffles_pairs(spark):
    kept = lambda: set(Path(spark.conf.get("spark.checkpoint.dir")).glob("isobar-*"))
    before = kept()
    assert shuffled_rows(workload.QUERIES["radius_search_ranked"](spark, "/root/testdata/sf0.01")) < 10_000
    assert kept() == before


def test_grid_rows_meet_lists_of_locations_by_one_shuffle(spark):
    """Rows met locations one by one, dealt twice and by point when locations were many; now a point's locations come as lists."""
    rng = random.Random(12)
    spots = [(28.0, -106.0), (28.5, -106.0), (0.0, -0.0), (None, -106.0)]
    g = spark.createDataFrame([(*rng.choice(spots), i, rng.choice([None, 1.5])) for i in range(400)] + [(28.0, -106.0, 7, 2.0)] * 2,
                              "latitude double, longitude double, k int, t2m double")
    named = [(rng.choice([None, f"l{i}"]), *rng.choice([(28.0, -106.0), (28.5, -106.0), (-0.0, 0.0), (None, None)])) for i in range(200)]
    points = spark.createDataFrame([*named, ("l0", 28.0, -106.0)], "location_id string, grid_lat double, grid_lon double")
    before = grids.LIST
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        grids.LIST = 10
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = grids.extract_points(g, points, deal=True)
        plain = grids.extract_points(g, points)
        assert out.columns == plain.columns
        key = lambda r: [(x is not None, x) for x in r]
        got, want = (sorted(df.collect(), key=key) for df in (out, plain))
        shuffled = shuffled_rows(out)
    finally:
        grids.LIST = before
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert got == want and len(want) > 10_000
    assert shuffled < 400 + 3 * 200 + 8 * 60
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_ids") < plan.index("Join Inner") < plan.index("RepartitionByExpression [_point")
