"""Location tables, lookup of codes, distance search, stations."""

from __future__ import annotations

import functools

from isobar import constants as C
from isobar.functions import normals, physics
from isobar.operators import locations, stations
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from workload.base import digits, digits_of, place, query, sql_digits, sql_km, sql_place, table

# A raw code table: codes repeat, some coordinates are no numbers or outside the box, states vary.
RAW_STATE = "CASE c_custkey % 4 WHEN 0 THEN '08' WHEN 1 THEN 'Chihuahua' WHEN 2 THEN '05' ELSE 'CHIHUAHUA' END"
RAW_CODE = "CAST(c_custkey % 700 * 97 AS {text})"


def raw_codes(spark, sf):
    c = table(spark, sf, "customer")
    lat = F.pmod(F.col("c_custkey") * 37, F.lit(1200))
    text = F.concat((F.floor(lat / 100) + 22).cast("string"), F.lit("."), F.lpad(F.pmod(lat, F.lit(100)).cast("string"), 2, "0"))
    lon = F.concat((F.pmod(F.col("c_custkey") * 53, F.lit(12)) - 111).cast("string"), F.lit(".5"))
    return c.select(
        F.expr(RAW_STATE).alias("c_estado"), F.expr(RAW_CODE.format(text="STRING")).alias("d_cp"),
        F.when(F.pmod("c_custkey", F.lit(11)) == 0, "n/a").otherwise(text).alias("latitud"), lon.alias("longitud"),
        F.col("c_custkey").alias("row_seq"),
    )


SQL_CLEAN = f"""raw AS (SELECT {RAW_STATE} AS state, {RAW_CODE.format(text='VARCHAR')} AS code, c_custkey AS row_seq,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(((c_custkey * 37) % 1200) // 100 + 22 || '.' || lpad(CAST((c_custkey * 37) % 1200 % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS lat,
  CAST(CAST((c_custkey * 53) % 12 - 111 AS VARCHAR) || '.5' AS DOUBLE) AS lon FROM customer),
clean AS (SELECT CASE WHEN length(code) < 5 THEN lpad(code, 5, '0') ELSE code END AS location_id, arg_max(lat, row_seq) AS lat,
  arg_max(lon, row_seq) AS lon, max(row_seq) AS row_seq
  FROM raw WHERE (state = '08' OR upper(state) = 'CHIHUAHUA') AND lat IS NOT NULL AND lat BETWEEN 24 AND 32 AND lon BETWEEN -110 AND -100
  GROUP BY 1)"""


@query(f"WITH {SQL_CLEAN} SELECT location_id, lat, lon, row_seq FROM clean")
def clean_codes(spark, sf):
    return locations.clean_locations(raw_codes(spark, sf))


@query(f"WITH {SQL_CLEAN} SELECT location_id, lat, lon, row_seq FROM clean")
def build_location_table(spark, sf):
    return locations.build_locations(raw_codes(spark, sf), locations.city_locations(spark))


CITY_VALUES = ", ".join(f"({i}, '{c}', {lat}::DOUBLE, {lon}::DOUBLE)" for i, (c, lat, lon) in enumerate(C.CITY_COORDINATES))
SQL_CITY = f"""city AS (SELECT code AS location_id, arg_max(lat, i) AS lat, arg_max(lon, i) AS lon
  FROM (VALUES {CITY_VALUES}) t(i, code, lat, lon) GROUP BY 1)"""
PREFIX_CASE = {j: "CASE substr(code, 1, 2) " + " ".join(f"WHEN '{p}' THEN {xy[j]}::DOUBLE" for p, xy in C.PREFIX_COORDINATES.items()) + " END"
               for j in (0, 1)}
SQL_LOOKUP = f"""{SQL_CITY},
asked AS (SELECT o_orderkey, lpad(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 31000 + o_custkey % 20 * 100 ELSE o_custkey * 29 % 40000 END AS VARCHAR), 5, '0') AS code FROM orders),
resolved AS (SELECT o_orderkey, code, code AS location_id, CASE WHEN c.location_id IS NOT NULL THEN c.lat ELSE {PREFIX_CASE[0]} END AS lat,
  CASE WHEN c.location_id IS NOT NULL THEN c.lon ELSE {PREFIX_CASE[1]} END AS lon,
  CASE WHEN c.location_id IS NOT NULL THEN 'exact' WHEN substr(code, 1, 2) IN ('31', '32', '33') THEN 'prefix' ELSE 'none' END AS match_kind
  FROM asked LEFT JOIN city c ON c.location_id = code)"""


def asked(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "lpad(cast(CASE WHEN o_orderkey % 3 = 0 THEN 31000 + o_custkey % 20 * 100 ELSE o_custkey * 29 % 40000 END AS string), 5, '0') AS code")


@query(f"WITH {SQL_LOOKUP} SELECT o_orderkey, code, location_id, lat, lon, match_kind FROM resolved")
def code_lookup(spark, sf):
    return locations.lookup(asked(spark, sf), locations.city_locations(spark))


@query(f"WITH {SQL_LOOKUP} SELECT DISTINCT code FROM resolved WHERE match_kind = 'none'")
def missing_codes(spark, sf):
    return locations.found_and_missing(asked(spark, sf), locations.city_locations(spark))[1].distinct()


@query(f"WITH {SQL_LOOKUP} SELECT o_orderkey, code FROM resolved WHERE match_kind <> 'none'")
def existing_codes(spark, sf):
    return locations.existing(asked(spark, sf), locations.city_locations(spark))


@query("""SELECT c_custkey, CASE WHEN length(code) < 5 THEN lpad(code, 5, '0') ELSE code END AS padded, length(code) = 5 AS valid
FROM (SELECT c_custkey, CAST(c_custkey * 997 AS VARCHAR) AS code FROM customer)""")
def code_validity(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 997).cast("string").alias("code"))
    return c.select("c_custkey", locations.pad_code(F.col("code")).alias("padded"), locations.valid_code(F.col("code")).alias("valid"))


@query(f"""SELECT c_custkey, lat BETWEEN 24 AND 28 AND lon BETWEEN -110 AND -104 AS inside,
CASE WHEN lat > 31 THEN 'juarez' WHEN lon < -106.5 THEN 'mountains' ELSE 'chihuahua_city' END AS region
FROM (SELECT c_custkey, {sql_place('c_custkey')} FROM customer)""")
def regions_and_boxes(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", *[e.alias(n) for n, e in place("c_custkey").items()])
    lat, lon = F.col("lat"), F.col("lon")
    return c.select("c_custkey", locations.in_box(lat, lon, (24, 28, -110, -104)).alias("inside"), normals.region(lat, lon).alias("region"))


SQL_PLACES = f"""c AS (SELECT CAST(c_custkey AS VARCHAR) AS location_id, {sql_place('c_custkey')} FROM customer),
s AS (SELECT CAST(s_suppkey AS VARCHAR) AS station_id, {sql_place('s_suppkey')} FROM supplier),
n AS (SELECT CAST(n_nationkey AS VARCHAR) AS location_id, {sql_place('n_nationkey')} FROM nation)"""


def places(spark, sf, name, key, id_):
    return table(spark, sf, name).select(F.col(key).cast("string").alias(id_), *[e.alias(n) for n, e in place(key).items()])


def station_table(spark, sf):
    s = places(spark, sf, "supplier", "s_suppkey", "station_id")
    return s.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})


@query(f"""WITH {SQL_PLACES} SELECT s.station_id AS center_id, c.location_id, {sql_digits(sql_km('s.lat', 's.lon', 'c.lat', 'c.lon'))} AS distance_km
FROM s, c WHERE {sql_km('s.lat', 's.lon', 'c.lat', 'c.lon')} <= 60""")
def radius_search(spark, sf):
    return rounded(locations.within_radius(*radius_sides(spark, sf), 60))


def radius_sides(spark, sf):
    return places(spark, sf, "supplier", "s_suppkey", "center_id"), places(spark, sf, "customer", "c_custkey", "location_id")


def rounded(pairs, *more):
    return pairs.select("center_id", "location_id", digits_of("distance_km").alias("distance_km"), *more)


@query(f"""WITH {SQL_PLACES}, d AS (SELECT s.station_id AS center_id, c.location_id, {sql_km('s.lat', 's.lon', 'c.lat', 'c.lon')} AS km FROM s, c),
r AS (SELECT center_id, location_id, {sql_digits('km')} AS distance_km FROM d WHERE km <= 60)
SELECT *, row_number() OVER (PARTITION BY center_id ORDER BY distance_km, location_id) AS rank FROM r""")
def radius_search_ranked(spark, sf):
    shares = locations.within_radius_of_shares(*radius_sides(spark, sf), 60)
    ranked = [locations.ranked_by_distance(rounded(pairs, *locations.CELL), 5.0, dealt_by=locations.CELL) for pairs in shares]
    return functools.reduce(DataFrame.unionAll, ranked)


@query(f"""WITH {SQL_PLACES}, p AS (SELECT c.location_id, s.station_id, {sql_km('c.lat', 'c.lon', 's.lat', 's.lon')} AS km FROM c, s),
r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY km, station_id) AS rank FROM p WHERE km <= 100)
SELECT location_id, station_id, {sql_digits('km')} AS distance_km, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def nearest_stations(spark, sf):
    out = stations.nearest_stations(places(spark, sf, "customer", "c_custkey", "location_id"), station_table(spark, sf), 100, 3, salts=4)
    return out.withColumn("distance_km", digits("distance_km"))


@query("""SELECT location_id, lat, lon, row_seq, CAST(row_number() OVER (ORDER BY row_seq) AS INTEGER) AS number FROM (
SELECT CAST(c_custkey AS VARCHAR) AS location_id, CAST(24.0 AS DOUBLE) + CAST((c_custkey * 37) % 800 AS DOUBLE) / 100 AS lat,
  CAST(-110.0 AS DOUBLE) + CAST((c_custkey * 53) % 1000 AS DOUBLE) / 100 AS lon, c_custkey AS row_seq FROM customer) ORDER BY row_seq LIMIT 10""")
def location_listing(spark, sf):
    c = places(spark, sf, "customer", "c_custkey", "location_id").withColumn("row_seq", F.col("location_id").cast("long"))
    return locations.listing(c, 10)


@query("SELECT CAST(c_custkey AS VARCHAR) AS location_id, row_number() OVER (ORDER BY c_custkey DESC) AS number FROM customer")
def locations_numbered(spark, sf):
    """The whole list, entered in falling order of keys."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("location_id"), (-1000 * F.col("c_custkey")).alias("row_seq"))
    return locations.listing(c).select("location_id", "number")


@query("SELECT count(*) AS n_locations, greatest(count(*) - 10, 0) AS n_more FROM customer")
def locations_left_out(spark, sf):
    return locations.remaining(table(spark, sf, "customer"), 10)


@query("""WITH l AS (SELECT CAST(31000 + c_custkey AS VARCHAR) AS location_id, md5('42|' || CAST(31000 + c_custkey AS VARCHAR)) AS h FROM customer
  UNION ALL SELECT CAST(33000 + s_suppkey AS VARCHAR), md5('42|' || CAST(33000 + s_suppkey AS VARCHAR)) FROM supplier),
n AS (SELECT least(count(*) FILTER (location_id LIKE '31%'), 4) AS q1, least(count(*) FILTER (location_id LIKE '32%'), 4) AS q2,
  count(*) FILTER (location_id LIKE '33%') AS n3 FROM l),
r AS (SELECT *, substr(location_id, 1, 2) AS p, row_number() OVER (PARTITION BY substr(location_id, 1, 2) ORDER BY h, location_id) AS rn FROM l)
SELECT location_id FROM r, n WHERE rn <= CASE p WHEN '31' THEN q1 WHEN '32' THEN q2 WHEN '33' THEN least(n3, 10 - q1 - q2) ELSE 0 END""")
def stratified_locations(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") + 31000).cast("string").alias("location_id"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") + 33000).cast("string").alias("location_id"))
    return locations.stratified_sample(c.unionByName(s), 10, rank=F.md5(F.concat(F.lit("42|"), F.col("location_id"))))


# Station reports: events per user and hour, users taken as stations.
OBS = {"temp": "v / 10 - 5", "dwpt": "k / 10", "rhum": "k", "prcp": "CASE WHEN k < 50 THEN v / 50 END", "wdir": "v", "wspd": "k / 2",
       "wpgt": "k", "pres": "1000 + v / 10"}


def station_obs(spark, sf):
    from workload.base import merged_cells
    m = merged_cells(spark, sf, 180, "user_id")
    return m.selectExpr("location_id AS station_id", "ts", *[f"{e} AS {n}" for n, e in OBS.items()])


def sql_station_merge(denominator="all", circular=False):
    from workload.base import sql_merged
    out = []
    for c, v in C.STATION_COLUMNS.items():
        if c not in OBS or v not in C.MERGED_STATION_VARIABLES:
            continue
        x = f"({OBS[c]})" + (" * 1000 / 3600" if c in ("wspd", "wpgt") else "")
        if c == "wdir" and circular:
            e = f"(degrees(atan2(sum(sin(radians({x})) * w), sum(cos(radians({x})) * w))) + 360) % 360"
        else:
            e = f"sum({x} * w) / " + ("sum(w)" if denominator == "all" else f"sum(CASE WHEN {x} IS NOT NULL THEN w END)")
        out.append(f"{sql_digits(e)} AS {v}")
    return f"""WITH {sql_merged(180, 'user_id')}, {SQL_PLACES},
p AS (SELECT n.location_id, s.station_id, {sql_km('n.lat', 'n.lon', 's.lat', 's.lon')} AS km FROM n, s),
r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY km, station_id) AS rank FROM p WHERE km <= 100),
o AS (SELECT r.location_id, m.ts, m.v, m.k, 1 / (1 + r.km) AS w FROM r JOIN merged m ON m.location_id = r.station_id WHERE rank <= 3)
SELECT location_id, ts, {', '.join(out)} FROM o GROUP BY 1, 2"""


def merged_stations(spark, sf, **options):
    near = stations.nearest_stations(places(spark, sf, "nation", "n_nationkey", "location_id"), station_table(spark, sf), 100, 3)
    weighted = stations.weighted_observations(stations.canonical_observations(station_obs(spark, sf)), near)
    out = stations.merge_stations(weighted, **options)
    return out.select("location_id", "ts", *[digits(c).alias(c) for c in out.columns[2:]])


@query(sql_station_merge())
def station_merge(spark, sf):
    return merged_stations(spark, sf)


@query(sql_station_merge("per_variable", True))
def station_merge_by_variable(spark, sf):
    return merged_stations(spark, sf, denominator="per_variable", wind="circular")


@query(f"""SELECT c_custkey, {sql_digits(sql_km('lat', 'lon', '28.632', '-106.0691'))} AS km,
{sql_digits('1 / (1 + ' + sql_km('lat', 'lon', '28.632', '-106.0691') + ')')} AS weight FROM (SELECT c_custkey, {sql_place('c_custkey')} FROM customer)""")
def distances_and_weights(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", *[e.alias(n) for n, e in place("c_custkey").items()])
    km = physics.great_circle_km(F.col("lat"), F.col("lon"), F.lit(28.632), F.lit(-106.0691))
    return c.select("c_custkey", digits(km).alias("km"), digits(physics.inverse_distance_weight(km)).alias("weight"))
