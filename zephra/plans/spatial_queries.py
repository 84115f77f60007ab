"""Queries: spatial joins and nearest neighbours."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zephra.functions import bands
from zephra.operators import cleaning, fusion, spatial
from zephra.plans import bindings as b
from zephra.plans.bindings import oracle
from zephra.plans.catalog import query
from zephra.plans.feature_queries import band_sql
from zephra.plans.scalar_queries import SENSORS_SQL, haversine_sql, sensors
from zephra.scale import checkpoint_root
from zephra.sources import geojson

_CROSS = "((e.y1 > p.latitude) <> (e.y2 > p.latitude) AND p.longitude < (e.x2 - e.x1) * (p.latitude - e.y1) / (CASE WHEN e.y1 <> e.y2 THEN e.y2 - e.y1 END) + e.x1)"
_TOUCH = """((e.x2 - e.x1) * (p.latitude - e.y1) - (e.y2 - e.y1) * (p.longitude - e.x1) = 0 AND p.longitude BETWEEN least(e.x1, e.x2)
    AND greatest(e.x1, e.x2) AND p.latitude BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))"""
WITHIN_SQL = f"""SELECT longitude, latitude, min(pos) AS pos, arg_min(ward_name, pos) AS ward_name FROM (
    SELECT p.longitude, p.latitude, e.pos, e.ward_name FROM (SELECT DISTINCT longitude, latitude FROM stations) p, ward_edges e
    GROUP BY ALL HAVING count(*) FILTER ({_CROSS}) % 2 = 1 AND count(*) FILTER ({_TOUCH}) = 0) GROUP BY 1, 2"""


@query("S6_ward_polygons", oracle(
    """SELECT pos, ward_name, count(*)::INT AS edges, round(min(x1), 6) AS x_lo, round(max(x1), 6) AS x_hi,
    round(min(y1), 6) AS y_lo, round(max(y1), 6) AS y_hi FROM ward_edges GROUP BY 1, 2""", "ward_edges"))
def ward_polygons(spark, d):
    """Wards written as one GeoJSON collection, some as polygons of several parts, and read back to edges with bounds."""
    wards = _wards_from_file(spark, d)
    return wards.select(
        "pos", "ward_name", F.size("edges").alias("edges"), *[F.round(c, 6).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")]
    )


def _wards_from_file(spark, d):
    folder = f"{checkpoint_root(spark)}/wards-{uuid.uuid4().hex}"
    rings = b.ward_rings(spark, d)
    parts = F.when(F.col("pos") % 3 == 1, F.transform("rings", lambda r: F.array(r)))
    geojson.feature_text(rings.withColumn("polygons", parts), folder)
    return geojson.read_wards(spark, folder)


@query(
    "J5_spatial_within",
    oracle(
        "SELECT s.pos, s.station, w.ward_name FROM stations s LEFT JOIN within_ward w USING (longitude, latitude)",
        "stations", "ward_edges", extra={"within_ward": WITHIN_SQL},
    ),
)
def spatial_within(spark, d):
    st = b.stations(spark, d)
    found = spatial.spatial_within(st, b.wards(spark, d)).select("longitude", "latitude", "ward_name")
    return st.join(found, ["longitude", "latitude"], "left").select("pos", "station", "ward_name")


# Third-order Krueger series, n of WGS84.
_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_EC = 2 * _N**0.5 / (1 + _N)
_RAD = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_A = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]


def _utm_sql(src: str, keep: str, lat: str, lon: str, x: str, y: str) -> str:
    east = " + ".join(["eta"] + [f"{k!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, k in enumerate(_A, 1)])
    north = " + ".join(["xi"] + [f"{k!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, k in enumerate(_A, 1)])
    return f"""SELECT {keep}, 500000 + {0.9996 * _RAD!r}::DOUBLE * ({east}) AS {x}, {0.9996 * _RAD!r}::DOUBLE * ({north}) AS {y}
        FROM (SELECT *, atan2(t, cos(radians({lon} - 75))) AS xi, atanh(sin(radians({lon} - 75)) / sqrt(1 + t * t)) AS eta
        FROM (SELECT *, sinh(atanh(sin(radians({lat}))) - {_EC!r}::DOUBLE * atanh({_EC!r}::DOUBLE * sin(radians({lat})))) AS t
        FROM {src}))"""


NEAREST_WARD_CTES = {
    "edge_a": _utm_sql("ward_edges", "pos AS wid, ward_name, x2, y2", "y1", "x1", "ax", "ay"),
    "edge_xy": _utm_sql("edge_a", "wid, ward_name, ax, ay", "y2", "x2", "qx", "qy"),
    "outside": "SELECT s.* FROM stations s LEFT JOIN within_ward w USING (longitude, latitude) WHERE w.pos IS NULL",
    "outside_xy": _utm_sql("outside", "pos, station", "latitude", "longitude", "px", "py"),
    "near_ward": """SELECT pos, station, arg_min(ward_name, {'m': m, 'w': wid}) AS ward_name, min(m) AS metres FROM (
        SELECT *, sqrt(pow(px - (ax + t * (qx - ax)), 2) + pow(py - (ay + t * (qy - ay)), 2)) AS m FROM (SELECT *,
        greatest(0, least(1, ((px - ax) * (qx - ax) + (py - ay) * (qy - ay)) / (pow(qx - ax, 2) + pow(qy - ay, 2)))) AS t
        FROM outside_xy, edge_xy)) GROUP BY 1, 2""",
}


@query(
    "J6_nearest_ward",
    oracle(
        "SELECT pos, station, ward_name, round(metres, 3) AS metres FROM near_ward",
        "stations", "ward_edges", extra={"within_ward": WITHIN_SQL, **NEAREST_WARD_CTES},
    ),
)
def nearest_ward(spark, d):
    st = b.stations(spark, d)
    wards = b.wards(spark, d)
    inside = spatial.spatial_within(st, wards)
    outside = st.join(inside, ["longitude", "latitude"], "left_anti")
    found = spatial.nearest_ward(outside, wards)
    return outside.join(found, ["longitude", "latitude"]).select("pos", "station", "ward_name", F.round("metres", 3).alias("metres"))


_MAPPED = """SELECT s.pos, s.station, coalesce(w.ward_name, n.ward_name) AS ward_name, w.pos IS NOT NULL AS inside
    FROM stations s LEFT JOIN within_ward w USING (longitude, latitude) LEFT JOIN near_ward n ON n.pos = s.pos"""
_MAPPED_CTES = {"within_ward": WITHIN_SQL, **NEAREST_WARD_CTES, "mapped": _MAPPED}


@query("S6_J5_J6_map_wards", oracle("SELECT * FROM mapped", "stations", "ward_edges", extra=_MAPPED_CTES))
def map_wards(spark, d):
    """Stations mapped to wards read from a file: the ward around them, else the nearest one."""
    return spatial.map_wards(b.stations(spark, d), _wards_from_file(spark, d)).select("pos", "station", "ward_name", "inside")


@query(
    "A13_ward_counts",
    oracle(
        "SELECT ward_name AS label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM mapped), 6) AS share FROM mapped GROUP BY 1",
        "stations", "ward_edges", extra=_MAPPED_CTES,
    ),
)
def ward_counts(spark, d):
    """Stations per ward."""
    mapped = spatial.map_wards(b.stations(spark, d), b.wards(spark, d))
    return cleaning.value_counts(mapped, "ward_name").withColumn("share", F.round("share", 6))


@query(
    "J7_nearest_station",
    oracle(
        f"""SELECT report_no, s.station AS nearest_station, round(km, 6) AS nearest_km FROM (SELECT r.report_no, arg_min(
        s.pos, {{'d': {haversine_sql('r.lat', 'r.lon', 's.latitude', 's.longitude')}, 'p': s.pos}}) AS pos,
        min({haversine_sql('r.lat', 'r.lon', 's.latitude', 's.longitude')}) AS km FROM reports r, stations s GROUP BY 1)
        JOIN stations s USING (pos)""",
        "reports", "stations",
    ),
)
def nearest_station(spark, d):
    r = b.parse_reports(b.reports(spark, d)).select("report_no", "lat", "lon")
    return spatial.nearest_station(r, b.stations(spark, d)).select(
        "report_no", "nearest_station", F.round("nearest_km", 6).alias("nearest_km")
    )


@query(
    "J8_nearest_sensor_km",
    oracle(
        f"""SELECT pixel_id, round(min({haversine_sql('p.latitude', 'p.longitude', 's.latitude', 's.longitude')}), 6) AS nearest_km
        FROM pixels p, stations s GROUP BY 1""",
        "pixels", "stations",
    ),
)
def nearest_sensor_km(spark, d):
    centres = b.pixels(spark, d).select("pixel_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return spatial.nearest_sensor_km(centres, b.stations(spark, d)).select(
        "pixel_id", F.round("nearest_km", 6).alias("nearest_km")
    )


_PAIR = "sqrt((a.longitude - b.longitude) * (a.longitude - b.longitude) + (a.latitude - b.latitude) * (a.latitude - b.latitude))"


@query(
    "J9_self_nn",
    oracle(
        f"""SELECT a.pos, a.station, arg_min(b.station, {{'d': {_PAIR}, 'p': b.pos}}) AS neighbour, round(min({_PAIR}) * 111.0::DOUBLE, 6) AS km
        FROM stations a, stations b WHERE a.pos <> b.pos GROUP BY 1, 2""",
        "stations",
    ),
)
def self_nn(spark, d):
    return spatial.self_nn(b.stations(spark, d)).withColumn("km", F.round("km", 6))


@query(
    "J10_closest_pairs",
    oracle(
        f"""SELECT a.pos AS i, b.pos AS j, a.station AS station_a, b.station AS station_b, round({_PAIR} * 111.0::DOUBLE, 6) AS km
        FROM stations a, stations b WHERE a.pos < b.pos ORDER BY {_PAIR}, a.pos, b.pos LIMIT 10""",
        "stations",
    ),
)
def closest_pairs(spark, d):
    return spatial.closest_pairs(b.stations(spark, d)).withColumn("km", F.round("km", 6))


@query(
    "W9_spread_duplicates",
    oracle(
        """SELECT report_no, round(lon + (row_number() OVER (PARTITION BY round(lat, 4), round(lon, 4) ORDER BY report_no) - 1)
        * 0.003::DOUBLE, 6) AS longitude_shown FROM reports""",
        "reports",
    ),
)
def spread_duplicates(spark, d):
    r = b.parse_reports(b.reports(spark, d)).select("report_no", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    return spatial.spread_duplicates(r, ["report_no"]).select("report_no", F.round("longitude_shown", 6).alias("longitude_shown"))


@query(
    "D1_map_markers",
    oracle(
        f"""SELECT s.pos, s.station, coalesce(w.ward_name, 'Unknown') AS ward_name, round(s.pm25, 6) AS pm25,
        {band_sql('s.pm25', repr('Unknown'))} AS band, round(s.longitude + (row_number() OVER (PARTITION BY round(s.latitude, 4),
        round(s.longitude, 4) ORDER BY s.pos) - 1) * 0.003::DOUBLE, 6) AS longitude_shown FROM sensors s LEFT JOIN within_ward w
        USING (longitude, latitude)""",
        "stations", "daily", "ward_edges", extra={"sensors": SENSORS_SQL, "within_ward": WITHIN_SQL},
    ),
)
def map_markers(spark, d):
    """Sensor markers: latest value, band, ward, and a place of its own."""
    st = sensors(spark, d)
    ward = spatial.spatial_within(st, b.wards(spark, d)).select("longitude", "latitude", "ward_name")
    shown = spatial.spread_duplicates(st.join(ward, ["longitude", "latitude"], "left"), ["pos"])
    return shown.select(
        "pos", "station", F.coalesce("ward_name", F.lit("Unknown")).alias("ward_name"), F.round("pm25", 6).alias("pm25"),
        bands.pm25_band(F.col("pm25"), "Unknown").alias("band"), F.round("longitude_shown", 6).alias("longitude_shown"),
    )
