import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zephra.functions import geo
from zephra.operators import cover, spatial
from zephra.sources.geojson import _feature_records, read_wards


def crowd(n, seed):
    rnd = random.Random(seed)
    third = [(12.9 + rnd.gauss(0, 1e-5), 77.6 + rnd.gauss(0, 1e-5)) for _ in range(n // 3)]
    rest = [(12.85 + rnd.random() * 0.3, 77.45 + rnd.random() * 0.3) for _ in range(n - n // 3)]
    return third + rest


def stations(spark, pts):
    return spark.createDataFrame([(i, f"s{i}", a, b) for i, (a, b) in enumerate(pts)],
                                 "pos long, station string, latitude double, longitude double")


def hav(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


@pytest.mark.parametrize("capacity", [1, 16])
def test_nearest_station(spark, monkeypatch, capacity):
    monkeypatch.setattr(spatial, "CELL_ITEMS", capacity)
    st, pts = crowd(150, 1), crowd(90, 2)
    st += st[:5]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pts)], "id long, lat double, lon double")
    got = {r["id"]: r for r in spatial.nearest_station(df, stations(spark, st)).collect()}
    assert len(got) == len(pts)
    for i, (a, b) in enumerate(pts):
        d, k = min((hav(a, b, c, e), k) for k, (c, e) in enumerate(st))
        assert got[i]["nearest_station"] == f"s{k}" and abs(got[i]["nearest_km"] - d) < 1e-9


def test_no_sensor_gives_999(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    none = stations(spark, [(1.0, 1.0)]).filter(F.lit(False))
    assert spatial.nearest_sensor_km(df, none).first()["nearest_km"] == 999.0


@pytest.mark.parametrize("capacity", [1, 16])
def test_self_nn_and_closest_pairs(spark, monkeypatch, capacity):
    monkeypatch.setattr(spatial, "CELL_ITEMS", capacity)
    pts = crowd(120, 3)
    pts += [pts[50], pts[60], pts[50]]
    flat = lambda i, j: math.sqrt((pts[i][1] - pts[j][1]) ** 2 + (pts[i][0] - pts[j][0]) ** 2)
    got = {r["pos"]: r for r in spatial.self_nn(stations(spark, pts)).collect()}
    assert len(got) == len(pts)
    for i in range(len(pts)):
        d, j = min((flat(i, j), j) for j in range(len(pts)) if j != i)
        assert got[i]["neighbour"] == f"s{j}", i
        assert abs(got[i]["km"] - d * 111) < 1e-9
    pairs = sorted((flat(i, j), i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)))[:10]
    out = spatial.closest_pairs(stations(spark, pts)).collect()
    assert [(r["i"], r["j"]) for r in out] == [(i, j) for _, i, j in pairs]


@pytest.mark.parametrize("pts", [
    [(y * 0.5, x * 0.5) for y in range(5) for x in range(5)],  # every neighbour at the same distance
    [(0.0, 0.0), (0.0, 1.0), (3.0, 0.0)],  # fewer pairs than asked for
    [(1.0, 1.0)] * 40,  # one coordinate
    [(1.0, 1.0)] * 2 + [(1.0, 2.0)] * 30,
])
def test_closest_pairs_edge_cases(spark, pts):
    flat = lambda i, j: math.sqrt((pts[i][1] - pts[j][1]) ** 2 + (pts[i][0] - pts[j][0]) ** 2)
    pairs = sorted((flat(i, j), i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)))[:10]
    out = spatial.closest_pairs(stations(spark, pts)).collect()
    assert [(r["i"], r["j"]) for r in out] == [(i, j) for _, i, j in pairs]


def _geojson(tmp_path):
    def feature(name, kind, coords):
        return {"type": "Feature", "properties": {"ward_name": name, "Ward_No": 7}, "geometry": {"type": kind, "coordinates": coords}}

    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]
    far = [[[[10, 0], [11, 0], [11, 1], [10, 1], [10, 0]]], [[[20, 0], [21, 0], [21, 1], [20, 1], [20, 0]]]]
    features = [feature("holed", "Polygon", [square, hole]), feature("two", "MultiPolygon", far),
                feature("over", "Polygon", [[[3, 3], [6, 3], [6, 6], [3, 6]]])]
    path = tmp_path / "wards.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    return str(path)


def test_wards_from_geojson(spark, tmp_path):
    wards = read_wards(spark, _geojson(tmp_path))
    assert [(r["pos"], r["ward_name"], len(r["edges"])) for r in wards.orderBy("pos").collect()] == [(0, "holed", 8), (1, "two", 8), (2, "over", 4)]
    pts = {  # longitude, latitude: ward by ``within``
        (0.5, 0.5): "holed", (1.5, 1.5): None, (1.0, 1.5): None, (4.0, 2.0): None, (3.5, 3.5): "holed",
        (5.0, 5.0): "over", (20.5, 0.5): "two", (10.5, 0.5): "two", (15.0, 0.5): None, (0.0, 0.0): None,
    }
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "longitude double, latitude double")
    got = {(r["longitude"], r["latitude"]): r["ward_name"] for r in spatial.spatial_within(df, wards).collect()}
    assert got == {k: v for k, v in pts.items() if v}
    full = {(r["longitude"], r["latitude"]): r["ward_name"] for r in spatial.map_wards(df, wards).collect()}
    assert full[15.0, 0.5] in ("two",) and full[4.0, 2.0] == "holed" and full[1.5, 1.5] == "holed" and len(full) == len(pts)


def test_utm_matches_known_point(spark):
    # Central meridian 75 E at the equator, and one degree east of it.
    e, n = geo.utm_xy(F.col("lat"), F.col("lon"))
    df = spark.createDataFrame([(0.0, 75.0), (0.0, 76.0), (12.97, 77.59)], "lat double, lon double")
    rows = df.select(e.alias("e"), n.alias("n")).collect()
    assert abs(rows[0]["e"] - 500000) < 1e-6 and abs(rows[0]["n"]) < 1e-6
    # Scale 0.9996 on the meridian: a degree of longitude at the equator is a R / 180 long, stretched by 1 + x^2 / 2R^2.
    arc = 0.9996 * 6378137.0 * math.radians(1)
    assert abs(rows[1]["e"] - 500000 - arc * (1 + math.radians(1) ** 2 / 6 * (1 + 0.00674))) < 1
    assert 780000 < rows[2]["e"] < 782000 and 1434000 < rows[2]["n"] < 1437000


def _brute_inside(px, py, e):
    """Even-odd rule of points against edges (x1, y1, x2, y2), in blocks."""
    out = np.zeros(len(px), dtype=bool)
    for at in range(0, len(px), 50):
        x, y = px[at : at + 50, None], py[at : at + 50, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]
        out[at : at + 50] = (((e[:, 1] > y) != (e[:, 3] > y)) & (x < cut)).sum(axis=1) % 2 == 1
    return out


def _outline(n, cx, cy, r, wobble, seed):
    rnd = np.random.default_rng(seed)
    t = np.sort(rnd.random(n)) * 2 * np.pi
    radius = r * (1 + 0.2 * np.sin(5 * t) + wobble * rnd.random(n))
    x, y = cx + radius * np.cos(t), cy + radius * np.sin(t)
    return np.column_stack([x, y, np.roll(x, -1), np.roll(y, -1)])


def _edges(spark, outlines):
    import pandas as pd

    parts = [pd.DataFrame(o, columns=["x1", "y1", "x2", "y2"]).assign(pos=i) for i, o in enumerate(outlines)]
    return spark.createDataFrame(pd.concat(parts)).select(F.col("pos").cast("long"), "x1", "y1", "x2", "y2")


def test_country_sized_outline(spark):
    outline = _outline(100_000, 77.0, 20.0, 12.0, 0.002, 4)
    edges = _edges(spark, [outline]).repartition(8)
    found = cover.polygon_cover(edges)
    border = found.border.withColumn("n", F.size("edges")).cache()
    cells, kept, most = border.agg(F.count("n"), F.sum("n"), F.max("n")).first()
    whole = found.whole.count()
    assert most <= cover.CELL_EDGES and kept < 1.6 * len(outline) and cells + whole < 0.2 * len(outline)
    rnd = np.random.default_rng(6)
    far = np.column_stack([60 + 34 * rnd.random(1500), 3 + 34 * rnd.random(1500)])
    near = outline[rnd.integers(len(outline), size=1500), :2] + rnd.normal(0, 1e-4, (1500, 2))
    pts = np.vstack([far, near, outline[:20, :2]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "longitude double, latitude double")
    got = {(r["longitude"], r["latitude"]) for r in cover.polygon_of(df, found, "longitude", "latitude").collect()}
    want = _brute_inside(pts[:, 0], pts[:, 1], outline)
    want[-20:] = False  # corners of the outline itself
    assert got == {tuple(p) for p, w in zip(pts.tolist(), want) if w} and 500 < len(got) < 2500


@pytest.mark.parametrize("capacity", [2, 64])
def test_overlapping_polygons_take_the_first(spark, monkeypatch, capacity):
    monkeypatch.setattr(cover, "CELL_EDGES", capacity)
    monkeypatch.setattr(cover, "MAX_DEPTH", 5)
    outlines = [_outline(7 + 5 * k, (k * 3) % 7, (k * 5) % 11, 1.5 + k % 3, 0.3, k) for k in range(12)]
    square = np.array([[0, 0, 4, 0], [4, 0, 4, 4], [4, 4, 0, 4], [0, 4, 0, 0], [1, 1, 1, 2], [1, 2, 2, 2], [2, 2, 2, 1], [2, 1, 1, 1]], dtype=float)
    outlines.append(square)
    edges = _edges(spark, outlines)
    rnd = np.random.default_rng(9)
    pts = np.vstack([rnd.random((800, 2)) * 14 - 2, [[0.0, 0.0], [4.0, 2.0], [1.0, 1.5], [1.5, 1.5]]])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "longitude double, latitude double")
    got = {(r["longitude"], r["latitude"]): r["pos"] for r in cover.polygon_of(df, cover.polygon_cover(edges), "longitude", "latitude").collect()}
    want = np.full(len(pts), -1)
    for k in reversed(range(len(outlines))):
        inside = _brute_inside(pts[:, 0], pts[:, 1], outlines[k])
        if k == 12:
            inside[-4:] = False
        want[inside] = k
    assert got == {tuple(p): w for p, w in zip(pts.tolist(), want.tolist()) if w >= 0}


def test_no_polygon_at_all(spark, tmp_path):
    wards = read_wards(spark, _geojson(tmp_path)).filter(F.lit(False))
    assert spatial.spatial_within(spark.createDataFrame([(1.0, 1.0)], "longitude double, latitude double"), wards).collect() == []


def _feature(name, coords, first="type"):
    body = {"type": "Feature", "properties": {"ward_name": name}, "geometry": {"type": "Polygon", "coordinates": coords}}
    return dict(sorted(body.items(), key=lambda kv: kv[0] != first))


SQUARE = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("first", ["type", "properties"])
def test_features_in_any_layout(spark, tmp_path, indent, first):
    names = ["a", 'b "Feature" }', "c]}", None, "Feature", "é"]
    if first == "type":
        names[4] = "plain"  # the very word as a value sends the file the other way, as does a type that is not first
    features = [_feature(n, SQUARE, first) for n in names]
    features.append({"type": "Feature", "properties": None, "geometry": None})
    for k in (1, 2):
        path = tmp_path / f"{k}.geojson"
        path.write_text("\ufeff" * (k == 2 and first == "type") + json.dumps({"type": "FeatureCollection", "crs": {"type": "name"}, "features": features}, indent=indent))
    rows = read_wards(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["ward_name"]) for r in rows] == list(enumerate([*names, None] * 2))
    assert [len(r["edges"]) if r["edges"] is not None else None for r in rows] == [4, 4, 4, 4, 4, 4, None] * 2


def test_one_large_collection_is_read_by_many_tasks(spark, tmp_path):
    features = [_feature(f"w{i}", [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 1], [i, 0]]]) for i in range(4000)]
    path = tmp_path / "large.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        parts = _feature_records(spark, str(path))
        assert parts.rdd.getNumPartitions() > 8
        rows = {r["pos"]: r["ward_name"] for r in read_wards(spark, str(path)).select("pos", "ward_name").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {i: f"w{i}" for i in range(4000)}
