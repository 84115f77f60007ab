"""Clustering against a plain quadratic implementation, with crowded cells and repeated coordinates."""

import random

import pytest

from zephra.operators import clustering, components


def brute(points, eps, min_samples):
    """Labels of (pid, x, y) in pid order."""
    n = len(points)
    near = [
        [j for j in range(n) if ((points[i][1] - points[j][1]) ** 2 + (points[i][2] - points[j][2]) ** 2) ** 0.5 <= eps]
        for i in range(n)
    ]
    core = [len(x) >= min_samples for x in near]
    label = [-1] * n
    count = 0
    for i in range(n):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = count
        while stack:
            for k in near[stack.pop()]:
                if core[k] and label[k] < 0:
                    label[k] = count
                    stack.append(k)
        count += 1
    for i in range(n):
        if not core[i]:
            label[i] = min((label[j] for j in near[i] if core[j]), default=-1)
    return label


def cloud(seed):
    """A third of the points in one clump, some exact copies, the rest scattered."""
    rnd = random.Random(seed)
    pts = [(rnd.gauss(0.5, 0.004), rnd.gauss(0.5, 0.004)) for _ in range(80)]
    pts += [(0.53 + 0.001 * (i % 3), 0.5) for i in range(30)]
    pts += [(rnd.random(), rnd.random()) for _ in range(130)]
    rnd.shuffle(pts)
    return [(i, x, y) for i, (x, y) in enumerate(pts)]


@pytest.mark.parametrize("box, bucket", [(64, 4096), (1, 2)])
def test_against_brute_force(spark, monkeypatch, box, bucket):
    monkeypatch.setattr(clustering, "BOX_POINTS", box)
    monkeypatch.setattr(clustering, "BUCKET_POINTS", bucket)
    rows, want = [], {}
    for seed, eps, k in ((1, 0.03, 3), (2, 0.05, 3), (3, 0.015, 3)):
        pts = cloud(seed)
        rows += [(f"r{seed}", eps, *p) for p in pts]
        for p, c in zip(pts, brute(pts, eps, k)):
            want[f"r{seed}", p[0]] = c
    df = spark.createDataFrame(rows, "run string, eps double, pid long, x double, y double")
    got = {(r["run"], r["pid"]): r["cluster"] for r in clustering.dbscan(df.repartition(5), 3).collect()}
    assert got == want


def test_no_core_points(spark):
    df = spark.createDataFrame([("a", 0.1, 1, 0.0, 0.0), ("a", 0.1, 2, 5.0, 5.0)], "run string, eps double, pid long, x double, y double")
    assert {r["cluster"] for r in clustering.dbscan(df).collect()} == {-1}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [("c", i, i + 1) for i in range(0, 300)] + [("c", 1000, i) for i in range(1001, 1200)] + [("d", 5, 7)]
    random.Random(4).shuffle(edges)
    df = spark.createDataFrame(edges, "run string, u long, v long")
    got = {(r["run"], r["u"]): r["label"] for r in components.components(df).collect()}
    want = {("c", i): 0 for i in range(301)} | {("c", i): 1000 for i in range(1000, 1200)} | {("d", 5): 5, ("d", 7): 5}
    assert got == want


def test_components_of_many_nodes_broadcast_no_minima(spark, monkeypatch):
    """Above the bound the minima of all nodes are merged; labels stay the same."""
    edges = spark.createDataFrame([(r, i, i + 1 + i % 3) for r in range(2) for i in range(0, 60, 2)], "run int, u int, v int")
    want = sorted(map(tuple, components.components(edges).collect()))
    seen = []
    for name in ("_large_star", "_small_star"):
        def watched(df, many, star=getattr(components, name)):
            seen.append((many, star(df, many)._jdf.queryExecution().executedPlan().toString()))
            return star(df, many)

        monkeypatch.setattr(components, name, watched)
    monkeypatch.setattr(components, "ROWS_PER_TASK", 10)
    assert sorted(map(tuple, components.components(edges).collect())) == want
    assert seen and all(many and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for many, plan in seen)



def test_multimodal_hidden_hotspot(spark):
    from pyspark.sql import functions as F

    from zephra.operators import fusion

    sensors = spark.createDataFrame([(0, "s0", 12.90, 77.60, 80.0), (1, "s1", 12.91, 77.60, 20.0), (2, "s2", 12.5, 77.0, None)],
                                    "pos long, station string, latitude double, longitude double, pm25 double")
    reports = spark.createDataFrame(
        [(i, 13.045 + 0.001 * i, 77.51, 80, "Garbage Burning") for i in range(3)] + [(9, None, None, None, None)],
        "report_no long, lat double, lon double, severity int, incident_type string",
    )
    pixels = spark.createDataFrame([(1, "P1", 13.046, 77.511, 150.0), (2, "P2", 12.9, 77.6, 100.0)],
                                   "pixel_no long, pixel_id string, latitude double, longitude double, no2 double")
    points = fusion.multimodal_points(sensors, reports, pixels)
    assert points.count() == 6
    lone = points.filter(F.col("label_name") == "Citizen Incident").first()
    assert (lone["lat"], lone["lon"], lone["weight"]) == (12.97, 77.59, 0.7)
    labelled = clustering.cluster_points(points, 2.5)
    out = clustering.hotspot_summary(labelled, sensors).collect()
    assert len(out) == 1
    r = out[0]
    assert r["cluster_id"] == 1 and r["point_count"] == 4 and r["is_hidden_hotspot"]
    assert r["sources"] == "Citizen Photo Report, Sentinel-5P Satellite" and r["min_sensor_dist_km"] > 2


def test_points_without_a_coordinate_are_noise(spark):
    rows = [("r", 0.5, i, 1.0, 1.0) for i in range(3)] + [("r", 0.5, 3, None, 1.0), ("r", 0.5, 4, 1.0, None), ("r", 0.5, 5, None, None)] * 1
    df = spark.createDataFrame(rows, "run string, eps double, pid long, x double, y double")
    got = {r["pid"]: r["cluster"] for r in clustering.dbscan(df, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: -1, 4: -1, 5: -1}
    assert {r["cluster"] for r in clustering.dbscan(df.filter("pid > 2"), 1).collect()} == {-1}
