from golden import AREAS, CLUSTERS, IMPORTANCE, QUALITY, REPORTS, SWEEP_RESULTS, WARD_STATIONS
from pyspark.sql import functions as F

from zephra.fixed_values import POLICY_FALLBACK, REPORT_COLUMNS
from zephra.operators import clustering, fusion, metrics, quality
from zephra.plans.bindings import parse_reports


def _stations(spark):
    rows = [(i, *s) for i, s in enumerate(WARD_STATIONS)]
    return spark.createDataFrame(
        rows,
        "pos long, station string, latitude double, longitude double, ward_name string, pm25 double, pm10 double, "
        "severity double, expected int",
    )


def test_sweep_choice_labels_and_areas(spark):
    st = _stations(spark)
    cut = clustering.severity_cutoffs(st).first()
    assert abs(cut["p60"] - 70.64) < 1e-9 and abs(cut["p40"] - 54.342) < 1e-9
    swept = clustering.sweep(st)
    results = clustering.sweep_results(swept)
    got = {r["run"]: (r["candidates"], r["clusters"], r["noise"]) for r in results.collect()}
    assert got == SWEEP_RESULTS
    best = clustering.choose_sweep(results).first()
    assert best["run"] == "B"
    chosen = swept.filter(F.col("run") == "B")
    labelled = clustering.label_candidates(st, chosen)
    assert labelled.filter("cluster <> expected").count() == 0
    table = clustering.ranked_clusters(clustering.hotspot_clusters(chosen)).collect()
    got = [
        (r["cluster_id"], r["wards"], r["center_latitude"], r["center_longitude"], r["avg_severity"], r["avg_pm25"], r["stations"])
        for r in table
    ]
    assert got == CLUSTERS
    assert all(r["ward_count"] == len(r["wards"].split(", ")) and r["station_count"] == 3 and r["avg_pm10"] is None for r in table)
    areas = fusion.policy_brief(fusion.priority_areas(clustering.hotspot_clusters(chosen), chosen)).collect()
    assert {r["area"] for r in areas} == AREAS
    assert {r["recommendation_text"] for r in areas} == {POLICY_FALLBACK}
    own = spark.createDataFrame([("Cluster 1", " Do\nthis ")], "area string, text string")
    texts = fusion.policy_brief(fusion.priority_areas(clustering.hotspot_clusters(chosen), chosen), own)
    assert texts.filter("area = 'Cluster 1'").first()["recommendation_text"] == "Do this"


def test_a_large_cluster_is_one_row_and_one_prompt(spark):
    rows = spark.range(5025).select(
        F.col("id").alias("pos"), F.concat(F.lit("s"), F.col("id")).alias("station"),
        F.when(F.col("id") != 7, F.concat(F.lit("w"), F.col("id") % 3)).alias("ward_name"),
        F.when(F.col("id") < 5000, 0).when(F.col("id") < 5010, 1).otherwise(-1).alias("cluster"),
        F.lit(12.9).alias("latitude"), F.lit(77.6).alias("longitude"), F.lit(80.0).alias("severity"), F.lit(1.0).alias("pm25"), F.lit(2.0).alias("pm10"),
    )
    big, small = clustering.hotspot_clusters(rows).orderBy("cluster_id").collect()
    assert (big["station_count"], big["ward_count"], big["wards"]) == (5000, 3, "w0, w1, w2")
    names = big["stations"].split("; ")
    assert names[:1000] == [f"s{i}" for i in range(1000)] and names[1000:] == ["and 4000 more"]
    assert small["stations"] == "; ".join(f"s{i}" for i in range(5000, 5010))
    members = clustering.cluster_members(rows)
    got = [(r["cluster_id"], r["number"], r["station"]) for r in members.orderBy("cluster_id", "number").collect()]
    assert got == [(0, i + 1, f"s{i}") for i in range(5000)] + [(1, i + 1, f"s{5000 + i}") for i in range(10)]
    assert clustering.member_lines(members).filter("cluster_id = 0 and number = 8").first()["line"] == "8. s7 (Unknown)"
    prompts = fusion.policy_brief(fusion.priority_areas(clustering.hotspot_clusters(rows), rows)).collect()
    assert len(prompts) == 2 + 15 and len([p for p in prompts if p["area"] == "Cluster 0"]) == 1
    from zephra.operators import features

    hot = features.hotspot_stations(members, rows.filter("cluster = -1").select("station", "cluster"))
    assert hot.count() == 5010


def test_all_names_of_a_large_cluster(spark, monkeypatch):
    """The hotspot queries list every station and ward, as their SQL does."""
    from zephra.plans import hotspot_queries

    rows = spark.range(2501).select(
        F.col("id").alias("pos"), F.concat(F.lit("s"), F.col("id")).alias("station"), F.concat(F.lit("w"), F.col("id") % 1200).alias("ward_name"),
        F.lit(0).alias("cluster"), F.lit(12.9).alias("latitude"), F.lit(77.6).alias("longitude"), F.lit(80.0).alias("severity"),
        F.lit(1.0).alias("pm25"), F.lit(2.0).alias("pm10"),
    )
    monkeypatch.setattr(hotspot_queries, "_chosen", lambda spark, d: rows)
    stations, wards = "; ".join(f"s{i}" for i in range(2501)), ", ".join(f"w{i}" for i in range(1200))
    (got,) = hotspot_queries.cluster_summary(spark, "").collect()
    assert (got["station_count"], got["ward_count"], got["wards"], got["stations"]) == (2501, 1200, wards, stations)
    (area,) = hotspot_queries.priority_areas(spark, "").collect()
    assert (area["wards"], area["stations"]) == (wards, stations)


def test_quality_identities(spark):
    """Rows rebuilt from a published line give back its shares and mean gap."""
    frames = None
    for i, (lo, hi, n, m25, _, m10, _, _) in enumerate(QUALITY):
        step = F.expr(f"timestampadd(MICROSECOND, cast(id * (timestampdiff(MICROSECOND, timestamp_ntz'{lo}', timestamp_ntz'{hi}') "
                      f"/ {n - 1}) as bigint), timestamp_ntz'{lo}')")
        last = F.expr(f"timestamp_ntz'{hi}'")
        df = spark.range(n).select(
            F.lit(f"s{i}").alias("station"), F.when(F.col("id") == n - 1, last).otherwise(step).alias("timestamp"),
            F.when(F.col("id") >= m25, 50.0).alias("pm25"), F.when(F.col("id") >= m10, 80.0).alias("pm10"),
            F.lit(12.9).alias("latitude"), F.lit(77.6).alias("longitude"),
        )
        frames = df if frames is None else frames.unionByName(df)
    out = {r["station"]: r for r in quality.station_quality(frames).collect()}
    for i, (lo, hi, n, m25, p25, m10, p10, gap) in enumerate(QUALITY):
        r = out[f"s{i}"]
        assert (r["total_readings"], r["pm25_missing"], r["pm10_missing"]) == (n, m25, m10)
        assert abs(r["pm25_missing_pct"] - p25) < 1e-9 and abs(r["pm10_missing_pct"] - p10) < 1e-9
        assert abs(r["avg_gap_hours"] - gap) < 1e-9
        assert r["date_range"] == f"{lo[:10]} to {hi[:10]}"


def test_severity_without_cutoff_and_defects(spark):
    rows = [("a", "2020-01-01", 10.0, 20.0), ("a", "2020-01-02", 30.0, None), ("b", "2020-01-01", None, 5.0)]
    ts = spark.createDataFrame(rows, "station string, d string, pm25 double, pm10 double").select(
        "station", F.col("d").cast("timestamp_ntz").alias("timestamp"), "pm25", "pm10",
        F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"),
    )
    none = F.lit(None).cast("int")
    out = quality.station_severity(ts, none).collect()
    assert [(r["station"], r["pm25"], r["pm10"], r["severity"], r["scoring_note"]) for r in out] == [
        ("a", 10.0, 20.0, 13.0, "full weighted formula")
    ]
    tags = {(r["pm25"], r["pm10"]): (r["row_severity"], r["severity_formula"]) for r in quality.tag_severity(ts, none).collect()}
    assert tags == {(10.0, 20.0): (13.0, "weighted"), (30.0, None): (30.0, "pm25_only"), (None, 5.0): (None, "weighted")}
    early = {r["pm25"]: (r["row_severity"], r["severity_formula"]) for r in quality.tag_severity(ts, F.lit(2020)).collect()}
    assert early[None] == (None, "pm25_only")


def test_importance_table(spark):
    fi = spark.createDataFrame([(f, v) for f, v, _, _ in IMPORTANCE], "feature string, importance double")
    ranked = metrics.rank_importance(fi)
    got = [(r["rank"], r["feature"], r["importance_pct"], r["cumulative_pct"]) for r in ranked.orderBy("rank").collect()]
    assert got == [(i + 1, f, p, c) for i, (f, _, p, c) in enumerate(IMPORTANCE)]
    groups = {r["feature_group"]: r["total_importance_pct"] for r in metrics.importance_groups(ranked).collect()}
    assert abs(groups["rolling_avg (7d + 30d)"] - 73.788) < 1e-9 and len(groups) == 5
    top = metrics.top_features(ranked).collect()
    assert len(top) == 21 and abs(top[-1]["importance_pct"] - 0.873) < 1e-9


def test_reports_are_parsed(spark):
    df = spark.createDataFrame(REPORTS, ", ".join(f"`{c}` string" for c in REPORT_COLUMNS))
    rows = parse_reports(df).orderBy("reference_id").collect()
    assert (rows[1]["confidence"], rows[1]["severity"], rows[1]["lat"], rows[1]["lon"]) == (94.2, 82, 12.9172, 77.6228)
    assert rows[0]["status"] == "Pending"
